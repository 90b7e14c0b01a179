"""Pattern matches with their places in a text, from built-in functions only.

Spark's regular expressions give matches without places. Here every match is wrapped in two private characters, the
text is split at the first of them, and running sums of the parts' lengths give each match's place in code points.
Patterns must not match the characters U+E000 to U+E002; where a text holds the first two, they count as the third.
A text with n matches costs some n to the power 1.5 at most.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

OPEN, CLOSE, OTHER = "\ue000", "\ue001", "\ue002"
SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"
FOUND = "array<struct<start:int,end:int,value:string>>"
CHUNK_BITS = 8


def named(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, add, zero: Column) -> Column:
    """For each element, what add makes of zero and all before it.

    Appending to an array copies it, so it is done in blocks as long as the root of the size, and then over the blocks.
    """

    def prefixes(block: Column, item=lambda x: x) -> Column:
        return F.aggregate(block, F.array(zero), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), item(x)))))

    def of(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / step).cast("int")), lambda k: prefixes(F.slice(v, k * step + 1, step)))
        whole = lambda b, ahead: F.flatten(F.transform(b, lambda x, k: F.transform(F.slice(x, 1, F.size(x) - 1), lambda y: add(ahead[k], y))))
        out = named(blocks, lambda b: named(prefixes(b, lambda x: F.element_at(x, -1)), lambda ahead: whole(b, ahead)))
        return F.when(F.size(v) > 0, out).otherwise(F.array().cast("array<int>"))

    return named(values, of)


def find(text: Column, pattern: str, keep=None) -> Column:
    """Leftmost non-overlapping matches whose value passes keep, as an array of (start, end, value); empty for null."""
    safe = F.when(text.contains(OPEN) | text.contains(CLOSE), F.translate(text, OPEN + CLOSE, OTHER + OTHER)).otherwise(text)
    parts = F.split(F.regexp_replace(safe, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), OPEN, -1)

    def places(p: Column) -> Column:
        at = running(F.transform(p, lambda x, i: F.length(x) - F.when(i > 0, 1).otherwise(0)), lambda x, y: x + y, F.lit(0))
        here = lambda value, start: F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))
        return named(at, lambda starts: F.transform(F.slice(p, 2, F.size(p) - 1), lambda x, i: here(F.substring_index(x, CLOSE, 1), starts[i + 1])))

    none = F.array().cast(FOUND)
    found = F.coalesce(named(parts, lambda p: F.when(F.size(p) > 1, places(p)).otherwise(none)), none)
    return F.filter(found, lambda s: keep(s["value"])) if keep else found


def with_matches(df, text: str, patterns: dict[str, tuple], out: str):
    """Add the matches of (pattern, keep) by kind that pass keep, sorted by start and then kind."""
    def of_kind(kind: int, pattern: str, keep) -> Column:
        return F.transform(find(F.col(text), pattern, keep), lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    arrays = [of_kind(k, *rule) for k, rule in enumerate(patterns.values())]
    return df.withColumn(out, F.array_sort(F.concat(*arrays)).cast(SPANS))


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def spelled(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of all spans in order, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def chunks(text: Column) -> Column:
    """The text in chunks of 2**CHUNK_BITS code points, so that a part far inside is read without walking there."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << CHUNK_BITS}}}+"), F.lit(0))


def cut(chunked: Column, at: Column, n: Column) -> Column:
    """n code points from at on."""
    inside = at.bitwiseAND((1 << CHUNK_BITS) - 1)
    some = F.slice(chunked, F.shiftright(at, CHUNK_BITS) + 1, F.shiftright(inside + n - 1, CHUNK_BITS) + 1)
    return F.when(n > 0, F.substring(F.array_join(some, ""), inside + 1, n)).otherwise("")


def replaced(text: Column, spans: Column, fill) -> Column:
    """The text with each of the sorted spans replaced by fill(span, end of all before it)."""

    def of(c: Column, ends: Column) -> Column:
        body = F.transform(spans, lambda s, i: F.concat(cut(c, ends[i], s["start"] - ends[i]), fill(s, ends[i])))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.array_join(F.concat(body, F.array(cut(c, last, F.length(text) - last))), "")

    upto = running(F.transform(spans, lambda s: s["end"]), F.greatest, F.lit(0))
    return F.when(F.size(spans) > 0, named(chunks(text), lambda c: named(upto, lambda ends: of(c, ends)))).otherwise(text)


def blanked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by as many spaces."""
    return replaced(text, spans, lambda s, before: F.repeat(F.lit(" "), s["end"] - F.greatest(before, s["start"])))


def redacted(text: Column, spans: Column, kinds: list[str]) -> Column:
    """The text with each span replaced by its kind in brackets; a span that begins inside an earlier one joins it."""
    names = F.array(*map(F.lit, kinds))
    return replaced(text, spans, lambda s, before: F.when(s["start"] < before, "").otherwise(F.concat(F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]"))))
