"""Repair of conversations by a grammar-compressed dynamic programme.

Rows of a conversation become letters: role (system, user, assistant, other) and first fault (sound, truncated, blank,
duplicate). Re-Pair finds pairs of neighbouring symbols that are frequent over all conversations and makes a rule of
each. A rule is worth one min-plus matrix over the four states of the grammar of roles, `(s?(ua)+)?`; entries are the
least cost and the rope of its edits, ties to the ASCII-least. Matrices are made from the bottom up, once a task, and
serve all conversations: each is a vector times the matrices of its few symbols.

No edit string of equal cost is the start of another one (the rest would be insertions, which cost), so the least of
two stays the least whatever is put before or after both, and the product is associative. That is why a conversation
of any length can be cut: its segments become matrices in parallel, and only these meet in one task. SHA-256 has to
read a repaired conversation from first to last; that task streams it and keeps the edits and one row.

Defined results: null role, text, conversation or turn are a single space, in the damaging key too, and such a
conversation is returned under its null id; a null turn comes first. Rows of one turn go by role, then text; a role
whose first letter is none of s, u and a can only be changed or deleted. Repeated rows are rows of their own. A
conversation without rows has zeros, no edits and the hash of nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from reviewlake.llm.batches import map_rows
from reviewlake.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
ROLES, FAULTS = "sua", ("sound", "truncated", "blank", "duplicate")
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
#: Rows of a segment; rules, pairs looked at in a round, and the share of symbols below which a round is the last one.
SEGMENT, MAX_RULES, TOP_PAIRS, LEAST_GAIN = 16_384, 512, 1024, 0.01
RULE_0 = 0x100
#: States of the roles' grammar: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
COST = {"rerole": 1, "delete": 2, "insert": 5, "truncated": 5}
KEPT_SEQUENCES = 100_000
_MOD, _BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC834


class Rope:
    """A string of edits as a leaf or two ropes, with its length and hash, so that parts can be shared and compared."""

    __slots__ = ("n", "h", "power", "text", "left", "right")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.n, self.h, self.power = len(text), 0, pow(_BASE, len(text), _MOD)
            for c in text:
                self.h = (self.h * _BASE + ord(c)) % _MOD
        else:
            self.n, self.power = left.n + right.n, left.power * right.power % _MOD
            self.h = (left.h * right.power + right.h) % _MOD

    def __add__(self, other: Rope) -> Rope:
        if not self.n or not other.n:
            return self if self.n else other
        if self.n + other.n <= 64:
            return Rope(str(self) + str(other))
        return Rope("", self, other)

    def leaves(self):
        stack = [self]
        while stack:
            x = stack.pop()
            if x.left is None:
                yield x.text
            else:
                stack += [x.right, x.left]

    def __str__(self) -> str:
        return self.text if self.left is None else "".join(self.leaves())

    def __lt__(self, other: Rope) -> bool:
        mine, theirs = [self], [other]
        while mine and theirs:
            a, b = mine.pop(), theirs.pop()
            if a.n == b.n and a.h == b.h:
                continue
            if a.left is None and b.left is None:
                k = min(a.n, b.n)
                if a.text[:k] != b.text[:k]:
                    return a.text < b.text
                mine += [Rope(a.text[k:])] if a.n > k else []
                theirs += [Rope(b.text[k:])] if b.n > k else []
            elif b.left is None or a.left is not None and a.n >= b.n:
                mine += [a.right, a.left]
                theirs.append(b)
            else:
                mine.append(a)
                theirs += [b.right, b.left]
        return bool(theirs) and not mine


Entry = tuple[int, Rope] | None
EMPTY = Rope()


def _least(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if b[1] < a[1] else a


def _row_times(row: list[Entry], m: list[list[Entry]]) -> list[Entry]:
    out: list[Entry] = [None] * 4
    for x, ms in zip(row, m):
        if x is not None:
            for j, y in enumerate(ms):
                if y is not None and (out[j] is None or x[0] + y[0] <= out[j][0]):
                    out[j] = _least(out[j], (x[0] + y[0], x[1] + y[1]))
    return out


def _times(a: list[list[Entry]], b: list[list[Entry]]) -> list[list[Entry]]:
    return [_row_times(row, b) for row in a]


def _insertions() -> list[list[Entry]]:
    """What inserted rows alone can do; a second visit of a state only costs."""
    m: list[list[Entry]] = [[(0, EMPTY) if i == j else None for j in STATES] for i in STATES]
    one, two = (COST["insert"], Rope("I")), (2 * COST["insert"], Rope("II"))
    m[START][USER] = m[SYSTEM][USER] = m[ASSISTANT][USER] = m[USER][ASSISTANT] = one
    m[START][ASSISTANT] = m[SYSTEM][ASSISTANT] = two
    return m


INSERTIONS = _insertions()


def _letter_matrix(role: int, fault: int) -> list[list[Entry]]:
    """Insertions before a row, then its own edit."""
    m: list[list[Entry]] = [[(COST["delete"], Rope("D")) if i == j else None for j in STATES] for i in STATES]
    if fault in (SOUND, TRUNCATED):
        more = COST["truncated"] * (fault == TRUNCATED)
        act = lambda wanted: (more, Rope("K")) if role == wanted else (more + COST["rerole"], Rope("R"))
        m[START][USER] = m[SYSTEM][USER] = m[ASSISTANT][USER] = act(1)
        m[USER][ASSISTANT] = act(2)
        if role == 0:
            m[START][SYSTEM] = (more, Rope("K"))
    return _times(INSERTIONS, m)


class Worth:
    """What a symbol is worth: its matrix, the faults in it, neighbours of other roles than su, ua and au, and its end roles."""

    __slots__ = ("matrix", "counts", "first", "last")

    def __init__(self, matrix, counts, first, last):
        self.matrix, self.counts, self.first, self.last = matrix, counts, first, last

    @staticmethod
    def letter(code: int) -> Worth:
        role, fault = divmod(code, 4)
        return Worth(_letter_matrix(role, fault), (fault == BLANK, fault == DUPLICATE, fault == TRUNCATED, 0), role, role)

    def then(self, other: Worth) -> Worth:
        return Worth(_times(self.matrix, other.matrix), joined(self.counts, self.last, other), self.first, other.last)


def joined(counts: tuple, last: int | None, worth: Worth) -> tuple:
    broken = last is not None and (last, worth.first) not in ((0, 1), (1, 2), (2, 1))
    a, b = counts, worth.counts
    return a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3] + broken


def compress(sequence: str, rules: list[str]) -> str:
    for k, pair in enumerate(rules):
        sequence = sequence.replace(pair, chr(RULE_0 + k))
    return sequence


class Grammar:
    """The worth of all letters and rules, from the bottom up."""

    def __init__(self, rules: list[str]):
        self.rules = rules
        self.worth = {chr(65 + c): Worth.letter(c) for c in range(16)}
        for k, pair in enumerate(rules):
            self.worth[chr(RULE_0 + k)] = self.worth[pair[0]].then(self.worth[pair[1]])

    def whole(self, sequence: str) -> Worth:
        """One matrix of a segment."""
        symbols = compress(sequence, self.rules)
        out = self.worth[symbols[0]]
        for x in symbols[1:]:
            out = out.then(self.worth[x])
        return out

    def solve(self, sequence: str) -> tuple:
        """(cost, blank, duplicate, truncated, illegal, audit) of a whole conversation."""
        run = Run()
        for x in compress(sequence, self.rules):
            run.add(self.worth[x])
        return run.result()


class Run:
    """A conversation as far as it was read: a vector of the four states."""

    def __init__(self):
        self.row, self.counts, self.last = [(0, EMPTY), None, None, None], (0, 0, 0, 0), None

    def add(self, worth: Worth) -> None:
        self.row = _row_times(self.row, worth.matrix)
        self.counts, self.last = joined(self.counts, self.last, worth), worth.last

    def result(self) -> tuple:
        row = _row_times(self.row, INSERTIONS)
        cost, audit = _least(row[START], row[ASSISTANT])
        return cost, *map(int, self.counts), str(audit)


def count_pairs(symbols: str) -> Counter:
    """Pairs of neighbours as replacing from the left meets them: of a run of three equal symbols one pair counts."""
    counts, skip = Counter(), False
    for a, b, c in zip(symbols, symbols[1:], [None, *symbols]):
        skip = a == b == c and not skip
        if not skip:
            counts[a + b] += 1
    return counts


def re_pair(sequences: DataFrame) -> list[str]:
    """Rules for (seq, n): in each round the pairs seen most often, none of which shares a symbol with another.

    A round counts all pairs of all sequences in the tasks. Rules only shorten sequences, so their number is bounded
    (MAX_RULES) without a bearing on results.
    """
    rules: list[str] = []
    while len(rules) < MAX_RULES:

        def make(known=tuple(rules)):
            def one(seq, n):
                symbols = compress(seq, known)
                yield "", n * len(symbols)
                for pair, k in count_pairs(symbols).items():
                    yield pair, n * k

            return one

        seen = map_rows(sequences, make, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        top = seen.orderBy(F.col("pair") != "", F.desc("n"), "pair").limit(TOP_PAIRS).collect()
        used, new, gain = set(), [], 0
        for pair, n in ((r["pair"], r["n"]) for r in top[1:]):
            if n >= 2 and used.isdisjoint(pair) and len(rules) + len(new) < MAX_RULES:
                used |= set(pair)
                new.append(pair)
                gain += n
        rules += new
        if not new or gain < LEAST_GAIN * top[0]["n"]:
            break
    return rules


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): a twentieth of rows each dropped, emptied, without end marks, repeated, or given to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role").alias("role"), space("text").alias("text"), way.alias("way"))
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("way") == 3, 2).otherwise(1)))
    return rows.where("way <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with `at`, their place in the order of all conversations; dealt by ranges, so that a long conversation is many tasks' work."""
    head = F.substring("text", 1, 32)
    sorted_ = rows.repartitionByRange("conv_id", "turn", "role", head).sortWithinPartitions("conv_id", "turn", "role", "text")
    return materialize(sorted_.withColumn("at", F.monotonically_increasing_id()), "dialogue-rows")


def segments(rows: DataFrame) -> DataFrame:
    """(conv_id, at, seq): the letters of neighbouring rows of a conversation, SEGMENT at most."""
    core = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(core == "", BLANK).when(F.substring(core, -1, 1).isin(*".!?"), SOUND).otherwise(TRUNCATED)
    initial = F.substring("role", 1, 1)
    role = F.coalesce(*[F.when(initial == r, k) for k, r in enumerate(ROLES)], F.lit(3))
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    narrow = rows.select("conv_id", "at", same.alias("same"), role.alias("role"), fault.alias("fault"))
    first = narrow.groupBy("conv_id", "same").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    letters = narrow.join(first, "at", "left").select("conv_id", "at", F.char(65 + 4 * F.col("role") + fault).alias("letter"))
    letters = letters.repartition(F.shiftright("at", 33)).sortWithinPartitions("at")

    def make():
        now: list = []

        def one(conv_id, at, letter):
            if now and (now[0] != conv_id or len(now[2]) >= SEGMENT):
                yield now[0], now[1], "".join(now[2])
                now.clear()
            if not now:
                now.extend((conv_id, at, []))
            now[2].append(letter)

        one.end = lambda: [(now[0], now[1], "".join(now[2]))] if now else []
        return one

    return materialize(map_rows(letters, make, "conv_id long, at long, seq string"), "dialogue-segments")


SOLVED = "cost long, blank long, duplicate long, truncated long, illegal long, audit string"


def solved(parts: DataFrame, rules: list[str]) -> DataFrame:
    """conv_id and SOLVED of every conversation that has rows."""
    many = parts.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("_many"))
    is_many = F.col("conv_id").eqNullSafe(F.col("_many"))

    def whole():
        grammar, known = Grammar(rules), {}

        def one(conv_id, seq):
            if len(known) >= KEPT_SEQUENCES:
                known.clear()
            out = known.get(seq)
            if out is None:
                out = grammar.solve(seq)
                if len(seq) <= 64:
                    known[seq] = out
            yield conv_id, *out

        return one

    def piece():
        grammar = Grammar(rules)

        def one(conv_id, at, seq):
            w = grammar.whole(seq)
            cells = [x for row in w.matrix for x in row]
            yield conv_id, at, list(map(int, w.counts)), w.first, w.last, [x and x[0] for x in cells], [x and str(x[1]) for x in cells]

        return one

    def chain():
        now: list = []

        def one(conv_id, at, counts, first, last, costs, edits):
            if now and now[0] != conv_id:
                yield now[0], *now[1].result()
                now.clear()
            if not now:
                now.extend((conv_id, Run()))
            cells = [None if c is None else (c, Rope(e)) for c, e in zip(costs, edits)]
            now[1].add(Worth([cells[i : i + 4] for i in range(0, 16, 4)], counts, first, last))

        one.end = lambda: [(now[0], *now[1].result())] if now else []
        return one

    short = map_rows(parts.join(many, is_many, "left_anti").select("conv_id", "seq"), whole, f"conv_id long, {SOLVED}")
    pieces = map_rows(parts.join(many, is_many, "left_semi").select("conv_id", "at", "seq"), piece, "conv_id long, at long, counts array<long>, first int, last int, costs array<long>, edits array<string>")
    return short.unionByName(map_rows(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "at"), chain, f"conv_id long, {SOLVED}"))


class Repaired:
    """(role, text) of a repaired conversation, one at a time: rows go in by order, with the edits known from the start."""

    def __init__(self, audit: str):
        self.audit, self.at = audit, 0
        self.made, self.odd = 0, (len(audit) - audit.count("D")) % 2

    def _wanted(self) -> str:
        self.made += 1
        return "assistant" if (self.made - self.odd) % 2 == 0 else "user"

    def inserted(self):
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._wanted(), ""

    def row(self, role: str, text: str):
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            wanted = self._wanted()
            yield role if edit == "K" else wanted, text


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _together(turns: DataFrame) -> DataFrame:
    """What a conversation needs, in its order: its id and gaps, its solution, its rows. One shuffle of the texts, no join."""
    rows = ordered(damaged(turns))
    parts = segments(rows)
    rules = re_pair(materialize(parts.groupBy("seq").agg(F.count("*").alias("n")), "dialogue-sequences"))
    gaps = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    ids = turns.select(F.col("conv_id").cast("long")).withColumn("g", F.lit(0).cast("long")).groupBy("conv_id").agg(F.max("g").alias("g"))
    ids = ids.unionByName(rows.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).alias("g"))).groupBy("conv_id").agg(F.max("g").alias("g"))
    none = F.lit(None).cast("string")
    out = ids.select("conv_id", F.lit(0).alias("tag"), F.lit(0).cast("long").alias("at"), F.array("g").alias("nums"), none.alias("a"), none.alias("b"))
    out = out.unionByName(solved(parts, rules).select("conv_id", F.lit(1).alias("tag"), F.lit(0).cast("long").alias("at"), F.array("blank", "duplicate", "truncated", "illegal", "cost").alias("nums"), F.col("audit").alias("a"), none.alias("b")))
    out = out.unionByName(rows.select("conv_id", F.lit(2).alias("tag"), "at", F.array().cast("array<bigint>").alias("nums"), F.col("role").alias("a"), F.col("text").alias("b")))
    return out.repartition("conv_id").sortWithinPartitions("conv_id", "tag", "at")


def repair_report(turns: DataFrame) -> DataFrame:
    """Per conversation of a damaged table: gaps, faults, cost, audit, and the hash of its repaired lines."""

    def make():
        now: dict = {}

        def close():
            for line in now["fix"].inserted():
                feed(line)
            return now["id"], *now["nums"], now["audit"], now["sha"].hexdigest()

        def feed(line):
            now["sha"].update((("\n" if now["any"] else "") + ":".join(line)).encode())
            now["any"] = True

        def one(conv_id, tag, at, nums, a, b):
            if tag == 0:
                if now:
                    yield close()
                now.update(id=conv_id, nums=[nums[0], 0, 0, 0, 0, 0], audit="", fix=Repaired(""), sha=hashlib.sha256(), any=False)
            elif tag == 1:
                now.update(nums=[now["nums"][0], *nums], audit=a, fix=Repaired(a))
            else:
                for line in now["fix"].row(a, b):
                    feed(line)

        one.end = lambda: [close()] if now else []
        return one

    return map_rows(_together(turns), make, REPORT)


def repaired_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, line, role, text) of the repaired conversations, lines from 0."""

    def make():
        now: dict = {}

        def lines(found):
            for role, text in found:
                yield now["id"], now["n"], role, text
                now["n"] += 1

        def one(conv_id, tag, at, nums, a, b):
            if tag == 0:
                if now:
                    yield from lines(now["fix"].inserted())
                now.update(id=conv_id, n=0, fix=Repaired(""))
            elif tag == 1:
                now["fix"] = Repaired(a)
            else:
                yield from lines(now["fix"].row(a, b))

        one.end = lambda: list(lines(now["fix"].inserted())) if now else []
        return one

    return map_rows(_together(turns), make, "conv_id long, line long, role string, text string")


def _sql() -> str:
    """DuckDB SQL: the same programme walked row by row, with crc32 by its table."""
    far = 10**15
    entry = lambda c, a="''", t="''": f"{{'c': {c}, 'a': {a}, 't': {t}}}"
    add = lambda x, c, a, t="''": entry(f"{x}.c + {c}", f"{x}.a || {a}", f"{x}.t || {t}")
    one, two = "'I'", "'II'"
    user, both, assistant = "chr(10) || 'user:'", "chr(10) || 'user:' || chr(10) || 'assistant:'", "chr(10) || 'assistant:'"
    closed = lambda v: (
        f"[{v}[1], {v}[2], list_min([{v}[3], {add(f'{v}[1]', 5, one, user)}, {add(f'{v}[2]', 5, one, user)}, {add(f'{v}[4]', 5, one, user)}]), "
        f"list_min([{v}[4], {add(f'{v}[3]', 5, one, assistant)}, {add(f'{v}[1]', 10, two, both)}, {add(f'{v}[2]', 10, two, both)}])]"
    )
    drop = lambda x: add(x, 2, "'D'")
    act = lambda x, r, name: add(x, f"CASE WHEN gone THEN {far} WHEN r = '{r}' THEN p ELSE p + 1 END", f"CASE WHEN r = '{r}' THEN 'K' ELSE 'R' END", f"chr(10) || CASE WHEN r = '{r}' THEN role ELSE '{name}' END || ':' || text")
    keep = add("v[1]", f"CASE WHEN gone OR r <> 's' THEN {far} ELSE p END", "'K'", "chr(10) || role || ':' || text")
    step = f"[{drop('v[1]')}, list_min([{drop('v[2]')}, {keep}]), list_min([{drop('v[3]')}, {act('v[1]', 'u', 'user')}, {act('v[2]', 'u', 'user')}, {act('v[4]', 'u', 'user')}]), list_min([{drop('v[4]')}, {act('v[3]', 'a', 'assistant')}])]"
    start = f"[{entry('CAST(0 AS BIGINT)')}, {entry(far)}, {entry(far)}, {entry(far)}]"
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
      src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS b FROM conversations),
      crc AS (SELECT src.*, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS way FROM src, tab),
      dmg AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE WHEN way = 1 THEN '' WHEN way = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN way = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE way <> 0),
      num AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k, rtrim(text, {white}) AS core FROM dmg),
      f AS (SELECT *, role[1] AS r, core = '' AS blank, core <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS dup, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM num),
      g AS (SELECT *, blank OR dup AS gone, NOT blank AND NOT dup AND core[-1] NOT IN ('.', '!', '?') AS cut FROM f),
      d AS (SELECT conv_id, k, role, text, r, gone, CASE WHEN cut THEN 5 ELSE 0 END AS p FROM g),
      c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (k > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM g GROUP BY 1),
      w AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, {start} AS st FROM d
        UNION ALL SELECT conv_id, k, {step} AS st FROM (SELECT d.*, {closed('w.st')} AS v FROM w JOIN d ON d.conv_id IS NOT DISTINCT FROM w.conv_id AND d.k = w.k + 1)),
      e AS (SELECT w.conv_id, {closed('st')} AS v FROM w JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.k),
      b AS (SELECT conv_id, list_min([v[1], v[4]]) AS best FROM e)
      SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
      FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM o.conv_id"""


SQL = _sql()
