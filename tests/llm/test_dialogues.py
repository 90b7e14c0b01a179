"""Conversation repair against SQL, an exhaustive search, and plain Python."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import dialogues as D

SCHEMA = "conv_id long, turn long, role string, text string, at long, seq string, a string, n long"
WHITE = " \t\n\x0b\x0c\r"


def damaged_by_hand(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if way == 0:
            continue
        text = "" if way == 1 else "".join(c for c in text if c not in ".!?") if way == 2 else text
        out[conv] += [(turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return {k: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for k, v in out.items()}


def by_hand(rows):
    """The report of one conversation: states are sets of roles so far, tried out one edit at a time (no matrices)."""
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.rstrip(WHITE)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    best = {"": (0, "", ())}  # the end of the roles so far -> (cost, edits, lines)

    def put(d, key, value):
        if key not in d or value < d[key]:
            d[key] = value

    def after(last, r):
        return r if (last, r) in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")) else None

    def insertions(d):
        for _ in range(3):
            for last, (c, e, t) in list(d.items()):
                for r, name in (("u", "user"), ("a", "assistant")):
                    if (n := after(last, r)) is not None:
                        put(d, n, (c + 5, e + "I", (*t, name + ":")))

    for (_, role, text), fault in zip(rows, faults):
        insertions(best)
        new = {}
        for last, (c, e, t) in best.items():
            put(new, last, (c + 2, e + "D", t))
            if fault in ("", "truncated"):
                more = 5 * (fault == "truncated")
                if (n := after(last, role[:1])) is not None:
                    put(new, n, (c + more, e + "K", (*t, f"{role}:{text}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if (n := after(last, r)) is not None:
                        put(new, n, (c + more + 1, e + "R", (*t, f"{name}:{text}")))
        best = new
    insertions(best)
    cost, edits, lines = min(best[k] for k in ("", "a") if k in best)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def some_rows(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Well.", "so", "Yes!", "no?", "", " \t\n", None, "a.  ", "b . c", "x" * 3000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "us", "Assistant"]
    rows = []
    for c in range(conversations):
        turns = [rng.choice([None, *range(6)]) if rng.random() < 0.1 else t for t in range(rng.randint(1, longest))]
        rows += [(c if c else None, t, rng.choice(roles[: rng.choice((2, 3, 8))]), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}.") for t in turns]
    return rows + rows[:5] + [(7, 2**40, "user", "far away.")]


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in D.repair_report(df).collect()}
    assert got == {k: by_hand(v) for k, v in damaged_by_hand(rows).items()}
    return df, got


def test_report_is_that_of_a_plain_search_and_of_the_sql(spark, tmp_path):
    df, got = check(spark, some_rows(1, 150, 12))
    df.toPandas().to_parquet(tmp_path / "c.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM '{tmp_path}/c.parquet'")
    assert {r[0]: r[1:] for r in con.execute(D.SQL).fetchall()} == got
    lines = D.repaired_rows(df).orderBy("conv_id", "line").collect()
    for conv, group in itertools.groupby(lines, key=lambda r: r["conv_id"]):
        text = "\n".join(f"{r['role']}:{r['text']}" for r in group)
        assert hashlib.sha256(text.encode()).hexdigest() == got[conv][-1]


def test_a_conversation_in_many_segments(spark, monkeypatch):
    monkeypatch.setattr(D, "SEGMENT", 7)
    check(spark, some_rows(2, 30, 90))


def test_one_conversation_holds_a_third_of_all_rows(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"turn {t}." if t % 9 else "same.") for t in range(3000)] + some_rows(3, 900, 10)
    check(spark, [r for r in rows if r[0] != 1 or r[3].startswith(("turn", "same"))])


def test_all_edits_are_the_least_of_all_strings():
    """Every string of edits over short conversations, tried out."""

    def roles_of(rows, edits):
        it, made, cost, slots = iter(rows), [], 0, []
        for e in edits:
            if e == "I":
                slots.append(None), made.append("?")
                cost += 5
                continue
            role, fault = next(it, (None, None))
            if role is None or e != "D" and fault in (2, 3):
                return None
            cost += {"K": 0, "R": 1, "D": 2}[e] + 5 * (e != "D" and fault == 1)
            if e != "D":
                made.append("suao"[role] if e == "K" else "?")
        if next(it, None) is not None:
            return None
        n = len(made)
        wanted = ["s"] * (n % 2) + ["u", "a"] * (n // 2)
        return cost if n != 1 and all(m == w or m == "?" and w != "s" for m, w in zip(made, wanted)) else None

    grammar = D.Grammar([])
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.randrange(4), rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(rng.randint(1, 3))]
        tried = ((c, "".join(e)) for n in range(6) for e in itertools.product("DIKR", repeat=n) if (c := roles_of(rows, e)) is not None)
        got = grammar.solve("".join(chr(65 + 4 * r + f) for r, f in rows))
        assert (got[0], got[-1]) == min(tried)


def test_rules_change_no_result():
    rng = random.Random(6)
    seqs = ["".join(rng.choice("AEIEIEIEIFBGKM") for _ in range(rng.randint(1, 300))) for _ in range(20)]
    rules = ["EI", chr(256) * 2, chr(257) * 2, chr(258) + "E", "IE"]
    plain, packed = D.Grammar([]), D.Grammar(rules)
    for s in seqs:
        assert plain.solve(s) == packed.solve(s)
        run = D.Run()
        for i in range(0, len(s), 13):
            run.add(packed.whole(s[i : i + 13]))
        assert run.result() == plain.solve(s)


def test_ropes_compare_like_strings():
    rng = random.Random(7)
    for _ in range(300):
        texts = ["".join(rng.choice("DK") for _ in range(rng.randint(0, 9))) * rng.choice((1, 30)) for _ in range(6)]
        a = D.Rope()
        for t in texts:
            a = a + D.Rope(t)
        other = "".join(texts)
        b = D.Rope(other if rng.random() < 0.5 else other[: rng.randint(0, len(other))] + rng.choice(("", "D", "K", "R")))
        assert str(a) == other and (a < b) == (other < str(b)) and (b < a) == (str(b) < other)


def test_re_pair_counts_and_stops(spark):
    df = spark.createDataFrame([("EIEIEIEI", 10), ("EI", 5), ("AAAAA", 1)], "seq string, n long")
    rules = D.re_pair(df)
    assert rules[0] == "EI" and chr(256) * 2 in rules
    assert D.count_pairs("AAAAA") == {"AA": 2} and D.count_pairs("AABAA") == {"AA": 2, "AB": 1, "BA": 1}


@pytest.mark.parametrize("rows", [[], [(5, 0, "user", "hi.")] * 4, [(None, None, None, None)]])
def test_small_tables(spark, rows):
    check(spark, rows)


def test_dropped_conversation(spark):
    conv = next(c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    _, got = check(spark, [(conv, 0, "user", "gone.")])
    assert got == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
