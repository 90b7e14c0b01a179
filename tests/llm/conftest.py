import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, row long, h long, n long, kept boolean"


@pytest.fixture(scope="session")
def texts():
    """Ids and texts with edge cases: null, empty, blank, very long, ties, copies, near copies, private and secret data."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    out = [None, "", " \t\n ", "one", "a b c d", "a b c d e", "A B C D E", "x " * 3000, "y" * 5000]
    base = [rng.choice(words) for _ in range(200)]
    for k in range(12):
        w = list(base)
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    out += [out[-1], out[-1], "same line\n" * 40, "A LOUD " * 60, "w### x$$$ " * 60]
    out += [f"mail a.b{i}@x{i}.example.com or 10.0.0.{i} and 300.1.1.1, +1 (555) 010-{1000 + i} 4111 1111 1111 1111 end" for i in range(4)]
    out += [" a@b.co  c@d.ef_g@h.ij", "1.2.3.4.5.6.7.8", "+1+1 555 555 55 55", "é" * 70 + " q@r.st"]
    out += ['password = "hunter2hunter2" api_key:abc12345 token==xyz', "AKIA" + "ABCD1234" * 2, "deadbeef" * 5 + " DEADBEEF", "PassWd : short"]
    out += ["k = " + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(48)) for _ in range(3)]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(50, 400))) for _ in range(25)]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with further columns of clashing names, one null source, and a row without id."""
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "a", "b", "c"][i % 4], len(t or ""), -1, -2, -3, -4, None) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd(spark, texts):
    """Null ids, and rows that repeat."""
    rows = [(None, "some words without an id", None, None, None, None, None, None, None, None)] * 2 + [(7, texts[9][1], "en", "a", 1, 1, 1, 1, 1, True)] * 3
    return spark.createDataFrame(rows, DOCS)
