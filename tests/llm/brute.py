"""Plain-Python versions of the numbered operators' contracts."""

import hashlib
import re

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def luhn(value):
    d = [int(c) for c in value if c.isdigit()]
    return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


PII = [
    ("email", EMAIL, lambda m: True),
    ("ip", IP, lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", CARD, lambda m: luhn(m[0])),
    ("phone", PHONE, lambda m: 9 <= sum(c.isdigit() for c in m[0]) <= 15),
]
SECRETS = [("assign", ASSIGN, lambda m: len(m[2]) >= 8), ("access", ACCESS, lambda m: len(m[0]) >= 16), ("hex", HEX, lambda m: len(m[0]) >= 32)]


def base_spans(text, kinds):
    found = []
    for k, (name, pattern, keep) in enumerate(kinds):
        found += [(m.start(), k, m.end(), name) for m in pattern.finditer(text or "") if keep(m)]
    return [(name, start, end) for start, _, end, name in sorted(found)]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
