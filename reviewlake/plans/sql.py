"""Pieces of DuckDB SQL that several oracle queries share."""

from reviewlake.functions.text import NEGATIVE_WORDS, POSITIVE_WORDS, WS_POINTS

WS = r"[\s\x0b\x1c-\x1f" + "".join(map(chr, WS_POINTS)) + "]"
ENDS = ".!?" + "".join(map(chr, (0x3002, 0xFF01, 0xFF1F)))
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def clean(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{WS}+', ' ', 'g'))"


def strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^{WS}+|{WS}+$', '', 'g')"


def number(c: str) -> str:
    return f"CASE WHEN regexp_matches({strip(c)}, '{NUMBER}') THEN TRY_CAST({strip(c)} AS DOUBLE) END"


def words(values: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in values)


def recommend(c: str) -> str:
    t = f"lower({strip(c)})"
    return (
        f"CASE WHEN {t} IN ({words(POSITIVE_WORDS)}) THEN 'Recommended' WHEN {t} IN ({words(NEGATIVE_WORDS)}) OR {t} = 'nan' THEN 'Not Recommended' "
        f"WHEN ({number(c)}) IS NULL THEN '' WHEN ({number(c)}) > 0 THEN 'Recommended' ELSE 'Not Recommended' END"
    )


def sentences(c: str) -> str:
    """Array of sentences, split after the marks where white space follows."""
    return f"list_filter(list_transform(string_split(regexp_replace({clean(c)}, '([{ENDS}])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda x: trim(x)), lambda x: x <> '')"


def vector(c: str) -> str:
    return f"CAST({c} AS DOUBLE[])"


def bucket(c: str) -> str:
    return f"CASE WHEN {c} <= -1.8 THEN 1 WHEN {c} <= -0.6 THEN 2 WHEN {c} < 0.6 THEN 3 WHEN {c} < 1.8 THEN 4 WHEN {c} IS NOT NULL THEN 5 END"
