"""Multi-valued fields: ids joined by one blank inside a string column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL = "-1"
OTHER = "other"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokens(col, sep: str = " ") -> Column:
    """String -> array of tokens (split on one blank)."""
    return F.split(_c(col), sep)


def join_tokens(arr, sep: str = " ") -> Column:
    return F.array_join(_c(arr), sep)


def token_count(col, sentinel: str = SENTINEL) -> Column:
    """-1 for the missing marker, else the number of blank-separated tokens."""
    c = _c(col)
    return F.when(c == F.lit(sentinel), F.lit(-1)).otherwise(F.size(tokens(c))).cast("bigint")


def replace_token(col, token: str, replacement: str = OTHER) -> Column:
    """Whole-token replace of one id; the sentinel is never touched (no regex, so
    cutting ``1`` cannot damage ``-1``)."""
    c = _c(col)
    return F.when(c.isNull(), c).otherwise(
        join_tokens(F.transform(tokens(c), lambda t: F.when(t == F.lit(token), F.lit(replacement)).otherwise(t))))


def replace_token_set(col, token_set: list[str], replacement: str = OTHER) -> Column:
    """Replace every token found in a small literal set. For sets that grow with the
    data use :func:`ctrkit.operators.tokens.cut_tokens` (join based)."""
    c = _c(col)
    lit_set = F.array(*[F.lit(t) for t in token_set]) if token_set else F.array().cast("array<string>")
    return F.when(c.isNull(), c).otherwise(
        join_tokens(F.transform(tokens(c), lambda t: F.when(F.array_contains(lit_set, t), F.lit(replacement)).otherwise(t))))


# Fixed value: the word pattern of the default text tokenizer (two or more word characters).
WORD_PATTERN = r"\b\w\w+\b"


def word_tokens(col) -> Column:
    """Lower-cased words of two or more characters; ``-1`` yields no token."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD_PATTERN), 0)
