"""Column functions on texts, with the semantics of Python strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pithy.functions import patterns as P


def strip(text: Column) -> Column:
    """Without white space at both ends (all of Unicode's, which trim() doesn't know by itself)."""
    return F.btrim(text, F.lit(P.SPACES))


def is_blank(line: Column) -> Column:
    return line.rlike(P.java(rf"\A{P.WS}*\z"))


def lines(text: Column) -> Column:
    """Lines between \\n, the empty last one kept."""
    return F.split(text, "\n", -1)


def unlines(arr: Column) -> Column:
    return F.array_join(arr, "\n")


def universal_newlines(text: Column) -> Column:
    """\\r\\n and \\r become \\n, as files in text mode give them."""
    return F.regexp_replace(text, "\r\n?", "\n")


def tokens(text: Column) -> Column:
    """Tokens by the heuristic: a quarter of each word's length, rounded up, and one for each symbol."""
    return F.regexp_count(text, F.lit(P.TOKEN)).cast("long")


def phrases(line: Column) -> Column:
    """Sentences of a line; pieces are not stripped and the empty last one is kept."""
    return F.split(line, rf"(?<={P.STOP}){P.WS}+", -1)


def normalized(phrase: Column) -> Column:
    """Stripped, lower-cased, white space squeezed."""
    return F.regexp_replace(F.lower(strip(phrase)), f"{P.WS}+", " ")
