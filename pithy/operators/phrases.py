"""Repeated phrasing within a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pithy.functions import text as X
from pithy.operators.fold import text_fold, without_repeats


def remove_repeats(df: DataFrame, text: str, details: str, threshold: float = 0.9, min_length: int = 20, window: int = 64) -> DataFrame:
    """Phrases of ``min_length`` characters or more that equal any kept one, or resemble one of the last ``window`` kept, go."""
    df = text_fold(df, text, "__n", lambda t: without_repeats(t, threshold, min_length, window))
    return df.withColumn(details, F.when(F.col(text).isNotNull(), F.create_map(F.lit("phrases_removed"), F.col("__n")))).drop("__n")


def explode_phrases(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, pos, spos, phrase, norm) of each phrase of each line that isn't blank."""
    by_line = df.select(id_col, F.posexplode(X.lines(F.col(text))).alias("pos", "line")).where(~X.is_blank(F.col("line")))
    each = by_line.select(id_col, "pos", F.posexplode(X.phrases(F.col("line"))).alias("spos", "phrase"))
    return each.withColumn("norm", X.normalized(F.col("phrase")))


def candidate_pairs(df: DataFrame, id_col: str, text: str, threshold: float = 0.9, min_length: int = 20) -> DataFrame:
    """Pairs of distinct normalised phrases of a document that pass the length gate and the word gate.

    An inverted index: phrases meet only on a common word of the same document. Of two phrases with a
    Jaccard similarity of g, the rarer common words suffice, so only the first words of each phrase in
    a fixed order (its prefix of size n - ceil(g n) + 1) are indexed; no pair is lost.
    """
    gate = max(0.0, 2 * threshold - 1)
    norms = explode_phrases(df, id_col, text).where(F.length("norm") >= min_length).select(id_col, "norm").distinct()
    bags = norms.withColumn("w", F.array_sort(F.array_distinct(F.split("norm", " ")))).withColumn("keep", F.size("w") - F.ceil(F.lit(gate) * F.size("w") - F.lit(1e-9)).cast("int") + 1)
    index = bags.select(id_col, "norm", "w", F.explode(F.slice("w", F.lit(1), F.least(F.greatest("keep", F.lit(1)), F.size("w")))).alias("word"))
    a, b = index.alias("a"), index.alias("b")
    met = a.join(b, (F.col(f"a.{id_col}") == F.col(f"b.{id_col}")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.norm") < F.col("b.norm")))
    la, lb = F.length("a.norm"), F.length("b.norm")
    near = F.abs(la - lb) / F.greatest(la, lb) <= F.lit(1.0 - threshold)
    alike = F.size(F.array_intersect("a.w", "b.w")) / F.size(F.array_union("a.w", "b.w")) >= F.lit(gate)
    return met.where(near & alike).select(F.col(f"a.{id_col}").alias(id_col), F.col("a.norm").alias("first"), F.col("b.norm").alias("second")).distinct()
