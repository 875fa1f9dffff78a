"""Duplicate lines within a document.

Exact duplicates stay in the JVM and in the row: stripped lines are sorted with their positions,
the first of each group is kept with the size of its group, and the order is restored. Near
duplicates depend on what was kept before, so they are folded in an Arrow function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pithy.config import RedundancyConfig
from pithy.functions import text as X
from pithy.operators.fold import near_lines, text_fold


def drop_exact(df: DataFrame, text: str, count: str, annotate: bool = True) -> DataFrame:
    """Repeated lines (equal when stripped) go; the first one tells how often it came. Blank lines become empty."""
    step = df.withColumn("__lines", X.lines(F.col(text)))
    # sorted by stripped line, then place; neighbours are put side by side by a shifted copy
    step = step.withColumn("__s", F.sort_array(F.transform("__lines", lambda x, i: F.struct(X.strip(x).alias("k"), i.alias("p"), x.alias("line")))))
    keys = F.concat(F.array(F.lit(None).cast("string")), F.transform("__s", lambda x: x["k"]))
    opens = lambda x, before: x["k"].isNotNull() & ((x["k"] == "") | ~x["k"].eqNullSafe(before))
    step = step.withColumn("__o", F.zip_with("__s", keys, lambda x, before: F.struct(x.alias("x"), opens(x, before).alias("first"))))
    step = step.withColumn("__f", F.filter(F.transform("__o", lambda x, i: F.struct(x["x"].alias("x"), x["first"].alias("first"), i.alias("i"))), lambda x: x["first"]))
    ends = F.concat(F.transform(F.slice("__f", F.lit(2), F.size("__f")), lambda x: x["i"]), F.array(F.size("__s")))
    marker = lambda k: k.startswith("__blank__")  # noqa: E731  a key of this form is printed as an empty line
    plain = lambda x: (x["k"] == "") | marker(x["k"])
    group = lambda x, end: F.struct(x["x"]["p"].alias("p"), F.when(plain(x["x"]), "").otherwise(x["x"]["line"]).alias("line"), F.when(plain(x["x"]), 1).otherwise(end - x["i"]).alias("n"))
    step = step.withColumn("__g", F.sort_array(F.zip_with("__f", ends, group)))
    out = lambda x: F.when(x["n"] > 1, F.concat(x["line"], F.lit("  [x"), x["n"].cast("string"), F.lit("]"))).otherwise(x["line"]) if annotate else x["line"]
    gone = F.aggregate("__g", F.lit(0).cast("long"), lambda a, x: a + x["n"] - 1)
    step = step.withColumn(count, F.when(F.col(text).isNotNull(), gone))
    return step.withColumn(text, X.unlines(F.transform("__g", out))).drop("__lines", "__s", "__o", "__f", "__g")


def drop_near(df: DataFrame, text: str, count: str, threshold: float = 0.92, min_length: int = 12) -> DataFrame:
    """Lines that resemble an earlier kept line go."""
    return text_fold(df, text, count, lambda t: near_lines(t, threshold, min_length))


def filter_redundancy(df: DataFrame, text: str, details: str, config: RedundancyConfig | None = None) -> DataFrame:
    """Exact, then near duplicates; ``details`` has a count of each."""
    config = config or RedundancyConfig()
    zero = F.lit(0).cast("long")
    df = drop_exact(df, text, "__exact", config.annotate_duplicate_counts) if config.drop_exact_duplicates else df.withColumn("__exact", zero)
    df = drop_near(df, text, "__near", config.similarity_threshold, config.min_line_length_for_fuzzy) if config.near_duplicate else df.withColumn("__near", zero)
    counts = F.create_map(F.lit("exact_removed"), F.col("__exact"), F.lit("near_removed"), F.col("__near"))
    return df.withColumn(details, F.when(F.col(text).isNotNull(), counts)).drop("__exact", "__near")
