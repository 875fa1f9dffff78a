"""Noise lines: a line goes with the label of the first rule that matches; runs of blank lines become one.

One narrow projection, linear in the lines: each line is labelled once, by a CASE over literal
patterns (compiled once per task). Computed arrays are only ever *arguments* of higher-order
functions, never looked up in the body of one: the optimizer puts the expression of a column that is
used once in its place, and in a body it would be evaluated anew for each line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pithy.config import NoiseConfig
from pithy.functions import patterns as P
from pithy.functions import text as X

BLANK = "blank_line"
#: The code of a blank line before it is known what precedes it; no line and no label can be this.
_EMPTY = "\n"


def rules(config: NoiseConfig) -> list[tuple[str, str]]:
    """(label, Java pattern) of the rules that are on, in order."""
    on = [(label, P.java(p, fold)) for label, key, fold, p in P.NOISE if getattr(config, key)]
    return on + [(label, P.from_user(p)) for p, label in config.extra_patterns]


def label_of(line: Column, config: NoiseConfig) -> Column:
    """The label of a line that isn't blank, or null."""
    out = None
    for label, pattern in rules(config):
        out = F.when(line.rlike(pattern), label) if out is None else out.when(line.rlike(pattern), label)
    return F.lit(None).cast("string") if out is None else out


def coded(lines: str, codes: str, config: NoiseConfig) -> Column:
    """An array of (line, why it goes or null) of the columns ``lines`` and ``codes``; codes are labels, or _EMPTY for a blank line."""
    again = (lambda code, before: (code == _EMPTY) & (before == _EMPTY)) if config.collapse_blank_lines else (lambda code, before: F.lit(False))
    why = F.zip_with(codes, F.concat(F.array(F.lit("start")), F.col(codes)), lambda code, before: F.when(again(code, before), BLANK).when(code != _EMPTY, code))
    return F.filter(F.zip_with(lines, why, lambda line, w: F.struct(line.alias("line"), w.alias("why"))), lambda x: x["line"].isNotNull())


def with_labels(df: DataFrame, text: str, config: NoiseConfig) -> DataFrame:
    """``df`` with ``__coded``: (line, why) of each line, where why is the label with which it goes, or null."""
    step = df.withColumn("__lines", X.lines(F.col(text)))
    step = step.withColumn("__codes", F.transform("__lines", lambda x: F.when(X.is_blank(x), _EMPTY).otherwise(label_of(x, config))))
    return step.withColumn("__coded", coded("__lines", "__codes", config)).drop("__lines", "__codes")


def _counts(labels: list[str]) -> Column:
    """A map of each label that occurs to its number, by one walk over ``__coded``."""
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in range(len(labels))])
    step = lambda acc, x: F.struct(*[(acc[f"c{k}"] + F.when(x["why"] == label, 1).otherwise(0)).alias(f"c{k}") for k, label in enumerate(labels)])
    done = lambda acc: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(label).alias("key"), acc[f"c{k}"].alias("value")) for k, label in enumerate(labels)]), lambda e: e["value"] > 0))
    return F.aggregate("__coded", zero, step, done)


def filter_noise(df: DataFrame, text: str, details: str, config: NoiseConfig | None = None) -> DataFrame:
    """``text`` without noise; ``details`` maps each label that occurred to its count (read it by ``explode_outer``: plain ``explode`` makes the optimizer evaluate it twice)."""
    config = config or NoiseConfig()
    step = with_labels(df, text, config)
    labels = list(dict.fromkeys([label for label, _ in rules(config)] + [BLANK]))
    kept = F.transform(F.filter("__coded", lambda x: x["why"].isNull()), lambda x: x["line"])
    return step.withColumn(details, F.when(F.col(text).isNotNull(), _counts(labels))).withColumn(text, X.unlines(kept)).drop("__coded")
