"""The compressor: stages in a fixed order over each document, with a report of each.

``noise`` -> ``detail_trim`` -> ``pattern`` -> ``redundancy``, and ``extractive`` where a target is
set and missed. Every stage is narrow: the whole plan is one scan without a shuffle, whatever the
size of the corpus, and runs on streams as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pithy.config import CompressionConfig
from pithy.functions.counters import TokenCounter
from pithy.operators import dedup, findings, jsonshape, noise, phrases, rank, trim
from pithy.operators.fold import small_batches

Stage = tuple[str, Callable[[DataFrame, str, str], DataFrame]]
_REPORT = "array<struct<name:string,chars_before:int,chars_after:int,chars_removed:int,details:map<string,bigint>>>"


def stages(config: CompressionConfig) -> list[Stage]:
    """(name, stage(df, text column, details column)) of the stages that are on."""
    all_ = (
        (config.enable_noise_filter, "noise", lambda df, t, d: noise.filter_noise(df, t, d, config.noise)),
        (config.enable_detail_trim, "detail_trim", lambda df, t, d: trim.trim_detail(df, t, d, config.trim)),
        (config.enable_pattern_remover, "pattern", phrases.remove_repeats),
        (config.enable_redundancy_filter, "redundancy", lambda df, t, d: dedup.filter_redundancy(df, t, d, config.redundancy)),
    )
    return [(name, fn) for on, name, fn in all_ if on]


def compress(df: DataFrame, text_col: str = "text", config: CompressionConfig | None = None, counter: TokenCounter | None = None, extra_stages: list[Stage] | None = None, out: str = "compressed", stats: str = "stats") -> DataFrame:
    """``df`` with ``out`` (the compressed text) and ``stats``; null texts stay null."""
    config = config or CompressionConfig()
    count = counter or TokenCounter(config.model, config.token_backend)
    small_batches(df)
    t = "__t"
    step = df.drop(out, stats).withColumn(t, F.col(f"`{text_col}`").cast("string"))
    step = step.withColumn("__chars", F.length(t)).withColumn("__tokens", count(F.col(t)))
    reports = []

    def report(name: str, before: str, after: str, details: str):
        return F.struct(F.lit(name).alias("name"), F.col(before).alias("chars_before"), F.col(after).alias("chars_after"), (F.col(before) - F.col(after)).alias("chars_removed"), F.col(details).alias("details"))

    last = "__chars"
    for k, (name, stage) in enumerate([*stages(config), *(extra_stages or [])]):
        step = stage(step, t, f"__d{k}").withColumn(f"__c{k}", F.length(t))
        reports.append(report(name, last, f"__c{k}", f"__d{k}"))
        last = f"__c{k}"
    step = step.withColumn("__now", count(F.col(t)))
    if config.target_ratio is not None:
        goal, whole = F.lit(float(config.target_ratio)), F.when(F.col("__tokens") == 0, 1).otherwise(F.col("__tokens"))
        ratio = F.greatest(F.lit(0.1), goal * whole / F.greatest("__now", F.lit(1)))
        step = step.withColumn("__ratio", F.when(F.col("__now") / whole > goal, ratio))
        step = rank.summarize(step, t, F.col("__ratio")).withColumn("__end", F.length(t)).withColumn("__now", count(F.col(t)))
        step = step.withColumn("__dx", F.create_map(F.lit("applied"), F.lit(1).cast("long")))
        tail = F.when(F.col("__ratio").isNotNull(), F.array(report("extractive", last, "__end", "__dx"))).otherwise(F.array().cast(_REPORT))
        listed = F.concat(F.array(*reports).cast(_REPORT), tail.cast(_REPORT)) if reports else tail.cast(_REPORT)
        last = "__end"
    else:
        listed = F.array(*reports).cast(_REPORT)
    ratio_of = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(F.col(a) / F.col(b))
    made = F.struct(
        F.col("__chars").alias("original_chars"),
        F.col(last).alias("compressed_chars"),
        F.col("__tokens").alias("original_tokens"),
        F.col("__now").alias("compressed_tokens"),
        F.lit(count.backend).alias("token_backend"),
        listed.alias("stages"),
        ratio_of(last, "__chars").alias("char_ratio"),
        ratio_of("__now", "__tokens").alias("token_ratio"),
        (F.col("__tokens") - F.col("__now")).alias("tokens_saved"),
        ((1.0 - ratio_of("__now", "__tokens")) * 100.0).alias("reduction_pct"),
    )
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (out, stats)]
    return step.select(*kept, F.col(t).alias(out), F.when(F.col(t).isNotNull(), made).alias(stats))


def summary(stats: str = "stats"):
    """A column with one line of metrics."""
    s = lambda c: F.col(f"{stats}.{c}")
    return F.format_string("%d -> %d tokens (%.1f%% smaller, backend=%s)", s("original_tokens"), s("compressed_tokens"), s("reduction_pct"), s("token_backend"))


def compress_text(df: DataFrame, text_col: str = "text", config: CompressionConfig | None = None, out: str = "compressed") -> DataFrame:
    """``compress`` without stats."""
    return compress(df, text_col, config, out=out, stats="__stats").drop("__stats")


def compress_json(df: DataFrame, text_col: str = "text", config: CompressionConfig | None = None) -> DataFrame:
    """Reshape JSON, then compress; stats are those of the reshaped text. Other text is compressed as it is."""
    config = config or CompressionConfig()
    step = jsonshape.reshape(df.withColumn("__json", F.col(f"`{text_col}`")), "__json", "json_ok", config.trim)
    return compress(step, "__json", config).drop("__json")


def compress_scan(df: DataFrame, text_col: str = "text", examples: int = 5, out: str = "compressed") -> DataFrame:
    """The brief of raw scanner output; no other stage is applied."""
    return findings.brief(df.withColumn(out, F.col(f"`{text_col}`")), out, examples)
