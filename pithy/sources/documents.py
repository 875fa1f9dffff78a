"""Documents from files, memory and frameworks, and back."""

from __future__ import annotations

import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pithy.config import CompressionConfig
from pithy.functions import text as X
from pithy.plans.compress import compress, compress_text


def from_strings(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    """(doc_id, text) of strings at hand."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files: UTF-8 with broken bytes replaced, and universal newlines."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", X.universal_newlines(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))


def from_stdin(spark: SparkSession) -> DataFrame:
    return from_strings(spark, [sys.stdin.read()])


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a machine's own temporary folder only where all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return base or f"file://{tempfile.gettempdir()}/pithy-shared"


def write_text(df: DataFrame, path: str, text_col: str = "compressed", id_col: str = "doc_id") -> None:
    """Texts as text files in one folder for each document; a text without a last line end gets one."""
    ended = F.when(F.col(text_col).endswith("\n"), F.left(text_col, F.length(text_col) - 1)).otherwise(F.col(text_col))
    df.select(id_col, ended.alias("value")).write.partitionBy(id_col).text(path)


def compress_documents(df: DataFrame, text_col: str = "text", config: CompressionConfig | None = None, record_stats: bool = True) -> DataFrame:
    """Texts replaced by their compressed form; other columns stay, and ``compression`` tells tokens before and after.

    Where there is a ``metadata`` map of strings, the same goes into it under "compression" as JSON, beside what it holds.
    """
    done = compress(df, text_col, config, out="__new", stats="__stats")
    held = dict(df.dtypes).get("metadata") == "map<string,string>" and text_col != "metadata" and record_stats
    note = F.struct(F.col("__stats.original_tokens").alias("original_tokens"), F.col("__stats.compressed_tokens").alias("compressed_tokens"), F.bround("__stats.reduction_pct", 1).alias("reduction_pct"))
    older = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: k != "compression") if held else None
    merged = F.when(F.col("__stats").isNull(), F.col("metadata")).otherwise(F.map_concat(older, F.create_map(F.lit("compression"), F.to_json(note)))).alias("metadata") if held else None
    kept = [F.col("__new").alias(c) if c == text_col else merged if held and c == "metadata" else F.col(f"`{c}`") for c in df.columns if c != "compression" or not record_stats]
    return done.select(*kept, *([F.when(F.col("__stats").isNotNull(), note).alias("compression")] if record_stats else []))


def compress_nodes(df: DataFrame, text_col: str = "text", config: CompressionConfig | None = None) -> DataFrame:
    """Texts replaced, nothing else; plain strings are compressed too."""
    done = compress_text(df, text_col, config, out="__new")
    return done.select(*[F.col("__new").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
