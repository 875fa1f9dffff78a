"""Compression of streams. Every stage is narrow, so the batch plan is the streaming plan; nothing is kept between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pithy.config import CompressionConfig
from pithy.plans.compress import compress


def compress_stream(stream: DataFrame, text_col: str = "text", config: CompressionConfig | None = None) -> DataFrame:
    """A streaming DataFrame with ``compressed`` and ``stats``."""
    return compress(stream, text_col, config)


def write_stream(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Starts writing everything that is there now and stops."""
    return stream.writeStream.format(fmt).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
