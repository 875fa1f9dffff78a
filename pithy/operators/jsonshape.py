"""JSON reshaped under caps on depth, list length and string length. Any structure, so an Arrow function."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pithy.config import TrimConfig
from pithy.operators.fold import arrow_text, small_batches


def capped(value, depth: int, config: TrimConfig):
    """A value under the caps; below the last level containers become a note and scalars stay."""
    if isinstance(value, (dict, list)) and depth <= 0:
        return f"{{… {len(value)} keys}}" if isinstance(value, dict) else f"[… {len(value)} items]"
    if isinstance(value, dict):
        return {key: capped(item, depth - 1, config) for key, item in value.items()}
    if isinstance(value, list):
        rest = len(value) - config.max_list_items
        note = [f"… (+{rest} more items)"] if rest > 0 else []
        return [capped(item, depth - 1, config) for item in value[: config.max_list_items]] + note
    if isinstance(value, str) and depth > 0 and len(value) > config.max_string_length:
        return f"{value[: config.keep_string_prefix]}… [+{len(value) - config.keep_string_prefix} chars]"
    return value


def reshape_text(text: str, config: TrimConfig) -> tuple[str, bool]:
    """Indented JSON under the caps and True, or the text itself and False if it isn't JSON (or nested too deep to read)."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return text, False
    return json.dumps(capped(value, config.max_json_depth, config), ensure_ascii=False, indent=2), True


def reshape(df: DataFrame, text: str, ok: str, config: TrimConfig | None = None) -> DataFrame:
    """``text`` reshaped where it is JSON; ``ok`` tells where."""
    config = config or TrimConfig()
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("ok", T.BooleanType())])
    arrow = pa.struct([("text", pa.string()), ("ok", pa.bool_())])
    udf = arrow_text(lambda t: dict(zip(("text", "ok"), reshape_text(t, config), strict=True)), kind, arrow)
    small_batches(df)
    step = df.withColumn("__j", udf(F.col(text)))
    return step.withColumn(ok, F.col("__j.ok")).withColumn(text, F.col("__j.text")).drop("__j")
