"""Helpers for operators that run Python over Arrow batches.

An operator is a narrow column expression: ``with_struct`` evaluates one iterator UDF over the text
column and spreads the fields of its result, so that all other columns stay in the JVM and no join
is needed afterwards. Texts cross as bytes, so that invalid UTF-8 is replaced and never raised.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a batch that are held as Python objects at a time.
SLICE_ROWS = 256
#: Bytes of an Arrow batch between the JVM and a worker: rows of long texts come in smaller batches.
BATCH_BYTES = 4 << 20


def slices(arr: pa.Array, rows: int = SLICE_ROWS) -> Iterator[pa.Array]:
    """Pieces of an Arrow array with at most ``rows`` rows."""
    for at in range(0, len(arr), rows):
        yield arr.slice(at, rows)


def raw(arr: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string array, null as None."""
    return arr.cast(pa.binary()).to_pylist()


def texts(arr: pa.Array) -> list[str]:
    """Texts of a string array; null is the empty text, broken UTF-8 becomes U+FFFD."""
    return [b.decode("utf-8", "replace") if b else "" for b in raw(arr)]


def release() -> None:
    """Gives memory that is free back to the system; workers outlive tasks, and other operators run in them next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of a session, and with them the memory of workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def with_struct(df: DataFrame, value: Column, fields: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the fields {new name: field of the struct column ``value``}.

    Columns of ``df`` whose names equal a new name (without regard to case) are replaced.
    """
    gone = {name.lower() for name in (*fields, *drop)}
    tmp = "__pithy_struct"
    small_batches(df.sparkSession)
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in gone and c != tmp]
    step = df.select(*kept, value.alias(tmp))
    return step.select(*kept, *[F.col(f"{tmp}.{field}").alias(name) for name, field in fields.items()])


def map_slices(fn: Callable[[pa.Array], pa.Array], returns: T.DataType, init: Callable[[], object] | None = None, rows: int = SLICE_ROWS, once: bool = False) -> Callable[[Column], Column]:
    """An iterator Arrow UDF that applies ``fn(slice[, state])`` to slices of each batch, of at most ``rows`` rows.

    ``init`` builds the per-task state (a model, an automaton); it runs in the worker. ``once``: see ``evaluated_once``.
    """

    def run(batches):
        state = init() if init else None
        for batch in batches:
            out = [fn(part, state) if init else fn(part) for part in slices(batch, rows)]
            yield pa.concat_arrays(out) if out else pa.array([], type=_arrow(returns))
        del state
        release()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    made = F.arrow_udf(run, returns)
    return evaluated_once(made) if once else made


def evaluated_once(made):
    """A UDF whose result may be filtered by a part of it: else the optimizer copies the call into the filter, and each task evaluates it twice in two workers."""
    return made.asNondeterministic()


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def struct_type(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def struct_array(kind: T.StructType, *columns) -> pa.Array:
    """A struct array of lists or Arrow arrays, in the order of the fields of ``kind``."""
    want = _arrow(kind)
    made = [c if isinstance(c, pa.Array) and c.type == want.field(i).type else (c.cast(want.field(i).type) if isinstance(c, pa.Array) else pa.array(c, type=want.field(i).type)) for i, c in enumerate(columns)]
    return pa.StructArray.from_arrays(made, fields=list(want))


def text_column(df: DataFrame, name: str) -> Column:
    """The text column, cast to string if it has another type."""
    kind = df.schema[name].dataType
    col = F.col(f"`{name}`")
    return col if isinstance(kind, T.StringType) else col.cast("string")
