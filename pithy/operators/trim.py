"""Long detail: log prefixes, runs of table rows, quoted literals. Narrow projections, all in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pithy.config import TrimConfig
from pithy.functions import patterns as P
from pithy.functions import text as X


def strip_log_prefix(df: DataFrame, text: str, count: str) -> DataFrame:
    """Leading time stamp, process and thread ids go from each line; ``count`` lines changed."""
    step = df.withColumn("__lines", X.lines(F.col(text))).withColumn("__new", F.transform("__lines", lambda x: F.regexp_replace(x, P.java(P.LOG_PREFIX, True), "")))
    changed = F.size(F.filter(F.zip_with("__lines", "__new", lambda a, b: a != b), lambda x: x)).cast("long")
    step = step.withColumn(count, F.when(F.col(text).isNotNull(), changed))
    return step.withColumn(text, X.unlines(F.col("__new"))).drop("__lines", "__new")


def trim_tables(df: DataFrame, text: str, count: str, max_rows: int) -> DataFrame:
    """Runs of more than ``max_rows`` table rows keep their head and a line that tells how many went.

    Runs are found between the lines that aren't rows: each such line, and a first one before the
    text, is followed by a run up to the next one. From the runs' lengths each line gets a mark (0: it
    stays, -1: it goes, more: it becomes the note on so many rows), and marks meet lines by place.
    """
    step = df.withColumn("__lines", X.lines(F.col(text)))
    marked = F.transform("__lines", lambda x, i: F.when(~x.rlike(P.java(P.TABLE_ROW)), i))
    step = step.withColumn("__at", F.concat(F.array(F.lit(-1)), F.filter(marked, lambda i: i.isNotNull())))
    ends = F.concat(F.slice("__at", F.lit(2), F.size("__at")), F.array(F.size("__lines")))
    runs = F.zip_with("__at", ends, lambda at, end: F.struct(at.alias("at"), (end - at - 1).alias("size")))

    def marks(run):
        own, hidden = F.when(run["at"] >= 0, 1).otherwise(0), run["size"] - max_rows
        tail = F.when(hidden > 0, F.concat(F.array_repeat(F.lit(-1), hidden - 1), F.array(hidden))).otherwise(F.array().cast("array<int>"))
        return F.concat(F.array_repeat(F.lit(0), own + F.least(run["size"], F.lit(max_rows))), tail)

    step = step.withColumn("__marks", F.flatten(F.transform(runs, marks)))
    note = lambda k: F.concat(F.lit("… (+"), k.cast("string"), F.lit(" more rows)"))
    out = F.zip_with("__lines", "__marks", lambda x, k: F.when(k == 0, x).when(k > 0, note(k)))
    hidden = F.aggregate("__marks", F.lit(0).cast("long"), lambda a, k: a + F.greatest(k, F.lit(0)))
    step = step.withColumn(count, F.when(F.col(text).isNotNull(), hidden))
    return step.withColumn(text, X.unlines(F.filter(out, lambda x: x.isNotNull()))).drop("__lines", "__at", "__marks")


def trim_literals(df: DataFrame, text: str, count: str, limit: int, keep: int) -> DataFrame:
    """Quoted literals of more than ``limit`` characters keep ``keep`` and tell how many went; they may span lines."""
    pattern = P.java(P.LITERAL)
    step = df.withColumn("__found", F.regexp_extract_all(F.col(text), F.lit(pattern), 0)).withColumn("__rest", F.split(F.col(text), pattern, -1))

    def short(x):
        inner = F.length(x) - 2
        cut = F.concat(F.lit('"'), F.substring(x, F.lit(2), F.least(inner, F.lit(keep))), F.lit("… [+"), (inner - keep).cast("string"), F.lit(' chars]"'))
        return F.when(inner > limit, cut).otherwise(x)

    step = step.withColumn("__short", F.transform("__found", short))
    joined = F.array_join(F.zip_with("__rest", "__short", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    long = F.size(F.filter("__found", lambda x: F.length(x) - 2 > limit)).cast("long")
    step = step.withColumn(count, F.when(F.col(text).isNotNull(), long))
    return step.withColumn(text, joined).drop("__found", "__rest", "__short")


def trim_detail(df: DataFrame, text: str, details: str, config: TrimConfig | None = None) -> DataFrame:
    """All three in order; ``details`` has a count of each."""
    config = config or TrimConfig()
    counts = []
    if config.strip_log_metadata:
        df = strip_log_prefix(df, text, "__log")
        counts += [F.lit("log_meta_stripped"), F.col("__log")]
    df = trim_tables(df, text, "__tab", config.max_table_rows)
    df = trim_literals(df, text, "__str", config.max_string_length, config.keep_string_prefix)
    counts += [F.lit("table_rows_trimmed"), F.col("__tab"), F.lit("strings_trimmed"), F.col("__str")]
    return df.withColumn(details, F.when(F.col(text).isNotNull(), F.create_map(*counts))).drop("__log", "__tab", "__str")
