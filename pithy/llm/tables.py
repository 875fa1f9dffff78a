"""Tables of the test data and the shared folder of a cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the place that driver and executors share, spark.checkpoint.dir.

    Without it there is none: a local folder would silently lose tables with an executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import os
        import tempfile

        base = "file://" + os.path.join(tempfile.gettempdir(), "pithy-shared")  # one machine: all tasks run in this process
    return f"{base.rstrip('/')}/pithy-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read back: the lineage is cut by a table that all executors share."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Removes spent tables; only those that nothing reads any more, as what was made of them is written."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Classes with more than this part of all rows are hot; there are at most as many as its inverse.
HOT_PART, HOT_LEAST = 1 / 2000, 200


def with_class(rows: DataFrame, classes: DataFrame, keys: list[str], size_col: str) -> DataFrame:
    """``rows`` left-joined with ``classes`` (one row per key, with the number of its rows in ``size_col``).

    A class of very many rows would meet in one task. Hot classes, at most 1 / HOT_PART of them
    whatever the table, are broadcast; all others are joined by key and are small.
    """
    total = rows.count()
    most = max(HOT_LEAST, int(total * HOT_PART))
    hot = classes.where(F.col(size_col) > most).withColumn("__hot", F.lit(True))
    cold = classes.where(F.col(size_col) <= most)
    mine = [c for c in classes.columns if c not in keys and c != size_col]
    step = rows.join(F.broadcast(hot.drop(size_col)), keys, "left")
    many = step.where("__hot").drop("__hot")
    few = step.where("__hot is null").drop("__hot", *mine).join(cold.drop(size_col), keys, "left")
    return many.unionByName(few)
