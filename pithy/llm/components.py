"""Connected components by label passing over tables in the shared folder.

Each round every node takes the smallest label among its own and its neighbours', then the label of
that label (pointer jumping). Every join has a table on either side, so hot nodes are split by
adaptive execution; minima are combined before the shuffle; each round's labels are a written table,
which cuts the lineage, and the round before is removed. Labels only ever fall, so the rounds end, after
about as many as the longest path has digits. Nothing of the graph comes to the driver but one row per round.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pithy.llm.tables import dropped, written


def connected(edges: DataFrame, folder: str) -> DataFrame:
    """(id, comp) for every node of the edges (a, b): comp is the smallest id that is reachable."""
    spark = edges.sparkSession
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v"), f"{folder}/both")
    labels = written(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("comp")), f"{folder}/labels0")
    for turn in count(1):
        near = both.join(labels.select(F.col("id").alias("v"), "comp"), "v").groupBy(F.col("u").alias("id")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "id").select("id", F.least("comp", "near").alias("next"), F.col("comp").alias("was"))
        step = written(step, f"{folder}/step{turn}")
        up = labels.select(F.col("id").alias("next"), F.col("comp").alias("root"))
        new = written(step.join(up, "next", "left").select("id", F.least("next", "root").alias("comp"), (F.least("next", "root") < F.col("was")).alias("moved")), f"{folder}/labels{turn}")
        labels = new.select("id", "comp")
        dropped(spark, f"{folder}/step{turn}", f"{folder}/labels{turn - 1}")
        if not new.where("moved").limit(1).count():
            dropped(spark, f"{folder}/both")
            return labels
    raise AssertionError
