"""Connected components of links between any keys that can be ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.plans.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """(key, cluster) of the nodes on ``edges`` (key, other): the least key of each connected component, found in rounds.

    In a round each node's greater neighbours, then its lesser ones, are tied to the least of all; no tie
    between components is made or lost, and the rounds end when each component is a star about its least key.
    """
    e = cut(edges.select(F.least("key", "other").alias("lo"), F.greatest("key", "other").alias("hi")).where("lo < hi").distinct())
    while True:
        both = e.select(F.col("lo").alias("key"), F.col("hi").alias("other")).unionByName(e.select(F.col("hi").alias("key"), F.col("lo").alias("other")))
        least = both.groupBy("key").agg(F.least("key", F.min("other")).alias("least"))
        up = both.where("other > key").join(least, "key").select(F.col("least").alias("lo"), F.col("other").alias("hi")).distinct()
        least = up.groupBy("hi").agg(F.min("lo").alias("least"))
        down = up.join(least, "hi").where("lo > least").select(F.col("least").alias("lo"), F.col("lo").alias("hi"))
        e = cut(down.unionByName(least.select(F.col("least").alias("lo"), "hi")).distinct())
        ends = e.select(F.col("hi").alias("key"), F.lit(1).alias("n"), F.lit(0).alias("m")).unionByName(e.select(F.col("lo").alias("key"), F.lit(0).alias("n"), F.lit(1).alias("m")))
        if ends.groupBy("key").agg(F.sum("n").alias("n"), F.max("m").alias("m")).where("n + m > 1").isEmpty():
            return e.select(F.col("hi").alias("key"), F.col("lo").alias("cluster"))
