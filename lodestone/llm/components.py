"""Connected components by alternating large-star and small-star steps.

Every step is a minimum per node (combined before the shuffle) and an equi-join, which Spark splits where a node has a
large share of the links. The links are written to the shared folder after each round; nothing is gathered on the driver
but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Stages


def _hang(pairs: DataFrame, only_smaller: bool) -> DataFrame:
    """For each node u of pairs (u, v) the links from its neighbours, and itself, to the least of all."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = pairs.join(least, "u")
    if only_smaller:
        out = linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = linked.where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u != v").distinct()


def connected_components(links: DataFrame, stages: Stages, name: str) -> DataFrame:
    """Columns id and component (the least id reachable) of each id in links (a, b); ids without links don't appear."""
    now = stages.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{name}-0")
    seen, turn = None, 0
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: larger neighbours hang on the least; all links then point downwards.
        large = stages.write(_hang(both, only_smaller=False), f"{name}-{turn}-large")
        stages.drop(f"{name}-{turn}")
        turn += 1
        now = stages.write(_hang(large, only_smaller=True), f"{name}-{turn}")
        stages.drop(f"{name}-{turn - 1}-large")
