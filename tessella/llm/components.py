"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join, so a vertex with many neighbours is spread by Spark's own
handling of skewed joins, and nothing is gathered on the driver but one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("root"))
    return both.filter("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("root").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("root"))
    moved = edges.join(least, "hi").filter("lo <> root").select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("root").alias("lo"))).distinct()


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node that an edge touches and that is not itself the least of its component.

    Nulls and loops are ignored; repeated edges count once; without edges the result is empty.
    """
    a, b = F.col(left), F.col(right)
    now = settle(edges.filter(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    seen = _checksum(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = settle(_small_star(_large_star(now)))
        before, seen = seen, _checksum(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
