"""Connected components by alternating large-star and small-star steps.

Every step is a distributed aggregation and a join; no link or label reaches the
driver.  A hub with very many links is aggregated before the shuffle, and its links are
dealt over tasks in the joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, join_split


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def _large(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return join_split(both.where("v > u"), least, "u", "v", n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = join_split(down, least, "u", "v", n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b long): component is the smallest id reachable.

    Nulls and self-links are ignored.  An empty input gives an empty table.  Raises if
    ``most`` rounds do not suffice (the rounds grow with the logarithm of the longest chain).
    """
    now = scratch.keep(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = _state(now)
    for _ in range(most):
        after = scratch.keep(_small(_large(now, state[0]), state[0]), "stars")
        scratch.drop(now)
        now, before, state = after, state, _state(after)
        if state == before:
            roots = now.select(F.col("v").alias("id")).distinct()
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
    raise RuntimeError("components did not settle")
