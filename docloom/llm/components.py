"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link neighbours to the least of them. ``edges``: u > v, or both directions for the large star."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    hub = both.join(least.withColumn("m", F.least("m", "u")), "u")
    if small:
        linked = hub.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    else:
        linked = hub.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.filter("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v) -> one row (node, component) per node that has an edge; component is the least node.

    Self-loops and repeated edges are ignored; null ends are dropped; no edges give no rows. Every
    round is checkpointed, so plans stay short and a lost executor costs one round at most. The
    rounds end when the edge table no longer changes, which is compared by count and hash sum.
    """
    now = materialize(
        edges.filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(now)
    for _ in range(max_rounds if before[0] else 0):
        now = materialize(_star(_star(now, small=False), small=True))
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
