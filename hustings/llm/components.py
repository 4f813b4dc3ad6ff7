"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.session import cut_lineage


def _stars(links: DataFrame, both_ways: bool) -> DataFrame:
    """Link each node's (larger or smaller) neighbours to the smallest node it knows."""
    pairs = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else links
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = pairs.join(least, "u")
    if both_ways:
        moved = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Nodes of ``links`` (u, v: comparable values) with the smallest node of their component: (node, root).

    Nodes without a link to a different node are absent. Each round works on rows no more than the links and is
    written to the shared folder; about log(n) rounds are needed. No component is gathered anywhere.
    """
    current = cut_lineage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(most_rounds):
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        current = cut_lineage(_stars(_stars(current, True), False))
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")
