"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is a pair of aggregations and joins on node keys; a node with very many
links is pre-aggregated to its minimum before the shuffle and its links are only joined
(a join that adaptive execution may split), never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(u, v)`` to ``(node, root)`` for every linked node but the roots themselves.

    The root is the smallest node of the component.  Null ends and self links are ignored,
    repeated links count once, an empty table gives an empty table.
    """
    edges = staged(_oriented(links), "links")
    before = None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now.n:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _oriented(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = staged(large, "large-star")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(_oriented(joined.unionByName(small.select("u", F.col("m").alias("v")))), "small-star")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _oriented(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
