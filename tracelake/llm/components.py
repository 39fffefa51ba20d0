"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is a grouped minimum and a join; a hub's links are pre-aggregated for the minimum and its side
of the join can be split.  The links are written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import materialize, release


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): component is the smallest id reachable.

    Links of an id with itself give it a row and join nothing; links with a null end are ignored.
    """
    links = links.select("a", "b").where("a is not null and b is not null")
    ids = links.select(F.col("a").alias("id")).union(links.select("b"))
    nodes = materialize(ids.distinct(), "nodes", narrow=True)
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", narrow=True)
    before = None
    while True:
        # a > b throughout; large star: every larger neighbour of a node is linked to the node's minimum
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # small star: every smaller neighbour of a node, and the node, is linked to the minimum
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        last, edges = edges, materialize(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "round", narrow=True)
        release(last)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return nodes.join(edges.select(F.col("a").alias("id"), F.col("b").alias("low")), "id", "left").select(
        "id", F.coalesce("low", "id").alias("component")
    )
