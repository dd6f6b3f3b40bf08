"""Connected components over an edge table, by alternating large and small stars.

Each round is two aggregations with map-side combining and two joins; hubs are split by adaptive
execution because the other side of each join has one row per node. Rounds grow with the logarithm of
the longest path. No list of neighbours is ever gathered, on the driver or in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import durable

MAX_ROUNDS = 60
#: Rows of a part of the tables between rounds; small ones are not spread over many files.
PART_ROWS = 500_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the smallest node that it reaches) for every node of ``edges``.

    Edges have no direction. Rows with a null end are ignored; a loop gives its node as a component of
    its own. An empty table gives an empty result. Node ids must be of an ordered type.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct()
    pairs = durable(pairs)
    parts = 1 + 2 * pairs.count() // PART_ROWS  # neither nodes nor links ever outnumber this
    nodes = durable(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().coalesce(parts))
    state, links = None, pairs.where("a <> b")
    for _ in range(MAX_ROUNDS):
        links = durable(_small_star(_large_star(links)).coalesce(parts))
        row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == state:
            break
        state = (row["n"], row["h"])
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return nodes.join(links.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` lead from larger to smaller nodes."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
