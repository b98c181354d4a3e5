"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexengine.llm.common import released, skew_join, staged, unstaged


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges (u, v) staged, and what tells whether they changed: it is observed as they are written."""
    seen = Observation()
    out = staged(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")))
    return out, (seen.get["n"], seen.get["h"])


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes of links (a, b).

    Minima are aggregated before they are joined, so a node with any number of links never needs one task.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    edges, mark = _marked(edges)
    while True:
        # large star: a node's larger neighbours go to the smallest around it
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = skew_join(both.filter("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = skew_join(large, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        old, before = mark, edges
        edges, mark = _marked(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        unstaged(before)
        # small tables are broadcast to the joins, and each stays in all executors until the driver collects garbage
        released(edges.sparkSession)
        if mark == old:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
