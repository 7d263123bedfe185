"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phmspark.llm.common import written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node's neighbours (small: only smaller ones; large: the larger ones) move to the least of them and it."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    moved = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")) if small else joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        moved = moved.unionByName(least.filter("u != m").select("u", F.col("m").alias("v")))
    return moved.filter("u != v").distinct()


def connect(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its least id) for every id in ``links`` (a, b). Each round is a written table; rounds grow with
    the logarithm of the largest component, and end when nothing moves."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == state:
            break
        state = now
        edges = written(_star(_star(edges, small=False), small=True), "edges")
    else:
        raise RuntimeError("components did not settle")
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
