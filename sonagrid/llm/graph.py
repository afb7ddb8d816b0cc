"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sonagrid.llm.skew import join_unique
from sonagrid.llm.store import partitions

#: Edges of a partition, at least.
EDGES = 20_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node
    that can be reached. Alternating large-star and small-star steps: each round
    re-hangs a node's neighbours under the smallest of them, so the rounds grow with
    the logarithm of the longest path; over ``most_rounds`` is an error. Every round is
    checkpointed, in no more partitions than its edges need. In the first step of a round, a
    node with very many neighbours is joined apart from the others."""
    parts = partitions(edges.sparkSession)
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    state = None
    for _ in range(most_rounds):
        before, state = state, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        few = max(1, min(parts, state[0] // EDGES))
        now = now.coalesce(few)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("held"))
        large = join_unique(both, least, "a", 2 * state[0], parts).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct().coalesce(few)
        # a plain join: what has many about it is mostly the least of its group, as near.py links
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = small.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct().coalesce(few).checkpoint()
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").union(now.select("b", "b").distinct()).distinct()
