"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.staging import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: the neighbours of a node are linked to the smallest of them.

    The minimum is a pre-aggregated group-by; the join back on the node is one to many, which an
    adaptive plan may split for a node with very many links.
    """
    if large:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = near.join(low, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.where("a <> m").select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every node with a link: component is the smallest id it reaches.

    `edges` has long columns a and b. Large-star and small-star steps alternate until the links no
    longer change, which takes about the logarithm of the longest path. Links of a node to itself
    and repeated links have no effect; an empty table gives an empty one.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda: tuple(edges.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(a, b) as decimal(38, 0))"))).first())
    before = state()
    for _ in range(rounds if before[0] else 1):
        if before[0]:
            edges = staged(_star(_star(edges, True), False))
        now = state()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links still change after {rounds} rounds")
    pairs = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return pairs.union(pairs.select(F.col("component").alias("id"), "component").distinct())
