"""A Merkle manifest of a table, and proofs of many of its rows at once.

Rows are leaves of one tree for each group; the groups' roots are the leaves of one more tree. Two
neighbours at a time become the hash of their joined digests; a last node without a neighbour
becomes its own hash, as long as its level has several nodes.

Trees grow by blocks of 2**HEIGHT neighbours, so that a long tree is many tasks' work. Proofs are made
as an octopus: each block of claimed leaves works out the least set of nodes that it can't derive from
its own leaves, fetches each of them once, derives the interiors that its leaves share, and expands
every leaf's own proof from these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.ordered import placed
from corpusmill.plans.staging import staged

#: Levels that a task derives from a block of 2**HEIGHT neighbours.
HEIGHT = 12
#: The number of the tree over all groups' roots.
TOP = -1
_NODES = "tree long, level int, place long, n long, hash string"


def leaf_hash(*columns: Column) -> Column:
    """The leaf of a row: the hash of its values, each `-` if null, else its number of UTF-8 bytes, `:`, and itself."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def joined(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Manifest(NamedTuple):
    """leaves (as given, and tree, place, n: leaves of the tree), trees (group, tree, n), nodes (tree, level, place, n: nodes of the level, hash), root."""

    leaves: DataFrame
    trees: DataFrame
    nodes: DataFrame
    root: str | None


def _grow(block: pa.Table, height: int) -> pa.Table:
    """All nodes above a block's, as high as the block or its tree goes."""
    block = block.sort_by("place")
    tree, level, place, n = (block.column(c)[0].as_py() for c in ("tree", "level", "place", "n"))
    hashes, out = block.column("hash").to_pylist(), []
    for up in range(1, height + 1):
        if n == 1:
            break
        hashes = [joined(*hashes[k : k + 2]) for k in range(0, len(hashes), 2)]
        place, n = place >> 1, n + 1 >> 1
        out.append((level + up, place, n, hashes))
    sizes = [len(h) for *_, h in out]
    spread = lambda k, kind: np.repeat(np.array([x[k] for x in out], kind), sizes)
    places = [p + np.arange(len(h)) for _, p, _, h in out]
    columns = [np.full(sum(sizes), tree, np.int64), spread(0, np.int32), np.concatenate(places) if out else np.zeros(0, np.int64), spread(2, np.int64), [x for *_, h in out for x in h]]
    return pa.table({name.split()[0]: pa.array(c, t) for name, c, t in zip(_NODES.split(", "), columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)})


def nodes_of(leaves: DataFrame) -> DataFrame:
    """(tree, level, place, n, hash) of all nodes over leaves (tree, place, n, hash), themselves included."""
    base = leaves.select("tree", F.lit(0).alias("level"), "place", "n", "hash")
    height = HEIGHT
    most, out = leaves.agg(F.max("n")).first()[0] or 0, base
    while most > 1:
        grown = staged(base.groupBy("tree", F.expr(f"shiftright(place, {height})").alias("block")).applyInArrow(lambda block: _grow(block, height), _NODES))
        out = out.unionByName(grown)
        base = grown.where(f"level % {height} = 0 and n > 1")
        most = -(-most >> height)
    return out


def manifest(leaves: DataFrame, group: str, order: str) -> Manifest:
    """The trees of `leaves`, a table with `group`, `order`, and the string `hash`, whose trees' leaves stand in `order`.

    Nulls come first, as a group and within one; rows of a group with equal places in the order follow
    by hash. Groups stand in the order of their values' UTF-8 bytes. An empty table has no root.
    """
    leaves = staged(leaves.withColumn("row_no", F.monotonically_increasing_id()))
    counted = leaves.groupBy(group).agg(F.count("*").alias("n")).withColumn("all_of_them", F.lit(0))
    trees = staged(placed(counted, "all_of_them", [group], "tree").drop("all_of_them"))
    of = trees.withColumnRenamed(group, "of_group")
    numbered = leaves.join(of, F.col(group).eqNullSafe(F.col("of_group"))).drop("of_group")
    rows = placed(numbered, "tree", [order, "hash", "row_no"], "place").drop("row_no")
    nodes = nodes_of(rows.select("tree", "place", "n", "hash"))
    subroots = nodes.where("n = 1").select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(trees.count()).cast("long").alias("n"), "hash")
    top = nodes_of(staged(subroots))
    root = top.where("n = 1").select("hash").first()
    return Manifest(rows, trees, nodes.unionByName(top), root[0] if root else None)


def missing(places: Sequence[int], n: int) -> Iterator[tuple[int, int]]:
    """Level and place of every node that can't be derived from the leaves at `places` of a tree of `n`, and that their proofs need."""
    known, level = set(places), 0
    while n > 1:
        yield from ((level, p ^ 1) for p in sorted(known) if p ^ 1 not in known and p ^ 1 < n)
        known, n, level = {p >> 1 for p in known}, n + 1 >> 1, level + 1


def _missing(claims: pa.Table, trees: int) -> pa.Table:
    tree, block, n = (claims.column(c)[0].as_py() for c in ("tree", "block", "n"))
    wanted = [(tree, *x) for x in missing(claims.column("place").to_pylist(), n)] + [(TOP, *x) for x in missing([tree], trees)]
    columns = zip(*wanted, strict=True) if wanted else [[]] * 3
    own = {c: pa.array([v] * len(wanted), pa.int64()) for c, v in (("tree", tree), ("block", block))}
    return pa.table(own | {c: pa.array(x, t) for c, x, t in zip(("of_tree", "level", "node"), columns, (pa.int64(), pa.int32(), pa.int64()), strict=True)})


def _levels(known: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> Iterator[tuple[dict[int, str], int]]:
    """The known nodes of each level with several nodes, fetched ones among them, and their number there; last the root."""
    level = 0
    while n > 1:
        known = known | {p: h for (of, p), h in fetched.items() if of == level}
        yield known, n
        pairs = {p >> 1 for p in known}
        known = {p: joined(*(known[k] for k in (2 * p, 2 * p + 1) if k < n)) for p in pairs if 2 * p in known and (2 * p + 1 in known or 2 * p + 1 >= n)}
        n, level = n + 1 >> 1, level + 1
    yield known, n


def _expand(claims: pa.Table, fetched: pa.Table, trees: int, names: list[str]) -> pa.Table:
    """The proof of each claim, and what its claimed hash and proof fold to."""
    tree, n = (claims.column(c)[0].as_py() for c in ("tree", "n"))
    got = {True: {}, False: {}}
    for of, level, node, digest in zip(*(fetched.column(c).to_pylist() for c in ("of_tree", "level", "node", "digest")), strict=True):
        got[of == TOP][level, node] = digest
    places = claims.column("place").to_pylist()
    own = list(_levels(dict(zip(places, claims.column("hash").to_pylist(), strict=True)), got[False], n))
    subroot = own[-1][0][0]
    top = list(_levels({tree: subroot}, got[True], trees))
    proofs, folds = [], []
    for place, digest in zip(places, claims.column("claimed").to_pylist(), strict=True):
        proof = []
        for levels, at in ((own, place), (top, tree)):
            for known, _ in levels[:-1]:
                other = known.get(at ^ 1)
                if other is None:
                    digest = joined(digest)
                else:
                    proof.append(other)
                    digest = joined(other, digest) if at & 1 else joined(digest, other)
                at >>= 1
        proofs.append(proof)
        folds.append(digest)
    more = [pa.array([subroot] * len(places)), pa.array(proofs, pa.list_(pa.string())), pa.array(folds, pa.string())]
    return pa.table([*(claims.column(c) for c in names), *more], names=[*names, "subroot", "siblings", "folded"])


def prove(made: Manifest, claims: DataFrame) -> DataFrame:
    """`claims` with subroot, siblings (level by level, left to right, up to the root), folded and verified.

    `claims` are rows of the manifest's leaves, any of them, with the string `claimed`: the hash that
    is to be held against the manifest. folded is what it and the siblings give; verified tells whether
    that is the manifest's root.
    """
    trees = made.trees.count()
    blocks = claims.withColumn("block", F.expr(f"shiftright(place, {HEIGHT})"))
    wanted = staged(blocks.select("tree", "block", "place", "n").groupBy("tree", "block").applyInArrow(lambda claims: _missing(claims, trees), "tree long, block long, of_tree long, level int, node long"))
    levels = [r.level for r in wanted.select("level").distinct().collect()]  # as many as a tree is high
    nodes = made.nodes.where(F.col("level").isin(levels)).select(F.col("tree").alias("of_tree"), "level", F.col("place").alias("node"), F.col("hash").alias("digest"))
    fetched = wanted.join(nodes, ["of_tree", "level", "node"]).groupBy("tree", "block")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in claims.schema) + ", subroot string, siblings array<string>, folded string"
    names = claims.columns
    proofs = blocks.groupBy("tree", "block").cogroup(fetched).applyInArrow(lambda own, got: _expand(own, got, trees, names), kind)
    return proofs.withColumn("verified", F.col("folded") == F.lit(made.root))
