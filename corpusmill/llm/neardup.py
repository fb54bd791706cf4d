"""Near-duplicate documents by b-bit MinHash.

Each document's shingle set gets HASHES minima. Bands of ROWS full minima give candidate groups; of
each minimum the low BITS are kept, packed into four longs, and the bit counts of two signatures
estimate their similarity, corrected for minima that agree by chance. What the estimate lets through
is confirmed on the full sets.

Copies (equal sets) are one node. Groups are never expanded into all pairs: each node is first held
against the best of its groups' heads only, which makes few components of many nodes. Groups that
still hold several components then meet in blocks of bounded size: a task takes a block of nodes
outside the group's main component and a block of any of its nodes, looks for links between different
components from the highest estimate down, and gives back no more links than it has components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.components import components
from corpusmill.llm.pretokens import gather
from corpusmill.llm.words import as_bytes, chunks, freeing, mix, shingle_sets
from corpusmill.plans.staging import staged, text_batches

HASHES, ROWS, BITS = 128, 4, 2
#: Estimates below this are dropped: 5 standard errors below a similarity of 0.75.
LEAST_ESTIMATE = 0.52
#: Shingles and nodes that a block of a group has about; candidates that are confirmed in one go.
BLOCK_SHINGLES, BLOCK_NODES, STEP = 1 << 18, 1024, 16
_SIGNATURE = [f"s{k}" for k in range(HASHES * BITS // 64)]
_FACTORS = mix(np.arange(1000, 1000 + HASHES, dtype=np.uint64)) | np.uint64(1)
_SIGNED = "doc_id long, n long, d1 long, d2 long, " + ", ".join(f"{s} long" for s in _SIGNATURE) + ", bands array<long>"


def minima(sets: list[np.ndarray], factors: np.ndarray = _FACTORS) -> np.ndarray:
    """A minimum for each set and factor; all ones for an empty set."""
    full = [s for s in sets if len(s)]
    out = np.full((len(sets), len(factors)), ~np.uint64(0))
    if full:
        values, starts = np.concatenate(full), np.cumsum([0, *map(len, full[:-1])])
        rows = np.flatnonzero([len(s) > 0 for s in sets])
        for k, factor in enumerate(factors):
            out[rows, k] = np.minimum.reduceat(values * factor, starts)
    return mix(out)


def band_keys(low: np.ndarray) -> np.ndarray:
    """One key for each band of ROWS minima."""
    n = HASHES // ROWS
    split = low.reshape(len(low), n, ROWS)
    keys = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64), (len(low), n)).copy()
    for j in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + split[:, :, j])
    return keys


def packed(low: np.ndarray) -> np.ndarray:
    """The low BITS of each minimum, 64 / BITS of them in a word."""
    per = 64 // BITS
    bits = (low & np.uint64((1 << BITS) - 1)).reshape(len(low), -1, per)
    return (bits << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.reshape(-1).view(np.int64)))


@freeing
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        for lo, hi in chunks([len(t) for t in texts]):
            sets = shingle_sets(texts[lo:hi])
            low = minima(sets)
            digests = [[mix(s + np.uint64(k)).sum(dtype=np.uint64) for s in sets] for k in (11, 23)]
            columns = [batch.column("doc_id").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64())]
            columns += [pa.array(np.array(d, np.uint64).view(np.int64)) for d in digests]
            columns += [pa.array(c.copy().view(np.int64)) for c in packed(low).T]
            columns.append(_lists(band_keys(low)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "d1", "d2", *_SIGNATURE, "bands"])


@freeing
def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        for lo, hi in chunks([len(t) for t in texts]):
            sets = shingle_sets(texts[lo:hi])
            offsets = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            flat = pa.array(np.concatenate(sets).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "shingles"])


def _differing(x: Column, y: Column) -> Column:
    """How many of the two-bit fields of two words differ."""
    z = x.bitwiseXOR(y)
    return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(int("01" * 32, 2))))


def _corrected(differ: Column | np.ndarray) -> Column | np.ndarray:
    """Similarity from the number of minima that differ, less what agrees by chance."""
    chance = 1 / 2**BITS
    return (1 - differ / float(HASHES) - chance) / (1 - chance)


def estimate(a: str, b: str) -> Column:
    """Similarity of two packed signatures by bit counts."""
    return _corrected(reduce(lambda x, y: x + y, [_differing(F.col(f"{a}.{s}"), F.col(f"{b}.{s}")) for s in _SIGNATURE]))


def _plausible(a: str, b: str, percent: int) -> Column:
    """Set sizes that allow the similarity, and an estimate near enough to it."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (estimate(a, b) >= LEAST_ESTIMATE * percent / 75)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return met.where(f"100L * both >= {percent}L * (na + nb - both)").select("a", "b").distinct()


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Those links (a, b) that lead from one component to another, with both components as lo and hi."""
    left, right = labels.select(F.col("doc_id").alias("a"), F.col("c").alias("ca")), labels.select(F.col("doc_id").alias("b"), F.col("c").alias("cb"))
    met = links.join(left, "a").join(right, "b").where("ca <> cb")
    return met.withColumns({"lo": F.least("ca", "cb"), "hi": F.greatest("ca", "cb")}).drop("ca", "cb")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (doc_id, c) after the components that `links` (a, b) join have become one.

    Only one link between two components goes into the search for larger ones.
    """
    up = components(_between(links, labels).select(F.col("hi").alias("a"), F.col("lo").alias("b")).distinct())
    return staged(labels.join(up.withColumnRenamed("id", "c"), "c", "left").select("doc_id", F.coalesce("component", "c").alias("c")))


def _estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """`estimate` of one packed signature and each of several."""
    z = many ^ one
    return _corrected(np.bitwise_count((z | (z >> np.uint64(1))) & np.uint64(int("01" * 32, 2))).sum(axis=1, dtype=np.int64))


def _links(rows: pa.RecordBatch, percent: int) -> list[tuple[int, int]]:
    """Links between components in one pair of blocks, as many as make one of those that links join."""
    of = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
    doc, n, c, asks, key = of("doc_id"), of("n"), of("c"), of("asks"), rows.column("key")[0].as_py()
    number = np.unique(c, return_inverse=True)[1]
    root = np.arange(number.max() + 1)  # of each component; kept flat, as each merge renames
    if len(root) < 2:
        return []
    sign, bands = np.stack([of(s) for s in _SIGNATURE], axis=1).view(np.uint64), rows.column("bands").flatten().to_numpy().reshape(len(doc), -1)
    bounds = np.cumsum(np.append(0, n))
    flat = rows.column("shingles").flatten().to_numpy().view(np.uint64)  # in which order they are sorted
    least, out = LEAST_ESTIMATE * percent / 75, []
    others = np.flatnonzero(~asks)
    for i in np.flatnonzero(asks).tolist():
        near = others[root[number[others]] != root[number[i]]]
        near = near[np.minimum(n[near], n[i]) * 100 >= np.maximum(n[near], n[i]) * percent]
        guess = _estimates(sign[i], sign[near])
        # A pair belongs to the first band that it has in common.
        good = (guess >= least) & (bands[near, (bands[near] == bands[i]).argmax(axis=1)] == key)
        near = near[good][np.argsort(-guess[good], kind="stable")]
        own = flat[bounds[i] : bounds[i + 1]]
        while len(near):
            step, near = near[:STEP], near[STEP:]
            theirs, ends = gather(flat, bounds[:-1], n, step)
            hit = own[np.minimum(np.searchsorted(own, theirs), n[i] - 1)] == theirs
            both = np.add.reduceat(hit, ends - n[step], dtype=np.int64)
            for k in step[100 * both >= percent * (n[step] + n[i] - both)].tolist():
                mine, its = root[number[i]], root[number[k]]
                if mine != its:
                    root[root == its] = mine
                    out.append((int(doc[i]), int(doc[k])))
            near = near[root[number[near]] != root[number[i]]]
    return out


@freeing
def _links_of_groups(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """`_links` of each (key, x, y), whose rows follow one another."""
    held, now = [], None

    def closed() -> list[tuple[int, int]]:
        if not held:
            return []
        return _links(held[0] if len(held) == 1 else pa.concat_batches(held), percent)

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([batch.column(c).to_numpy() for c in ("key", "x", "y")], axis=1)
        cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1).tolist(), len(group)]
        found = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if (own := tuple(group[lo])) != now:
                found += closed()
                held, now = [], own
            held.append(batch.slice(lo, hi - lo))
        yield out(found)
    yield out(closed())


def within_groups(members: DataFrame, labels: DataFrame, signs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) that are left between components in groups of members (key, doc_id, head)."""
    placed = members.join(labels, "doc_id").select("key", "doc_id", "head", "c")
    at_head = F.max(F.when(F.col("doc_id") == F.col("head"), F.col("c"))).alias("main")
    mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), at_head).where("low < high").select("key", "main")
    rows = staged(placed.join(mixed, "key").join(signs, "doc_id").select("key", "doc_id", "c", (F.col("c") != F.col("main")).alias("asks"), "n", *_SIGNATURE, "bands"))
    blocks = lambda of: F.greatest(F.lit(1), F.ceil(F.sum(F.when(of, F.col("n"))) / BLOCK_SHINGLES), F.ceil(F.count(F.when(of, 1)) / BLOCK_NODES)).cast("int")
    shape = rows.groupBy("key").agg(blocks(F.col("asks")).alias("a_blocks"), blocks(F.lit(True)).alias("b_blocks"))
    whole = rows.join(shape, "key").join(sets, "doc_id")
    own = lambda count: F.pmod(F.xxhash64("doc_id"), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    a = whole.where("asks").withColumns({"x": own(F.col("a_blocks")), "y": every("b_blocks")})
    b = whole.withColumns({"x": every("a_blocks"), "y": own(F.col("b_blocks")), "asks": F.lit(False)})
    dealt = a.unionByName(b).drop("a_blocks", "b_blocks").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return dealt.mapInArrow(partial(_links_of_groups, percent=percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs` (doc_id, text).

    Documents are linked when their sets of five-word shingles have a similarity of `percent` or
    more; component_id is the smallest doc_id that links reach. Null and word-free texts have no
    shingles and no links. Rows that repeat a doc_id count as one document. A row without a doc_id
    is in the component of the rows with an equal set, if one of them has an id; it has no other
    links, and its component_id and kept are null otherwise. Other columns are ignored; an empty table gives an empty result.
    """
    base = staged(text_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(_sign, _SIGNED))
    nodes = base.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("doc_id"))
    signs = base.join(nodes, ["n", "d1", "d2", "doc_id"], "left_semi")

    bands = signs.select("doc_id", F.explode("bands").alias("key"))
    # One order of all nodes picks the heads, so the many bands that near copies share lead to few heads.
    first = F.min(F.struct(F.xxhash64("doc_id"), "doc_id"))
    heads = bands.groupBy("key").agg(F.count("*").alias("m"), first.alias("x")).where("m > 1").select("key", F.col("x.doc_id").alias("head"))
    members = staged(bands.join(heads, "key"))

    grouped = members.select("doc_id").distinct()
    signs = staged(signs.join(grouped, "doc_id", "left_semi").select("doc_id", "n", *_SIGNATURE, "bands").dropDuplicates(["doc_id"]))
    sets = staged(docs.select(F.col("doc_id").cast("long"), "text").join(grouped, "doc_id", "left_semi").mapInArrow(_full_sets, "doc_id long, shingles array<long>"))

    star = members.where("doc_id <> head").select("doc_id", "head").distinct()
    scored = star.alias("e").join(signs.alias("a"), F.expr("e.doc_id = a.doc_id")).join(signs.alias("b"), F.expr("e.head = b.doc_id")).where(_plausible("a", "b", percent))
    best = scored.groupBy(F.col("e.doc_id").alias("a")).agg(F.max(F.struct(estimate("a", "b").alias("s"), F.col("e.head").alias("b"))).alias("t")).select("a", "t.b")
    labels = merged(staged(grouped.select("doc_id", F.col("doc_id").alias("c"))), confirmed(best, sets, percent))
    labels = merged(labels, within_groups(members, labels, signs, sets, percent))

    # Each set's component, carried to all its copies.
    held = nodes.join(labels, "doc_id", "left").select("n", "d1", "d2", F.coalesce("c", "doc_id").alias("component_id"))
    out = base.select("doc_id", "n", "d1", "d2").join(held, ["n", "d1", "d2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
