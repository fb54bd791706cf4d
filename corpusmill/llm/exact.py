"""Exact deduplication by Grace hashing.

Each task first puts its own rows into open-addressing tables that hold a bounded number of bytes, so
that of a text's many copies one content for each table goes on, with their number. These are written
once, with the hash of their content. Buckets are prefixes of that hash: those whose distinct contents
don't fit a task are written again, cut by the hash's next digits, and so on until each fits; Spark's
shuffle then deals the buckets to tasks, each of which puts one bucket at a time into a table that
compares complete contents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.words import as_bytes, chunks, freeing
from corpusmill.plans.staging import staged, text_batches

#: Bytes of distinct contents in a bucket, and of shuffled contents for a task; digits of a cut, and how many cuts there may be.
BUCKET, DEALT, DIGITS, DEPTH = 64 << 20, 512 << 20, 4, 10
#: Bytes of contents and rows that a task's own table holds; bytes of a batch that it gives.
HELD, ROWS, GIVEN = 32 << 20, 1 << 18, 4 << 20
_GATHERED = "rep long, best boolean, doc_id long, n long, size long, hash long, sha binary, content binary"
_RESOLVED = "rep long, keep_id long, group_size long, text_sha256 string, wins boolean"


class Contents:
    """An open-addressing table with linear probing; equal hashes are told apart by complete contents."""

    def __init__(self) -> None:
        self.slots, self.hashes, self.contents = [-1] * 1024, [], []

    def place(self, key: int, content: bytes) -> int:
        """The number of `content`, which is added where it is new."""
        mask = len(self.slots) - 1
        at = key & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == key and self.contents[k] == content:
                return k
            at = (at + 1) & mask
        k = self.slots[at] = len(self.contents)
        self.hashes.append(key)
        self.contents.append(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return k

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for k, key in enumerate(self.hashes):
            at = key & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def _key(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "big", signed=True)


class _Gathering:
    """Rows of one task's table, as they come."""

    def __init__(self) -> None:
        self.table, self.shas, self.ids, self.numbers, self.carried, self.held = Contents(), [], [], [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        sha = hashlib.sha256(text).digest()
        k = self.table.place(_key(sha), text)
        if k == len(self.shas):
            self.shas.append(sha)
            self.held += len(text)
        self.ids.append(doc_id)
        self.numbers.append(k)

    def batches(self, base: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        """The rows; of each content's rows the first with the largest id has content and number of rows."""
        best, count = [-1] * len(self.shas), [0] * len(self.shas)
        for row, k in enumerate(self.numbers):
            count[k] += 1
            own, other = self.ids[row], self.ids[best[k]]
            if best[k] < 0 or own is not None and (other is None or own > other):
                best[k] = row
        tops = {row: k for k, row in enumerate(best)}
        carried = pa.chunked_array(self.carried).combine_chunks() if self.carried else None
        sizes = [len(self.table.contents[tops[r]]) if r in tops else 0 for r in range(len(self.ids))]
        for lo, hi in chunks([s + 64 for s in sizes], GIVEN):
            at = [tops.get(r) for r in range(lo, hi)]
            of = lambda values: [None if k is None else values[k] for k in at]  # noqa: E731, B023
            columns = [
                pa.array([base + k for k in self.numbers[lo:hi]], pa.int64()),
                pa.array([k is not None for k in at]),
                pa.array(self.ids[lo:hi], pa.int64()),
                pa.array(of(count), pa.int64()),
                pa.array([None if k is None else s for k, s in zip(at, sizes[lo:hi], strict=True)], pa.int64()),
                pa.array([None if k is None else _key(self.shas[k]) for k in at], pa.int64()),
                pa.array(of(self.shas), pa.binary()),
                pa.array(of(self.table.contents), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns + ([carried.slice(lo, hi - lo)] if carried is not None else []), names)


@freeing
def _gather(batches: Iterator[pa.RecordBatch], most_held: int, most_rows: int) -> Iterator[pa.RecordBatch]:
    """A task's rows, of which those with equal texts share a number; a table that is full is closed."""
    base, own = TaskContext.get().partitionId() << 33, _Gathering()
    for batch in batches:
        names = [x.split()[0] for x in _GATHERED.split(", ")] + batch.schema.names[2:]
        # Upper and lower case of ASCII alone, as UTF-8 bytes above 0x7F are no letters to `lower`.
        texts, ids = [t.lower() for t in as_bytes(batch.column("text"))], batch.column("doc_id").to_pylist()
        done = 0
        for row, (doc_id, text) in enumerate(zip(ids, texts, strict=True), 1):
            own.add(doc_id, text)
            full = own.held >= most_held or len(own.ids) >= most_rows
            if full or row == len(ids):
                own.carried += [c.slice(done, row - done) for c in batch.columns[2:]]
                done = row
            if full:
                yield from own.batches(base, names)
                base, own = base + len(own.shas), _Gathering()
    if own.ids:
        yield from own.batches(base, names)


def _fitting(contents: DataFrame, buckets: int) -> DataFrame:
    """`contents` with level and bucket, so that the distinct contents of each bucket fit a table.

    A bucket of one hash can't be cut, and needn't be: its table holds each content once.
    """
    open_ = contents.withColumns({"level": F.lit(0), "bucket": F.expr(f"pmod(hash, {buckets}L)")})
    closed = []
    for level in range(1, DEPTH):
        large = open_.groupBy("bucket").agg(F.sum("size").alias("held")).where(F.col("held") > BUCKET).select("bucket")
        distinct = open_.join(large, "bucket", "left_semi").groupBy("bucket", "hash").agg(F.max("size").alias("size"))
        cut = staged(distinct.groupBy("bucket").agg(F.sum("size").alias("held"), F.count("*").alias("m")).where((F.col("held") > BUCKET) & (F.col("m") > 1)).select("bucket"))
        if cut.isEmpty():
            break
        closed.append(open_.join(cut, "bucket", "left_anti"))
        digit = F.shiftrightunsigned("hash", 64 - DIGITS * level).bitwiseAND((1 << DIGITS) - 1)
        further = open_.join(cut, "bucket", "left_semi").withColumns({"level": F.lit(level), "bucket": F.col("bucket") * (1 << DIGITS) + digit})
        open_ = staged(further.repartition("bucket"))
    for part in closed:
        open_ = open_.unionByName(part)
    return open_


@freeing
def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What became of each content of the buckets, which follow one another."""
    now, table, groups, reps = None, Contents(), [], []

    def closed() -> pa.RecordBatch:
        found = [(rep, *(groups[k][1:]), groups[k][0] == rep) for rep, k in reps]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        columns = zip(*found, strict=True) if found else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in _RESOLVED.split(", ")])

    for batch in batches:
        of = lambda c: batch.column(c).to_pylist()  # noqa: E731, B023
        for where, rep, top, n, key, sha, content in zip(zip(of("level"), of("bucket"), strict=True), of("rep"), of("doc_id"), of("n"), of("hash"), of("sha"), of("content"), strict=True):
            if where != now:
                yield closed()
                now, table, groups, reps = where, Contents(), [], []
            k = table.place(key, content)
            if k == len(groups):
                groups.append((rep, top, n, sha.hex()))
            else:
                winner, most, count, code = groups[k]
                # The largest id, then the least number; a null id is below all others.
                if (top is not None, top or 0, -rep) > (most is not None, most or 0, -winner):
                    winner, most = rep, top
                groups[k] = (winner, most, count + n, code)
            reps.append((rep, k))
    yield closed()


def copies(docs: DataFrame, *carry: str) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of `docs` (doc_id, text), and the columns `carry`.

    Texts are equal when they are identical after A-Z have become small letters; a null text is
    empty. Of each group of equal texts one row is kept: one with the largest doc_id, which is keep_id;
    rows that repeat that id and text are not kept a second time. A null id is below all others, and
    keep_id is null where a group has no other. text_sha256 is of the small-lettered text. An empty
    table gives an empty result; other columns have no effect.
    """
    spark = docs.sparkSession
    base = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))
    kind = f"{_GATHERED}, carried {base.schema['carried'].dataType.simpleString()}" if carry else _GATHERED
    rows = staged(base.mapInArrow(partial(_gather, most_held=HELD, most_rows=ROWS), kind))
    contents = rows.where("best").select("rep", "doc_id", "n", "size", "hash", "sha", "content")
    held = contents.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-2 * held // BUCKET))
    tasks = max(min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-held // DEALT))
    dealt = _fitting(contents, buckets).repartition(tasks, "level", "bucket").sortWithinPartitions("level", "bucket")
    found = dealt.mapInArrow(_resolve, _RESOLVED)
    more = [F.col("carried")[c].alias(c) for c in carry]
    return rows.select("doc_id", "rep", "best", *(["carried"] if carry else [])).join(found, "rep").select("doc_id", "keep_id", "group_size", (F.col("best") & F.col("wins")).alias("kept"), "text_sha256", *more)


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that `copies` keeps, with their columns."""
    return copies(docs.select("doc_id", "text", F.struct(*docs.columns).alias("whole")), "whole").where("kept").select("whole.*")
