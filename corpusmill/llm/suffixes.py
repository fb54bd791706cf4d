"""Removing byte strings that an earlier document has, by a depth-limited radix sort of suffixes.

Suffixes are ordered through WINDOW bytes only, most significant digit first, and equal groups at
that depth are exactly the repeated windows. A digit is a fingerprint of the bytes that it stands
for, and a pass sorts only what the pass before left in one group:

1. by the window's anchor, its least string of ANCHOR bytes. Neighbouring windows mostly have the
   same anchor; such a run of windows is one entry, so there are far fewer entries than suffixes;
2. within an anchor, by all bytes under the run. A run that an earlier document has too goes whole;
3. only for runs whose anchor, but not whose bytes, another document has: window by window.

Entries travel as packed columns, dealt out by anchor; every batch first keeps, of equal entries,
only those of the smallest document, so that a frequent passage is not gathered by one task. Runs of
the last pass travel as their bytes, which are fewer than the fingerprints of their windows.

A frequent phrase that is shorter than a window stands in many contexts, so its anchor has many runs
that differ. Such hot anchors are counted in a sample of the text; their runs are dealt by their bytes
in the second step, all of them go on to the third, and there each of their windows is dealt by its own
fingerprint, again only those of the smallest document of a batch. A sample that misses an anchor
changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.words import _BYTE, as_bytes, chunks, freeing, mix, prefix_hash, span_hash
from corpusmill.plans.staging import staged, text_batches

WINDOW, ANCHOR = 50, 16
#: Bytes of text for which there is one bucket, and entries that a task packs at a time.
BUCKET_BYTES, FLUSH = 4 << 20, 1 << 19
#: Runs from which an anchor is hot, about a bucket's; one of so many parts of the text is counted; characters from which a text is counted by a piece.
HOT_RUNS, SAMPLE, LONG = BUCKET_BYTES // 17, 64, 1 << 16
_LOW = np.uint64((1 << 40) - 1)  # the bytes of an anchor that travel
_LARGEST = (1 << 63) - 1
_PACKED = "bucket int, data binary"
_SPANS = "d long, th long, pos int, size int, open boolean, bucket int"
_COLUMNS = [("anchor", np.uint64), ("block", np.uint64), ("row", np.uint32), ("pos", np.uint32), ("more", np.uint8)]


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of every run of windows with one anchor: anchor, block, text number, first window and number of further windows."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    n = len(data) - WINDOW + 1
    if n <= 0:
        return tuple(np.zeros(0, kind) for _, kind in _COLUMNS)
    prefix = prefix_hash(_BYTE[data])
    at = np.arange(len(data) - ANCHOR + 1)
    grams = span_hash(prefix, at, at + ANCHOR)
    # The leftmost of the least: a window's content alone decides.
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width, have = WINDOW - ANCHOR + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    anchor = (low[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.searchsorted(ends, np.arange(0, n), side="right") if len(texts) > 1 else np.zeros(n, np.int64)
    inside = np.arange(n) + WINDOW <= ends[np.minimum(owner, len(ends) - 1)]
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= new[1:] | ~inside[1:]
    first, stop = np.flatnonzero(new), np.flatnonzero(last)
    begin = (ends - [len(t) for t in texts])[owner[first]]
    place = (anchor[first] - first).astype(np.uint64)
    block = mix(span_hash(prefix, first, stop + WINDOW) + place)
    columns = (grams[anchor[first]], block, owner[first], first - begin, stop - first)
    return tuple(c.astype(kind) for c, (_, kind) in zip(columns, _COLUMNS, strict=True))


def merged_spans(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of a row as one."""
    order = np.lexsort((start, row))
    row, start, end = row[order].astype(np.int64), start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(row):
        return row, start, end
    reach = np.maximum.accumulate(end + row * (1 << 40)) - row * (1 << 40)  # rows ascend, so no reach leaves its row
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] > reach[:-1])))
    first = np.flatnonzero(new)
    return row[first], start[first], np.maximum.reduceat(end, first)


def _owned(columns: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of entries by anchor, block and document, where each (anchor, block) begins, and which are owned by a smaller document."""
    anchor, block, row = columns[:3]
    order = np.lexsort((ids[row], block, anchor))
    a, b, d = anchor[order], block[order], ids[row[order]]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(a) else d
    return order, new, d > least


def _shared(keys: np.ndarray, d: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Which of sorted keys are of several documents, and begin more than one kind of entry."""
    if not len(keys):
        return np.zeros(0, bool)
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    several = (np.minimum.reduceat(d, begin) < np.maximum.reduceat(d, begin)) & (np.add.reduceat(new.astype(int), begin) > 1)
    return np.repeat(several, np.diff(np.append(begin, len(keys))))


def _planes(x: np.ndarray) -> np.ndarray:
    """All first bytes, then all second ones and so on: the upper bytes of small numbers are zeros that compress away."""
    return np.ascontiguousarray(x.astype(np.uint32)).view(np.uint8).reshape(-1, 4).T


def _is_hot(anchor: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return np.isin(anchor & _LOW, hot)


@freeing
def _count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        for lo, hi in chunks([len(t) for t in texts]):
            anchor, n = np.unique(runs(texts[lo:hi])[0] & _LOW, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])


def hot_anchors(texts: DataFrame) -> np.ndarray:
    """Anchors with more than about HOT_RUNS runs in texts (d, th, text); there are fewer than buckets."""
    size, by = F.length("text"), F.xxhash64("d", "th")
    piece = F.ceil(size / SAMPLE).cast("int")
    part = F.when(size > LONG, F.substring("text", F.pmod(by, size - piece + 1).cast("int") + 1, piece)).when(F.pmod(by, F.lit(SAMPLE)) == 0, F.col("text"))
    counts = texts.select(part.alias("text")).where("text <> ''").mapInArrow(_count_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r.anchor for r in counts.where(F.col("n") > HOT_RUNS / SAMPLE).collect()], np.uint64))


def met(bucket: np.ndarray, spans: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that occur in sorted ones and where each begins and the last ends; one of no rows where there are only spans."""
    present, first = np.unique(bucket, return_index=True)
    if not len(present) and spans:
        present, first = np.zeros(1, np.int64), np.zeros(1, np.int64)
    return present, np.append(first, len(bucket))


def _pack(columns: list[np.ndarray], ids: np.ndarray, hashes: np.ndarray, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each bucket: entries that are the smallest of their kind here, and spans that are known to go."""
    order, _, gone = _owned(columns, ids)
    cut, left = order[gone], np.sort(order[~gone])
    row, start, end = merged_spans(columns[2][cut], columns[3][cut], columns[3][cut] + columns[4][cut] + WINDOW)
    columns = [c[left] for c in columns]
    bucket = (np.where(_is_hot(columns[0], hot), columns[1], columns[0]) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    present, bounds = met(bucket[by], len(row))
    span_bounds = np.linspace(0, len(row), len(present) + 1).astype(int)
    out = ([], [])
    for i, k in enumerate(present.tolist()):
        mine, spans = by[bounds[i] : bounds[i + 1]], slice(span_bounds[i], span_bounds[i + 1])
        rows = np.concatenate([columns[2][mine].astype(np.int64), row[spans]])
        used, local = np.unique(rows, return_inverse=True)
        # Five bytes of the anchor and six of the block tell entries apart; the rest are small numbers.
        a, b = columns[0][mine], columns[1][mine]
        parts = [np.array([len(used), len(mine), spans.stop - spans.start], np.int64), ids[used], hashes[used], a.view(np.uint8).reshape(-1, 8)[:, :5], b.view(np.uint8).reshape(-1, 8)[:, :6]]
        parts += [_planes(np.diff(local[: len(mine)], prepend=0)), _planes(columns[3][mine]), columns[4][mine], local[len(mine) :], start[spans], end[spans]]
        out[0].append(k)
        out[1].append(b"".join(np.ascontiguousarray(p).tobytes() for p in parts))
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["bucket", "data"])


def _unpack(data: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at = 0

    def take(count: int, kind: type) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    docs, entries, spans = take(3, np.int64).tolist()
    ids, hashes = take(docs, np.int64), take(docs, np.int64)
    wide = []
    for size in (5, 6):
        full = np.zeros((entries, 8), np.uint8)
        full[:, :size] = take(entries * size, np.uint8).reshape(-1, size)
        wide.append(full.view(np.uint64).reshape(-1))
    row, pos = (np.ascontiguousarray(take(entries * 4, np.uint8).reshape(4, entries).T).view(np.uint32).reshape(-1) for _ in range(2))
    row, more = np.cumsum(row).astype(np.uint32), take(entries, np.uint8)
    return [*wide, row, pos, more], ids, hashes, *(take(spans, np.int64) for _ in range(3))


def _joined(parts: list[list[np.ndarray]], sizes: list[int]) -> list[np.ndarray]:
    """Columns of several parts as one, with row numbers moved behind those of the parts before."""
    before = np.cumsum([0, *sizes[:-1]]).astype(np.uint32)
    moved = [[p[0], p[1], p[2] + np.uint32(b), *p[3:]] for p, b in zip(parts, before, strict=True)]
    return [np.concatenate(c) for c in zip(*moved, strict=True)]


@freeing
def _map_runs(batches: Iterator[pa.RecordBatch], buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    held, ids, hashes, entries = [], [], [], 0
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        d, th = (batch.column(c).to_numpy() for c in ("d", "th"))
        for lo, hi in chunks([len(t) for t in texts]):
            held.append(list(runs(texts[lo:hi])))
            ids.append(d[lo:hi])
            hashes.append(th[lo:hi])
            entries += len(held[-1][0])
            if entries > FLUSH:
                yield from _pack(_joined(held, [len(x) for x in ids]), np.concatenate(ids), np.concatenate(hashes), buckets, hot)
                held, ids, hashes, entries = [], [], [], 0
    if held:
        yield from _pack(_joined(held, [len(x) for x in ids]), np.concatenate(ids), np.concatenate(hashes), buckets, hot)


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of runs: run number, place in the run and fingerprint."""
    sizes = np.array([len(t) for t in texts])
    prefix = prefix_hash(_BYTE[np.frombuffer(b"".join(texts), np.uint8)])
    count = sizes - WINDOW + 1
    row = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(np.cumsum(sizes) - sizes, count) + place
    return row, place, span_hash(prefix, at, at + WINDOW)


def _later(keys: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which windows a smaller document has too."""
    order = np.lexsort((d, keys))
    begin = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
    out = np.zeros(len(keys), bool)
    out[order] = d[order] > np.repeat(d[order][begin], np.diff(np.append(begin, len(order))))
    return out


def _pack_windows(held: list[tuple[int, int, int, bytes]], buckets: int) -> Iterator[tuple[int, bytes]]:
    """Windows of hot runs (d, th, pos, bytes) by bucket: those of the smallest document here, and spans that are known to go."""
    d, th, pos = (np.array(x, np.int64) for x in list(zip(*held, strict=True))[:3])
    row, place, keys = _windows([x[3] for x in held])
    start, gone = pos[row] + place, _later(keys, d[row])
    run, first, end = merged_spans(row[gone], start[gone], start[gone] + WINDOW)
    left = np.flatnonzero(~gone)
    bucket = (keys[left] % np.uint64(buckets)).astype(np.int64)
    by = left[np.argsort(bucket, kind="stable")]
    present, bounds = met(np.sort(bucket), len(run))
    span_bounds = np.linspace(0, len(run), len(present) + 1).astype(int)
    for i, k in enumerate(present.tolist()):
        mine, spans = by[bounds[i] : bounds[i + 1]], slice(span_bounds[i], span_bounds[i + 1])
        if len(mine) or spans.start < spans.stop:
            parts = [np.array([len(mine), spans.stop - spans.start]), keys[mine], d[row[mine]], th[row[mine]], start[mine], d[run[spans]], th[run[spans]], first[spans], end[spans] - first[spans]]
            yield k, b"".join(p.tobytes() for p in parts)


@freeing
def _cut_runs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The bytes under each open run; of hot ones the windows instead, at place -1."""
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "d", "th", "pos", "data"])

    held, windows = [], 0
    for batch in batches:
        rows = []
        for d, th, text, found in zip(batch.column("d").to_pylist(), batch.column("th").to_pylist(), as_bytes(batch.column("text")), batch.column("found").to_pylist(), strict=True):
            for f in found:
                data = text[f["pos"] : f["pos"] + f["size"]]
                if f["bucket"] >= 0:
                    rows.append((f["bucket"], d, th, f["pos"], data))
                    continue
                held.append((d, th, f["pos"], data))
                windows += len(data) - WINDOW + 1
                if windows > FLUSH:
                    yield out([(k, 0, 0, -1, x) for k, x in _pack_windows(held, buckets)])
                    held, windows = [], 0
        yield out(rows)
    if held:
        yield out([(k, 0, 0, -1, x) for k, x in _pack_windows(held, buckets)])


def _sort_packed(packed: list[bytes]) -> pd.DataFrame:
    """The last pass over windows of hot runs."""
    windows, spans = [], []
    for data in packed:
        n, m = np.frombuffer(data, np.int64, 2)
        x = np.frombuffer(data, np.int64, offset=16)
        windows.append(x[: 4 * n].reshape(4, n))
        spans.append(x[4 * n :].reshape(4, m))
    keys, d, th, start = np.concatenate(windows, axis=1)
    if len(keys):
        gone = _later(keys, d)
        spans.append(np.stack([d[gone], th[gone], start[gone], np.full(gone.sum(), WINDOW)]))
    d, th, pos, size = np.concatenate(spans, axis=1)
    return pd.DataFrame({"d": d, "th": th, "pos": pos.astype(np.int32), "size": size.astype(np.int32)})


def _sort_runs(rows: pd.DataFrame) -> pd.DataFrame:
    """The last pass over runs of one bucket."""
    row, place, keys = _windows(rows["data"].tolist())
    gone = np.flatnonzero(_later(keys, rows["d"].to_numpy()[row]))
    start = place[gone] + rows["pos"].to_numpy()[row[gone]]
    mine, start, end = merged_spans(row[gone], start, start + WINDOW)
    return pd.DataFrame({"d": rows["d"].to_numpy()[mine], "th": rows["th"].to_numpy()[mine], "pos": start.astype(np.int32), "size": (end - start).astype(np.int32)})


def _sort_windows(rows: pd.DataFrame) -> pd.DataFrame:
    """The last pass: spans of windows that a smaller document's run has too. Equal windows have one anchor, so both kinds stand apart."""
    hot = rows["pos"] < 0
    parts = [_sort_packed(rows["data"][hot].tolist())] if hot.any() else []
    return pd.concat([*parts, _sort_runs(rows[~hot])] if not hot.all() else parts)


def _sort_bucket(rows: pd.DataFrame, hot: np.ndarray) -> pd.DataFrame:
    """Spans of a bucket's entries that go, and the runs (as spans that are open) to be told apart further; hot ones are in bucket -1."""
    parts = [_unpack(x) for x in rows["data"]]
    columns = _joined([p[0] for p in parts], [len(p[1]) for p in parts])
    ids, hashes = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    before = np.cumsum([0, *(len(p[1]) for p in parts[:-1])])
    row, start, end = (np.concatenate(x) for x in zip(*((p[3].astype(np.int64) + b, p[4], p[5]) for p, b in zip(parts, before, strict=True)), strict=True))
    order, new, gone = _owned(columns, ids)
    cut = order[gone]
    row = np.concatenate([row, columns[2][cut]])
    start, end = np.concatenate([start, columns[3][cut]]), np.concatenate([end, columns[3][cut].astype(np.int64) + columns[4][cut] + WINDOW])
    row, start, end = merged_spans(row, start, end)
    own = rows["bucket"].iloc[0]
    out = [(row, start, end - start, np.zeros(len(row), bool), np.full(len(row), own))]
    if len(order):
        # Anchors of several documents with several blocks, and hot ones: the smallest documents' runs of every block.
        common = _is_hot(columns[0][order], hot)
        open_ = (common | _shared(columns[0][order], ids[columns[2][order]], new)) & ~gone
        further = order[open_]
        out.append((columns[2][further].astype(np.int64), columns[3][further].astype(np.int64), columns[4][further].astype(np.int64) + WINDOW, np.ones(len(further), bool), np.where(common[open_], -1, own)))
    row, pos, size, open_, bucket = (np.concatenate(x) for x in zip(*out, strict=True))
    return pd.DataFrame({"d": ids[row], "th": hashes[row], "pos": pos.astype(np.int32), "size": size.astype(np.int32), "open": open_, "bucket": bucket.astype(np.int32)})


@freeing
def _apply(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, found in zip(as_bytes(batch.column("text")), batch.column("found").to_pylist(), strict=True):
            places = np.array([(f["pos"], f["pos"] + f["size"]) for f in found or []], np.int64).reshape(-1, 2)
            _, start, end = merged_spans(np.zeros(len(places), np.int64), places[:, 0], places[:, 1])
            kept, at = [], 0
            for a, b in zip(start.tolist(), end.tolist(), strict=True):
                kept.append(text[at:a])
                at = b
            rest = b"".join([*kept, text[at:]])
            rows.append((int((end - start).sum()), len(start), rest.decode(errors="ignore") if as_text else rest))
        kinds = (pa.int64(), pa.int64(), pa.string() if as_text else pa.binary())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 3, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("carried"), *columns], ["d", "carried", "n_removed", "n_spans", "kept"])


def _by_row(spans: DataFrame, *more: str) -> DataFrame:
    """The spans of one document as one array; their number is bounded by its length."""
    return spans.groupBy("d", "th").agg(F.collect_list(F.struct("pos", "size", *more)).alias("found"))


def _keyed(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_LARGEST))


def without_repeats(docs: DataFrame, carry: list[Column | str] | None = None, as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, carried) of every row of `docs` (doc_id, text).

    Every byte of a text's UTF-8 that lies in a string of WINDOW bytes which also occurs in a document
    with a smaller doc_id is removed; kept is the rest, as bytes, or, with
    `as_text`, as text without characters that lost a byte. Repeats within a document stay, as
    do those of rows with the same doc_id. A null text is empty; a null doc_id counts as the largest possible.
    carried is a struct of the columns named in `carry`; other columns are ignored; no rows give none.
    """
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), (F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))).alias("rest"))
    texts = text_batches(docs).select(own.alias("carried"), _keyed(F.col("doc_id")).alias("d"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    hot = hot_anchors(texts)
    first = texts.mapInArrow(partial(_map_runs, buckets=buckets, hot=hot), _PACKED)
    found = staged(first.groupBy("bucket").applyInPandas(lambda rows: _sort_bucket(rows, hot), _SPANS))
    further = texts.join(_by_row(found.where("open"), "bucket"), ["d", "th"], "left").where("found is not null").mapInArrow(partial(_cut_runs, buckets=buckets), "bucket int, d long, th long, pos int, data binary")
    second = further.groupBy("bucket").applyInPandas(lambda rows: _sort_windows(rows), "d long, th long, pos int, size int")
    gone = found.where("not open").select("d", "th", "pos", "size").unionByName(second)
    kind = T.StructType.fromDDL(f"d long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}").add(texts.schema["carried"])
    kind = T.StructType([kind["d"], kind["carried"], kind["n_removed"], kind["n_spans"], kind["kept"]])
    out = texts.join(_by_row(gone), ["d", "th"], "left").mapInArrow(partial(_apply, as_text=as_text), kind)
    n_bytes = (F.octet_length("kept") + F.col("n_removed")).cast("long").alias("n_bytes")
    return out.select(F.col("carried.doc_id").alias("doc_id"), n_bytes, "n_removed", "n_spans", "kept", F.col("carried.rest").alias("carried"))
