"""Quality by a generalised additive model with pairwise interactions.

Features of the text alone are cut into bins at the training rows' quantiles. Shallow trees, boosted
in cycles over the features, add up to one lookup table for each feature; then trees over the
strongest pairs add up to a table for each pair. A score is the sum of the table entries of a
document's bins, through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.words import as_bytes, chunks, freeing, word_hashes
from corpusmill.plans.staging import text_batches

#: Labelled rows for fitting at most, bins of a feature, bins of a feature in a pair, pairs, cycles and step.
TRAINING_ROWS, BINS, PAIR_BINS, PAIRS, CYCLES, RATE, RIDGE = 10_000, 32, 8, 6, 120, 0.15, 2.0
FEATURES = ["log_words", "word_length", "symbols", "marks", "capitals", "digits", "bars", "distinct", "adjacent", "dup_lines", "line_words", "short_words", "non_ascii"]
_IS = {name: np.zeros(256, bool) for name in ("symbol", "mark", "upper", "lower", "digit", "bar", "wide", "line")}
for _name, _bytes in {"symbol": b"#*$%&|<>", "mark": b"!?", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "bar": b"|", "wide": bytes(range(128, 256)), "line": b"\n"}.items():
    _IS[_name][[*_bytes]] = True


def _per(owner: np.ndarray, rows: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weight, rows)


def _distinct(keys: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return _per(o[new], rows)


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    n = len(texts)
    words, owner, start, end, data = word_hashes(texts)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])[:n]
    count = {k: np.diff(np.append(0, np.cumsum(table[data]))[np.minimum(np.append(bounds, len(data)), len(data))]) for k, table in _IS.items()}
    m = np.maximum(_per(owner, n), 1)
    size = np.maximum([len(t) for t in texts], 1)
    # Each line's words, by number of the line, and one key for a line from its words in order.
    line = np.append(0, np.cumsum(data == 10))[start] + owner
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
    mixed = words * (np.arange(len(words), dtype=np.uint64) - np.repeat(first, np.diff(np.append(first, len(words)))).astype(np.uint64) + np.uint64(1)) if len(words) else words
    keys = np.add.reduceat(mixed, first) if len(first) else words
    of_line = owner[first]
    lines = np.maximum(_per(of_line, n), 1)
    same = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    letters = np.maximum(count["upper"] + count["lower"], 1)
    columns = [
        np.log1p(_per(owner, n)), _per(owner, n, end - start) / m, count["symbol"] / m, count["mark"] / m, count["upper"] / letters, count["digit"] / size, count["bar"] / m,
        _distinct(words, owner, n) / m, _per(owner[1:][same], n) / m, 1 - _distinct(keys, of_line, n) / lines, np.log1p(m / lines), _per(owner, n, end - start <= 3) / m, count["wide"] / size,
    ]
    out = np.column_stack(columns).astype(np.float64)
    out[_per(owner, n) == 0] = 0
    return out


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best border between ordered bins, and what it gains."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    gain = left_g**2 / (left_h + RIDGE) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + RIDGE))


def tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """What a tree of depth 2 over one feature's bins adds to each bin."""
    out = np.zeros(len(g))
    _, middle = _split(g, h)
    for lo, hi in ((0, middle), (middle, len(g))):
        if lo < hi:
            _, k = _split(g[lo:hi], h[lo:hi])
            for a, b in ((lo, lo + k), (lo + k, hi)):
                if a < b:
                    out[a:b] = _leaf(g[a:b], h[a:b])
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The better tree that splits one feature of a pair and then the other: its gain, and what it adds to each cell."""
    best = (-1.0, np.zeros_like(g))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        gain, middle = _split(a.sum(axis=1), b.sum(axis=1))
        out = np.zeros_like(a)
        for rows in (slice(0, middle), slice(middle, len(a))):
            ga, hb = a[rows].sum(axis=0), b[rows].sum(axis=0)
            more, k = _split(ga, hb)
            gain += more
            out[rows, :k], out[rows, k:] = _leaf(ga[:k], hb[:k]), _leaf(ga[k:], hb[k:])
        if gain > best[0]:
            best = (gain, out.T if turned else out)
    return best


@dataclass(frozen=True)
class Model:
    borders: list[np.ndarray]
    pair_borders: list[np.ndarray]
    bias: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the table entries of each row's bins."""
        out = np.full(len(x), self.bias)
        for k, table in enumerate(self.tables):
            out += table[np.searchsorted(self.borders[k], x[:, k], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[np.searchsorted(self.pair_borders[a], x[:, a], side="right"), np.searchsorted(self.pair_borders[b], x[:, b], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _borders(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.arange(1, bins) / bins)) if len(c) else np.zeros(0) for c in x.T]


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model fitted on rows of features and labels of 0 or 1; with one label alone it is constant."""
    borders, coarse = _borders(x, BINS), _borders(x, PAIR_BINS)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    tables = [np.zeros(len(b) + 1) for b in borders]
    if not len(y) or y.min() == y.max():
        return Model(borders, coarse, bias, tables, [], [])
    bins = [np.searchsorted(b, c, side="right") for b, c in zip(borders, x.T, strict=True)]
    cells = [np.searchsorted(b, c, side="right") for b, c in zip(coarse, x.T, strict=True)]
    margin = np.full(len(y), bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        return y - p, p * (1 - p)

    for _ in range(CYCLES):
        for k, at in enumerate(bins):
            g, h = slopes()
            more = RATE * tree(np.bincount(at, g, len(tables[k])), np.bincount(at, h, len(tables[k])))
            tables[k] += more
            margin += more[at]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, h = slopes()
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        at = cells[a] * shape[1] + cells[b]
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape), at

    gains = {p: pair_tree(*grid(*p)[:2])[0] for p in combinations(range(x.shape[1]), 2)}
    pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in pairs]
    for _ in range(CYCLES // 2):
        for k, p in enumerate(pairs):
            g, h, at = grid(*p)
            more = RATE * pair_tree(g, h)[1]
            pair_tables[k] += more
            margin += more.reshape(-1)[at]
    return Model(borders, coarse, bias, tables, pairs, pair_tables)


@freeing
def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        for lo, hi in chunks([len(t) for t in texts]):
            x = features(texts[lo:hi])
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), rows], ["doc_id", "x"])


@freeing
def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        for lo, hi in chunks([len(t) for t in texts]):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(model.score(features(texts[lo:hi])))], ["doc_id", "score"])


def held_out(doc_id: Column) -> Column:
    """Rows that fitting never sees: crc32 of doc_id as text, modulo 3, is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """A model fitted on at most TRAINING_ROWS labelled documents outside the held-out fold, chosen by a hash of doc_id."""
    text_batches(docs)
    rows = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"))  # of several labels the worst counts
    # At most TRAINING_ROWS ids and labels are broadcast, and as many rows of features come to the driver.
    chosen = rows.orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id").limit(TRAINING_ROWS)
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    found = texts.mapInArrow(_featured, "doc_id long, x array<double>").join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "x").limit(TRAINING_ROWS).toPandas()
    x = np.array(found["x"].tolist(), np.float64).reshape(len(found), len(FEATURES))
    return fit(x, found["y"].to_numpy(np.float64))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs` (doc_id, text).

    The model learns from `labels` (doc_id, quality) outside the held-out fold; a score depends on
    the text alone. Null texts are empty and are scored like empty ones. Repeated rows are scored
    one by one; a null doc_id is not held out; other columns are ignored. Without labels of both
    kinds all scores are the same.
    """
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_scored, model=trained(docs, labels)), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
