"""Oversized texts to parts: borders as rows, rules as columns, units by windows, packing as a stream.

Each text gives a row for every place where it might be cut, with what speaks for and against it. Which
of them are cuts, which paragraphs are too long and fall into sentences, and how large the units between
cuts are is then the work of column expressions over all texts' borders together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.functions.tokenizers import Tokenizer
from corpusmill.operators import splitting as sp
from corpusmill.plans.staging import text_batches

_NUMBERS = ["kind", "place", "stop", "begin", "after", "stop_tokens", "begin_tokens", "solid"]
_SIGNS = [name.replace(" ", "_") for name in sp.SIGNS]
_BORDERS = T.ArrayType(T.StructType([*(T.StructField(n, T.IntegerType()) for n in _NUMBERS), *(T.StructField(n, T.BooleanType()) for n in _SIGNS)]))


_FORMULAS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


def _formulas(batches: Iterator[pa.RecordBatch], text: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Spans go from text to text into arrays of numbers: as objects, a batch's would take a hundred times its size."""
    kinds = pa.array(["inline", "display"])
    for batch in batches:
        spans, sizes, null = [], [], []
        for x in batch.column(text).to_pylist():
            own = [np.fromiter(chain.from_iterable(found), np.int32).reshape(-1, 2) for found in (() if x is None else (sp.inline_math(x), sp.block_math(x)))]
            spans += own
            sizes += [len(s) for s in own] or [0, 0]
            null.append(x is None)
        first, last = np.concatenate([*spans, np.zeros((0, 2), np.int32)]).T.copy()
        number = np.repeat(np.arange(len(sizes), dtype=np.int32) % 2, sizes)
        bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)[1::2]]), pa.int32(), mask=np.array([*null, False]))
        found = pa.StructArray.from_arrays([kinds.take(pa.array(number)), pa.array(first), pa.array(last)], ["kind", "first", "last"])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(bounds, found)], names)


def math_spans(rows: DataFrame, text: str, name: str = "spans") -> DataFrame:
    """`rows` with an array of (kind, first, last) of the formulas in the column `text`, inline and display; last is the place behind one."""
    kind = T.StructType([*rows.schema, T.StructField(name, _FORMULAS)])
    return rows.mapInArrow(partial(_formulas, text=text, names=kind.names), kind)


def _measure(batches: Iterator[pa.RecordBatch], tokenizer: Tokenizer, max_tokens: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, found = [], []
        for text in batch.column("text").to_pylist():
            spans = tokenizer.spans(text) if text else ([], [])
            counts.append(len(spans[0]))
            found.append(sp.Splitter(text, tokenizer, spans).borders() if counts[-1] > max_tokens else None)
        rows = [f for f in found if f is not None]
        column = lambda name, kind: pa.array(np.concatenate([r[name] for r in rows]) if rows else np.zeros(0), kind)  # noqa: E731, B023
        parts = [column(n, pa.int32()) for n in _NUMBERS] + [column(n, pa.bool_()) for n in sp.SIGNS]
        bounds = np.cumsum([0, *(0 if f is None else len(f["kind"]) for f in found)])
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32(), mask=np.array([*(f is None for f in found), False])), pa.StructArray.from_arrays(parts, _NUMBERS + _SIGNS))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int32()), lists], names)


def measured(rows: DataFrame, tokenizer: Tokenizer, max_tokens: int) -> DataFrame:
    """`rows` with tokens, the number of tokens of `text`, and borders, which are null where these are at most max_tokens."""
    kind = T.StructType([*rows.schema, T.StructField("tokens", T.IntegerType()), T.StructField("borders", _BORDERS)])
    return rows.mapInArrow(partial(_measure, tokenizer=tokenizer, max_tokens=max_tokens, names=kind.names), kind)


def cuts(found: DataFrame, keys: list[str], max_tokens: int) -> DataFrame:
    """(keys, place, kind, stop, begin, stop_tokens, begin_tokens, solid) of the borders at which texts are cut: (keys, borders) are given.

    Paragraphs end where no rule says that they go on. A sentence's end cuts only inside a paragraph of
    more than max_tokens tokens, and where the sentence doesn't go on. A text's end is always a cut.
    """
    rows = found.where("borders is not null").select(*keys, F.inline("borders"))
    signs = {name: F.col(column) for name, column in zip(sp.SIGNS, _SIGNS, strict=True)}
    ends = (F.col("kind") == sp.END) | ((F.col("kind") == sp.PARAGRAPH) & ~sp.holds(sp.SAME_PARAGRAPH, signs))
    rows = rows.withColumns({"ends": ends, "apart": (F.col("kind") == sp.SENTENCE) & ~sp.holds(sp.SAME_SENTENCE, signs)}).where("ends or apart").drop(*_SIGNS)
    order = Window.partitionBy(*keys).orderBy("place", "kind")
    own = lambda *names: F.when(F.col("ends"), F.struct(*names))
    last = F.last(own("begin", "begin_tokens"), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # What follows is what came before from the other end, where a frame grows instead of being read anew for each row.
    back = Window.partitionBy(*keys).orderBy(F.desc("place"), F.desc("kind"))
    following = F.last(own("stop", "stop_tokens"), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"last": last, "next": following})
    size = F.col("next.stop_tokens") - F.coalesce("last.begin_tokens", F.lit(0))
    inside = F.col("apart") & (size > max_tokens) & (F.col("stop") < F.col("next.stop")) & (F.col("after") < F.col("next.stop")) & (F.col("place") >= F.coalesce("last.begin", F.lit(0)))
    return rows.where(F.col("ends") | inside).select(*keys, "place", "kind", "stop", "begin", "stop_tokens", "begin_tokens", "solid")


def units(found: DataFrame, keys: list[str], max_tokens: int) -> DataFrame:
    """(keys, start, end, tokens) of what lies between cuts: paragraphs, and sentences of long ones; blank ones go."""
    order = Window.partitionBy(*keys).orderBy("place", "kind")
    start, tokens = F.coalesce(F.lag("begin").over(order), F.lit(0)), F.coalesce(F.lag("begin_tokens").over(order), F.lit(0))
    between = cuts(found, keys, max_tokens).withColumns({"start": start, "passed": tokens}).where("start < stop and solid >= start")
    return between.select(*keys, "start", F.col("stop").alias("end"), F.greatest(F.col("stop_tokens") - F.col("passed"), F.lit(0)).alias("tokens"))


def _windows(batches: Iterator[pa.RecordBatch], keys: int, kinds: list[pa.DataType], max_tokens: int, overlap: int, least: int) -> Iterator[pa.RecordBatch]:
    """Each text's units, which follow one another, as packed windows."""
    now, held = None, []
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def given(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) if done else [[]] * (keys + 1)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*kinds, span], strict=True)], [*(f"key{k}" for k in range(keys)), "windows"])

    def closed() -> list[tuple]:
        if not held:
            return []
        packed = [w for w in sp.pack(held, max_tokens, overlap) if w.end > w.start]
        packed = sp.merge_small(packed, least) if least > 0 and len(packed) > 1 else packed
        return [(*now, [{"start": w.start, "end": w.end} for w in packed])]

    for batch in batches:
        done = []
        for *key, start, end, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                done += closed()
                now, held = key, []
            held.append(sp.Window(start, end, tokens))
        yield given(done)
    yield given(closed())


def _sliced(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The windows of each text; a slice costs its own length here, and the length of all before it on UTF-8."""
    for batch in batches:
        *rest, texts, windows = batch.columns
        cut = [[text[w["start"] : w["end"]] for w in own] for text, own in zip(texts.to_pylist(), windows.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(cut, pa.list_(pa.string()))], names)


def parts(found: DataFrame, keys: list[str], max_tokens: int, overlap: int = 0, least: int = 20, carry: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, carry, parts) of `measured` texts (keys, text, borders) above max_tokens: the texts of their windows, in order.

    Windows hold consecutive units of at most max_tokens tokens together, or one longer unit; with an
    overlap the next begins where at most that many tokens are left. Windows below `least` characters
    join the next. `keys` are different for every text.
    """
    lined = units(found, keys, max_tokens).repartition(*keys).sortWithinPartitions(*keys, "start")
    kinds = [found.schema[k].dataType for k in keys]
    kind = T.StructType([*(T.StructField(f"key{k}", t) for k, t in enumerate(kinds)), T.StructField("windows", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    work = partial(_windows, keys=len(keys), kinds=[to_arrow_type(t) for t in kinds], max_tokens=max_tokens, overlap=overlap, least=least)
    windows = lined.mapInArrow(work, kind)
    same = [F.col(k).eqNullSafe(F.col(f"key{n}")) for n, k in enumerate(keys)]
    met = found.where("borders is not null").select(*keys, *carry, "text").join(windows, same).select(*keys, *carry, "text", "windows")
    texts = T.StructType([*(met.schema[c] for c in (*keys, *carry)), T.StructField("parts", T.ArrayType(T.StringType()))])
    return text_batches(met).mapInArrow(partial(_sliced, names=texts.names), texts)
