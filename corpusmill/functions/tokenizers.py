"""Tokenizers: anything that has a name and tells where the tokens of a text lie."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator
from functools import partial
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# What words consist of and what parts tokens; any other character is a token of its own.
_WORD, _BLANK = re.compile(r"\w+"), re.compile(r"\s+")


@functools.cache
def _kinds() -> np.ndarray:
    """For every code point: 0 for white space, 1 inside words, 2 for single signs, as `re` has them."""
    every = "".join(map(chr, range(0x110000)))
    kinds = np.full(len(every), 2, np.uint8)
    for kind, pattern in enumerate((_BLANK, _WORD)):
        for m in pattern.finditer(every):
            kinds[m.start() : m.end()] = kind
    return kinds


@functools.cache
def word_characters() -> np.ndarray:
    """For every code point whether words consist of it."""
    return _kinds() == 1


class Tokenizer(Protocol):
    """`spans` gives first and end places, in characters and in order, of a text's tokens."""

    name: str

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]: ...


class Words:
    """The default: words and single signs."""

    name = "words"

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        kinds = _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        edges, signs = np.diff((kinds == 1).astype(np.int8), prepend=0, append=0), kinds == 2
        return np.flatnonzero(signs | (edges[:-1] == 1)), np.flatnonzero(signs | (edges[1:] == -1)) + 1


@functools.lru_cache(4)
def _loaded(path: str):  # noqa: ANN202 - the library's own type
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


class Library:
    """A tokenizer of the `tokenizers` library by its file; each task reads the file itself."""

    def __init__(self, path: str):
        self.path, self.name = path, os.path.basename(path)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = np.array(_loaded(self.path).encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]


def overlapping(first: np.ndarray, last: np.ndarray, start: int, end: int) -> int:
    """How many of the tokens overlap [start, end)."""
    return max(0, int(np.searchsorted(first, end) - np.searchsorted(last, start, side="right")))


def offsets(texts: pa.Array, tokenizer: Tokenizer) -> pa.ListArray:
    """The spans of all texts' tokens, a list for each; null where the text is null."""
    spans = [None if t is None else tokenizer.spans(t) for t in texts.to_pylist()]
    sizes = [0 if s is None else len(s[0]) for s in spans]
    first, last = (np.concatenate([s[k] for s in spans if s is not None] or [np.zeros(0, np.int64)]).astype(np.int32) for k in (0, 1))
    bounds = pa.array(np.cumsum([0, *sizes]), pa.int32(), mask=np.array([*(s is None for s in spans), False]))
    return pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(first), pa.array(last)], ["first", "last"]))


def _with_spans(batches: Iterator[pa.RecordBatch], text: str, tokenizer: Tokenizer, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, offsets(batch.column(text), tokenizer)], names)


def with_token_spans(rows: DataFrame, text: str, tokenizer: Tokenizer | None = None, name: str = "spans") -> DataFrame:
    """`rows` with an array of (first, last) of the tokens of the column `text`; last is the place behind a token."""
    kind = T.StructType([*rows.schema, T.StructField(name, T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])))])
    return rows.mapInArrow(partial(_with_spans, text=text, tokenizer=tokenizer or Words(), names=kind.names), kind)
