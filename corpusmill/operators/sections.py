"""Markdown documents to a tree of section and part nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.functions import text as t
from corpusmill.functions.tokenizers import Tokenizer, Words
from corpusmill.operators.parts import measured, parts
from corpusmill.plans.staging import staged, text_batches

MAX_TOKENS, MIN_CHARS = 256, 20
# Characters that no text has mark where headings begin, where their marks end and where they end.
_A, _B, _C = "﷐", "﷑", "﷒"
_HEADING = r"(?dmU)^(#{1,6})\s+(.+)$"


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, level, title, body, last) of every heading of docs (doc_id, text), in document order from 0.

    Text before the first heading belongs to no section. last marks a document's last heading.
    """
    marked = F.contains("text", F.lit(_A)) | F.contains("text", F.lit(_B)) | F.contains("text", F.lit(_C))
    bare = F.when(marked, F.translate("text", _A + _B + _C, "")).otherwise(F.col("text"))
    parts = F.split(F.regexp_replace(bare, _HEADING, f"{_A}$1{_B}$2{_C}"), _A)
    # Parts become rows before they are looked into, so that the rest is compiled code on plain columns.
    found = docs.select("doc_id", parts.alias("parts")).select("doc_id", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "part")).where("k > 0")
    title = F.substring_index(F.substring_index("part", _B, -1), _C, 1)
    return found.select(
        "doc_id", (F.col("k") - 1).alias("pos"), F.length(F.substring_index("part", _B, 1)).alias("level"), t.strip(title).alias("title"),
        t.strip(F.substring_index("part", _C, -1)).alias("body"), (F.col("k") == F.col("n") - 1).alias("last"),
    )


def without_headings(docs: DataFrame) -> DataFrame:
    """Rejects: documents that can't be cut; the others go on."""
    return docs.where(F.coalesce(F.regexp_count("text", F.lit(_HEADING)), F.lit(0)) == 0)


def _walk(batches: Iterator[pa.RecordBatch], keep: bool, nest: bool, least: int | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Headings sorted by document and place, each taken once: a level that is being dropped, a stack of open sections and a short text are all that is remembered."""
    doc, limit, open_, held = object(), None, [], ""
    for batch in batches:
        of = lambda c: batch.column(c).to_pylist()  # noqa: E731, B023
        ids, n = of("doc_id"), batch.num_rows
        levels = of("level") if keep or nest else None
        drop = of("drop") if keep else None
        places, titles = (of("pos"), of("title")) if nest else (None, None)
        last, body = (of("last"), batch.column("body")) if least is not None else (None, None)
        sizes = pc.fill_null(pc.utf8_length(body), 0).to_pylist() if least is not None else None
        kept, parents, paths, moved = [], [], [], {}
        for i in range(n):
            if ids[i] != doc:
                doc, limit, open_, held = ids[i], None, [], ""
            if keep:
                limit = levels[i] if drop[i] else None if limit is not None and levels[i] <= limit else limit
                if limit is not None:
                    continue
            if nest:
                while open_ and open_[-1][0] >= levels[i]:
                    open_.pop()
                parents.append(open_[-1][1] if open_ else None)
                paths.append(f"{open_[-1][2]}/{titles[i]}" if open_ else titles[i])
                open_.append((levels[i], places[i], paths[-1]))
            if least is not None and (held or sizes[i] < least):
                whole = "\n".join(x for x in (held, body[i].as_py()) if x)
                held = whole if not last[i] and 0 < len(whole) < least else ""
                moved[len(kept)] = "" if held else whole
            kept.append(i)
        columns = batch.columns if len(kept) == n else [c.take(pa.array(kept, pa.int64())) for c in batch.columns]
        if nest:
            columns += [pa.array(parents, pa.int32()), pa.array(paths, pa.string())]
        if least is not None:
            own = columns[batch.schema.get_field_index("body")]
            mask = np.zeros(len(own), bool)
            mask[list(moved)] = True
            columns.append(pc.replace_with_mask(own, pa.array(mask), pa.array([moved[k] for k in sorted(moved)], own.type)))
        yield pa.RecordBatch.from_arrays(columns, names)


def _walked(rows: DataFrame, keep: bool = False, nest: bool = False, least: int | None = None) -> DataFrame:
    """`rows` after one pass over each document's headings in order."""
    if keep:
        rows = rows.withColumn("drop", F.coalesce(t.is_boilerplate(t.normal_title(F.col("title"))), F.lit(False)))
    more = [T.StructField("parent_pos", T.IntegerType()), T.StructField("path", T.StringType())] if nest else []
    more += [T.StructField("text", T.StringType())] if least is not None else []
    kind = T.StructType([*rows.schema, *more])
    lined = text_batches(rows).repartition("doc_id").sortWithinPartitions("doc_id", "pos")
    out = lined.mapInArrow(partial(_walk, keep=keep, nest=nest, least=least, names=kind.names), kind)
    return out.drop("drop") if keep else out


def kept_sections(rows: DataFrame) -> DataFrame:
    """Headings without boilerplate sections and what lies below them.

    A boilerplate heading drops what follows until a heading of its level or a higher one. One
    inside a dropped part counts as the last, so a later heading beside it is kept again.
    """
    return _walked(rows, keep=True)


def with_hierarchy(rows: DataFrame) -> DataFrame:
    """Adds parent_pos (null at the top) and path: titles from the top, with slashes.

    A section's parent is the last section of a lower level before it.
    """
    return _walked(rows, nest=True)


def with_carried(rows: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """Adds text: the section's own, after short texts carried from the sections before.

    A text shorter than `least` characters moves to the next kept section, unless it stands at the
    document's last heading. What is carried past the last kept section is lost.
    """
    return _walked(rows, least=least)


def kept_tree(rows: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """`kept_sections`, `with_hierarchy` and `with_carried` in one pass."""
    return _walked(rows, keep=True, nest=True, least=least)


def _called(frames: object, split: Callable[[str], list[str]]) -> object:
    for pdf in frames:
        out = pdf.assign(parts=[list(split(x)) for x in pdf["text"]])
        yield out[["doc_id", "pos", "path", "parts"]]


def nodes(
    docs: DataFrame, split: Callable[[str], list[str]] | None = None, max_tokens: int = MAX_TOKENS, min_chars: int = MIN_CHARS,
    metadata: dict[str, str] | None = None, tokenizer: Tokenizer | None = None, overlap: int = 0,
) -> DataFrame:
    """The chunk tree of docs (doc_id, text): a node for each kept section, and parts of oversized ones.

    Columns: node_id, doc_id, pos, part (0 for a section), parent_id, prev_id, next_id, title, path,
    text ('' where a node only holds others) and metadata, which names tokenizer, strategy, max_tokens
    and overlap. Tokens are those of `tokenizer`, for the limit, for packing and for the overlap. A
    text above `max_tokens` is cut at paragraphs and sentences; `split` may be another way to cut it,
    any callable on one string, which runs in Arrow batches on these texts only.
    """
    tokenizer = tokenizer or Words()
    rows = kept_tree(headings(docs), min_chars).select("doc_id", "pos", "title", "path", "parent_pos", "text")
    rows = staged(measured(rows, tokenizer, max_tokens)).withColumn("oversized", F.col("borders").isNotNull())
    section_id = lambda pos: F.when(pos.isNotNull(), t.node_id(F.col("doc_id"), pos, F.lit(0)))
    shape = ["doc_id", "pos", "part", "parent_id", "prev_id", "next_id", "title", "path", "text"]
    none = F.lit(None).cast("string")
    tops = rows.withColumns({"part": F.lit(0), "parent_id": section_id(F.col("parent_pos")), "prev_id": none, "next_id": none, "text": F.when(F.col("oversized"), "").otherwise(F.col("text"))}).select(*shape)
    big = rows.where("oversized")
    if split is None:
        cut = parts(big, ["doc_id", "pos"], max_tokens, overlap, min_chars, ["path"])
    else:
        kind = big.schema["doc_id"].dataType.simpleString()
        cut = text_batches(big.select("doc_id", "pos", "path", "text")).mapInPandas(lambda frames: _called(frames, split), f"doc_id {kind}, pos int, path string, parts array<string>")
    cut = cut.withColumn("parts", F.filter("parts", lambda x: x != ""))
    cut = cut.select("doc_id", "pos", "path", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "text")).withColumn("part", F.col("k") + 1)
    part_id = lambda k: t.node_id(F.col("doc_id"), F.col("pos"), k)
    title = F.concat(F.lit("part "), F.col("part").cast("string"))
    pieces = cut.withColumns({
        "parent_id": part_id(F.lit(0)), "title": title, "path": F.concat_ws("/", "path", title),
        "prev_id": F.when(F.col("part") > 1, part_id(F.col("part") - 1)), "next_id": F.when(F.col("part") < F.col("n"), part_id(F.col("part") + 1)),
    }).select(*shape)
    out = tops.unionByName(pieces)
    strategy = "paragraphs and sentences" if split is None else getattr(split, "__name__", "split")
    stamps = {"max_tokens": str(max_tokens), "overlap": str(overlap), "tokenizer": tokenizer.name, "strategy": strategy}
    own = F.create_map(F.lit("title"), F.col("title"), F.lit("path"), F.col("path"), *(F.lit(x) for kv in stamps.items() for x in kv))
    given = F.create_map(*(F.lit(x) for kv in metadata.items() for x in kv)) if metadata else None
    stamp = F.map_concat(F.map_filter(given, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own) if given is not None else own
    return out.select(t.node_id(F.col("doc_id"), F.col("pos"), F.col("part")).alias("node_id"), *shape, stamp.alias("metadata"))


def _pack(batches: Iterator[pa.RecordBatch], max_tokens: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Windows of units sorted by document and number: prefix sums of tokens tell where each ends; only the open window is remembered."""
    doc, number, open_ = object(), 0, None

    def given(windows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*windows, strict=True) if windows else [[]] * 5
        kinds = (kind, pa.int32(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "window", "first", "last", "tokens"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, (units, tokens) = batch.column(0), (batch.column(c).to_numpy() for c in (1, 2))
        codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        bounds, done = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(ids)], []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if (own := ids[lo].as_py()) != doc:
                done += [(doc, number, *open_)] if open_ else []
                doc, number, open_ = own, 0, None
            sums, at = np.append(0, np.cumsum(tokens[lo:hi])), 0
            while at < hi - lo:
                held = open_[2] if open_ else 0
                end = int(np.searchsorted(sums, sums[at] + max_tokens - held, side="right")) - 1
                if open_ and end <= at:
                    done.append((doc, number, *open_))
                    number, open_ = number + 1, None
                    continue
                end = max(end, at + 1)
                open_ = (open_[0] if open_ else int(units[lo + at]), int(units[lo + end - 1]), held + int(sums[end] - sums[at]))
                at = end
        yield given(done)
    yield given([(doc, number, *open_)] if open_ else [])


def packed(units: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, window, first, last, tokens) of units (doc_id, unit, tokens): consecutive units in windows of at most max_tokens.

    A unit above the limit has a window of its own. There is no overlap.
    """
    lined = units.select("doc_id", F.col("unit").cast("int"), F.col("tokens").cast("long")).repartition("doc_id").sortWithinPartitions("doc_id", "unit")
    id_ = units.schema["doc_id"].dataType
    return lined.mapInArrow(partial(_pack, max_tokens=max_tokens, kind=to_arrow_type(id_)), f"doc_id {id_.simpleString()}, window int, first int, last int, tokens bigint")
