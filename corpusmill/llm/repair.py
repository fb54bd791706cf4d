"""Repair of conversations whose turns don't alternate, by the cheapest edits.

Roles must read as one optional system turn and then user and assistant in turn, or as nothing. A row
can be kept (0), given the role that is due (2) or deleted (3, the only way for blank and repeated
rows), and an empty turn of the role that is due can be inserted anywhere (2); a truncated row that
isn't deleted costs one more. Of the cheapest ways the one whose edits' initials come first in ASCII wins.

The search is a depth-first branch-and-bound: an explicit stack of open prefixes, lower bounds on the
cost of every suffix, the best solution so far as (cost, audit), and for each node, a row and the
role last given, a table of the best prefix that came there. Long conversations are searched by
stretches of STRETCH rows, for every role before and after; stretches are then put together by
tens, and tens of tens, so that one of very many rows is many tasks' work.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.words import freeing
from corpusmill.operators.ordered import placed
from corpusmill.plans.staging import staged, text_batches

#: Rows that are searched at once; stretches that are put together at once; rows of a batch that a stream gives.
STRETCH, TOGETHER, GIVEN = 16, 32, 1000
#: The role last given: none yet, system, user, assistant. Then which role is due, and where a conversation may end.
NONE, SYSTEM, USER, ASSISTANT = range(4)
DUE = (USER, USER, ASSISTANT, USER)
ENDS = (NONE, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
RELABEL, DELETE, INSERT = 2, 3, 2
#: What a row is to the search: its role (0: none of the three) + 4 if it must go, + 8 if it is truncated.
MUST_GO, TRUNCATED = 4, 8
_FAR = 1 << 40
_ENTRY = "array<struct<first:int,last:int,cost:bigint,audit:string>>"
_STRETCHES = f"conv_id long, stretch long, illegal long, head int, tail int, ways {_ENTRY}"
REPAIRED = "conv_id long, place long, turn long, role string, text string, edit string"


def _moves(code: int, last: int) -> list[tuple[str, int, int]]:
    """What can be done with a row after `last`: initial, cost, and the role then last."""
    out = [("D", DELETE, last)]
    if not code & MUST_GO:
        role, more = code & 3, int(code & TRUNCATED > 0)
        if role and (role == DUE[last] or role == SYSTEM and last == NONE):
            out.append(("K", more, role))
        out.append(("R", RELABEL + more, DUE[last]))
    return out


@functools.lru_cache(1 << 12)
def _pair(a: int, b: int | None) -> int:
    """The least cost of one row, or of two neighbours with inserts between, whatever stands around them."""
    ends = {}
    for last in range(4):
        for _, cost, then in _moves(a, last):
            ends[then] = min(cost, ends.get(then, cost))
    if b is None:
        return min(ends.values())
    for _ in range(2):
        for last, cost in list(ends.items()):
            ends[DUE[last]] = min(cost + INSERT, ends.get(DUE[last], _FAR))
    return min(cost + more for last, cost in ends.items() for _, more, _ in _moves(b, last))


def suffix_bounds(codes: tuple[int, ...]) -> list[int]:
    """For each row the least cost that it and the rows after it can have: single rows and neighbours that share no row."""
    least = [0] * (len(codes) + 2)
    for k in range(len(codes) - 1, -1, -1):
        least[k] = _pair(codes[k], None) + least[k + 1]
        if k + 1 < len(codes):
            least[k] = max(least[k], _pair(codes[k], codes[k + 1]) + least[k + 2])
    return least[: len(codes) + 1]


@functools.lru_cache(1 << 14)
def search(codes: tuple[int, ...], first: int = NONE, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """The least (cost, audit) that leads from `first` over all rows to one of `ends`; None if nothing does."""
    least, best, reached = suffix_bounds(codes), None, {}
    stack = [(0, "", 0, first)]
    while stack:
        cost, audit, at, last = stack.pop()
        if best is not None and (cost + least[at], audit) >= best:
            continue
        if reached.get((at, last), (_FAR, "")) <= (cost, audit):
            continue
        reached[at, last] = cost, audit
        if at == len(codes) and last in ends:
            best = cost, audit
        following = [(cost + INSERT, audit + "I", at, DUE[last])]
        if at < len(codes):
            following += [(cost + more, audit + letter, at + 1, then) for letter, more, then in _moves(codes[at], last)]
        # The most promising one comes off the stack first.
        stack += sorted(following, key=lambda x: (x[0] + least[x[2]], x[1]), reverse=True)
    return best


def _legal(a: int, b: int) -> bool:
    """Whether two neighbouring rows' roles follow each other."""
    return (a & 3, b & 3) in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


def _stretch(codes: list[int], number: int, size: int) -> tuple:
    """illegal neighbours, first and last row, and the best way for each role before and after, of one stretch."""
    codes = tuple(codes)
    if number == 0 and len(codes) < size:  # the only one of its conversation
        ways = [(NONE, ASSISTANT, *search(codes))]
    else:
        tried = ((a, b, search(codes, a, (b,))) for a in ([NONE] if number == 0 else range(4)) for b in range(4))
        ways = [(a, b, *found) for a, b, found in tried if found]
    return sum(not _legal(a, b) for a, b in zip(codes[:-1], codes[1:], strict=True)), codes[0], codes[-1], ways


def together(parts: list[tuple]) -> tuple:
    """One stretch from several that follow one another, each (illegal, head, tail, ways)."""
    illegal, head, tail, ways = parts[0]
    ways = {(a, b): (cost, audit) for a, b, cost, audit in ways}
    for more, first, last, further in parts[1:]:
        illegal, tail, new = illegal + more + (not _legal(tail, first)), last, {}
        for c, b, cost, audit in further:
            for a in range(4):
                if (before := ways.get((a, c))) is not None:
                    way = before[0] + cost, before[1] + audit
                    if (a, b) not in new or way < new[a, b]:
                        new[a, b] = way
        ways = new
    return illegal, head, tail, [(*k, *v) for k, v in ways.items()]


def _rows_of(found: list[tuple]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), kind)
    columns = zip(*found, strict=True) if found else [[]] * 6
    listed = [pa.array([[dict(zip(("first", "last", "cost", "audit"), w, strict=True)) for w in ways] for ways in c] if t is kind else list(c), t) for c, t in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(listed, ["conv_id", "stretch", "illegal", "head", "tail", "ways"])


def _searched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, numbers, codes = (batch.column(c).to_pylist() for c in ("conv_id", "stretch", "codes"))
        yield _rows_of([(i, k, *_stretch(c, k, size)) for i, k, c in zip(ids, numbers, codes, strict=True)])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, numbers, parts = (batch.column(c).to_pylist() for c in ("conv_id", "stretch", "parts"))
        of = lambda p: (p["illegal"], p["head"], p["tail"], [tuple(w.values()) for w in p["ways"]])
        yield _rows_of([(i, k, *together([of(p) for p in ps])) for i, k, ps in zip(ids, numbers, parts, strict=True)])


def _text_ends(mark: str) -> Column:
    return F.col("text").rlike(rf"{mark}[\x20\x09-\x0D]*\z")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, place, turn, blank, duplicate, truncated, code) of placed rows; of a row's faults the first counts."""
    marked = rows.select(
        "conv_id", "place", "turn", "role", F.sha2("text", 256).alias("sha"), (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~_text_ends("[.!?]")).alias("open"),
        F.when(F.col("role").startswith("s"), SYSTEM).when(F.col("role").startswith("u"), USER).when(F.col("role").startswith("a"), ASSISTANT).otherwise(0).alias("kind"),
    )
    # Only places are joined, which are all different, so no frequent text makes a large group.
    first = marked.groupBy("conv_id", "role", "sha").agg(F.min("place").alias("place")).select(F.col("conv_id").alias("c"), F.col("place").alias("p"), F.lit(True).alias("new"))
    met = marked.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p")), "left")
    duplicate = ~F.col("blank") & F.col("new").isNull()
    truncated = ~F.col("blank") & F.col("new").isNotNull() & F.col("open")
    code = F.col("kind") + F.when(F.col("blank") | F.col("duplicate"), MUST_GO).otherwise(0) + F.when(F.col("truncated"), TRUNCATED).otherwise(0)
    return met.withColumns({"duplicate": duplicate, "truncated": truncated}).select("conv_id", "place", "turn", "blank", "duplicate", "truncated", code.cast("int").alias("code"))


class Repair(NamedTuple):
    """rows (conv_id, turn, role, text, place) as they were taken, and one row for each conversation: its counts, cost and audit."""

    rows: DataFrame
    conversations: DataFrame


def repair(turns: DataFrame) -> Repair:
    """The cheapest repair of every conversation of `turns` (conv_id, turn, role, text).

    Rows stand by turn, nulls first; rows with one turn follow by role and text. A null role or text
    is one space. conversations has conv_id, gaps (turns that are missing between the least and the
    largest), blank, duplicate, truncated (rows, each by its first fault), illegal (neighbours whose
    roles don't follow each other), cost and audit. A row whose role begins with none of s, u and a
    can't be kept as it is. Null ids form one conversation; other columns have no effect; an empty
    table has no conversations.
    """
    filled = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    taken = text_batches(turns).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), filled("role"), filled("text"))
    rows = placed(taken.withColumn("row_no", F.monotonically_increasing_id()), "conv_id", ["turn", "role", "text", "row_no"], "place").drop("row_no")
    found = staged(faults(rows))
    counted = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    by_turn = found.groupBy("conv_id", "turn").agg(*(counted(c) for c in ("blank", "duplicate", "truncated")))
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    counts = by_turn.groupBy("conv_id").agg(span, *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))

    codes = F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x.code).alias("codes")
    stretches = found.groupBy("conv_id", F.expr(f"place div {STRETCH}").alias("stretch")).agg(codes)
    ways = staged(stretches.mapInArrow(partial(_searched, size=STRETCH), _STRETCHES))
    most = ways.agg(F.max("stretch")).first()[0] or 0
    done = []
    while most:
        # Only conversations of several stretches go into a further round.
        several = ways.where("stretch > 0").select(F.col("conv_id").alias("c")).distinct()
        same = F.col("conv_id").eqNullSafe(F.col("c"))
        done.append(ways.join(several, same, "left_anti"))
        parts = F.array_sort(F.collect_list(F.struct("stretch", "illegal", "head", "tail", "ways"))).alias("parts")
        grouped = ways.join(several, same, "left_semi").groupBy("conv_id", F.expr(f"stretch div {TOGETHER}").alias("stretch")).agg(parts)
        ways, most = staged(grouped.mapInArrow(_joined, _STRETCHES)), most // TOGETHER
    for part in done:
        ways = ways.unionByName(part)
    best = F.array_min(F.transform(F.filter("ways", lambda w: (w.first == NONE) & w.last.isin(*ENDS)), lambda w: F.struct(w.cost.alias("cost"), w.audit.alias("audit"))))
    solved = ways.select(F.col("conv_id").alias("c"), "illegal", best.alias("best"))
    both = counts.join(solved, F.col("conv_id").eqNullSafe(F.col("c")))
    return Repair(rows, staged(both.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The turns of repaired conversations, each of which is read as its audit and then its rows; a None ends one."""
    now, letters, last, place = None, "", NONE, 0

    def given(role: str) -> int:
        return {"s": SYSTEM, "u": USER}.get(role[:1], ASSISTANT)

    at = 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["place"] < 0:
                while now is not None and at < len(letters):
                    last, at = DUE[last], at + 1
                    yield now[0], place, None, NAMES[last], "", "I"
                    place += 1
                if now is not None:
                    yield now[0], None
                now, letters, at, last, place = (row["conv_id"],), row["text"], 0, NONE, 0
                continue
            while letters[at] == "I":
                last, at = DUE[last], at + 1
                yield now[0], place, None, NAMES[last], "", "I"
                place += 1
            letter, at = letters[at], at + 1
            if letter != "D":
                last = given(row["role"]) if letter == "K" else DUE[last]
                yield now[0], place, row["turn"], row["role"] if letter == "K" else NAMES[last], row["text"], letter
                place += 1
    if now is not None:
        while at < len(letters):
            last, at = DUE[last], at + 1
            yield now[0], place, None, NAMES[last], "", "I"
            place += 1
        yield now[0], None


@freeing
def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []

    def out() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in REPAIRED.split(", ")])
        held.clear()
        return made

    for turn in _edited(batches):
        if turn[1] is not None:
            held.append(turn)
        if len(held) >= GIVEN:
            yield out()
    yield out()


@freeing
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, state, begun = [], hashlib.sha256(), False

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.string())], ["conv_id", "repaired_sha256"])
        held.clear()
        return made

    for turn in _edited(batches):
        if turn[1] is None:
            held.append((turn[0], state.hexdigest()))
            state, begun = hashlib.sha256(), False
        else:
            state.update(f"{chr(10) if begun else ''}{turn[3]}:{turn[4]}".encode())
            begun = True
        if len(held) >= GIVEN:
            yield out()
    yield out()


def _in_order(made: Repair) -> DataFrame:
    """Each conversation's audit and then its rows, dealt by conversation: a stream that is never held whole."""
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    audits = made.conversations.select("conv_id", null("long", "turn"), null("string", "role"), F.col("audit").alias("text"), F.lit(-1).cast("long").alias("place"))
    return made.rows.unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", "place")


def repaired_turns(made: Repair) -> DataFrame:
    """(conv_id, place, turn, role, text, edit) of the repaired conversations; inserted turns have a null turn and an empty text."""
    return _in_order(made).mapInArrow(_turns, REPAIRED)


def repaired_digests(made: Repair) -> DataFrame:
    """(conv_id, repaired_sha256): of all `role:text` of a repaired conversation, joined by line ends. A digest needs one stream."""
    return _in_order(made).mapInArrow(_digests, "conv_id long, repaired_sha256 string")
