"""Quotas, limits, listings and version histories from event tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.ordered import placed
from corpusmill.plans.staging import staged

DAILY_LIMIT = 10


def daily_usage(requests: DataFrame, limit: int = DAILY_LIMIT) -> DataFrame:
    """Used and remaining requests of every user and UTC day; premium users have no limit. Reset is the next midnight."""
    rows = requests.groupBy("user_id", "is_premium", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    used = F.when(F.col("is_premium"), F.col("n")).otherwise(F.least("n", F.lit(limit)))
    left = F.when(~F.col("is_premium"), F.greatest(limit - F.col("n"), F.lit(0)))
    return rows.select("user_id", "day", "is_premium", used.alias("used"), F.when(~F.col("is_premium"), F.lit(limit)).alias("limit_"), left.alias("remaining"), F.date_add("day", 1).alias("reset_day"))


def seconds_to_reset(now: Column) -> Column:
    """Until the next midnight, at least one."""
    return F.greatest(F.lit(1), F.unix_seconds(F.date_add(F.to_date(now), 1).cast("timestamp")) - F.unix_seconds(now))


def decisions(requests: DataFrame, limit: int = DAILY_LIMIT) -> DataFrame:
    """Every request with its number in the user's day, and whether it is accepted; denied and premium ones count too."""
    nth = F.row_number().over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id"))
    return requests.withColumn("nth", nth).withColumn("accepted", F.col("is_premium") | (F.col("nth") <= limit))


#: Hits of a key that one task holds; segments that are put together at once.
SEGMENT, TOGETHER = 1 << 16, 32
_NEVER = np.iinfo(np.int64).min


class Steps(NamedTuple):
    """Which window is open after a segment of a key's hits, by the time from which a hit opens a new one.

    The first of `bounds` that isn't below that time stands for the window's start in `opened` and
    the place of its first hit in `place`; beyond all bounds the window from before stays open.
    `closed`: no window from before can last beyond the bounds.
    """

    bounds: np.ndarray
    opened: np.ndarray
    place: np.ndarray
    closed: bool

    def fewest(self) -> Steps:
        """Without bounds that lead to the same window as the next."""
        last = np.append(self.opened[1:] != self.opened[:-1], True) if len(self.opened) else np.zeros(0, bool)
        return Steps(self.bounds[last], self.opened[last], self.place[last], self.closed)


def steps_of(us: np.ndarray, place: np.ndarray, span: int) -> Steps:
    """The steps of one segment of sorted hits: each time is linked to the first that is out of its window, and links are doubled until they end."""
    times, first = np.unique(us, return_index=True)
    n = len(times)
    following = np.searchsorted(times, times + span)
    end = np.where(following < n, following, np.arange(n))
    while not np.array_equal(further := end[end], end):
        end = further
    # The open window began before the first hit here, so a new one opens within a span of it.
    beyond = int(np.searchsorted(times, times[0] + span))
    end = end[: beyond + 1]
    return Steps(times[: beyond + 1], times[end], place[first[end]], beyond < n).fewest()


def after(opened: int | None, place: int, steps: Steps, span: int) -> tuple[int | None, int]:
    """The open window after a segment that begins in the window (opened, place)."""
    k = int(np.searchsorted(steps.bounds, _NEVER if opened is None else opened + span))
    return (int(steps.opened[k]), int(steps.place[k])) if k < len(steps.bounds) else (opened, place)


def composed(parts: list[Steps], span: int) -> Steps:
    """The steps of several segments that follow one another."""
    one = parts[0]
    for two in parts[1:]:
        k = np.searchsorted(two.bounds, one.opened + span)
        goes_on, k = k < len(two.bounds), np.minimum(k, len(two.bounds) - 1)
        opened, place = np.where(goes_on, two.opened[k], one.opened), np.where(goes_on, two.place[k], one.place)
        more = two.bounds > (np.inf if one.closed else one.bounds[-1])
        merged = (np.append(x, y[more]) for x, y in ((one.bounds, two.bounds), (opened, two.opened), (place, two.place)))
        one = Steps(*merged, one.closed or two.closed).fewest()
    return one


def _rows_of(key: pa.Scalar, numbers: list[int], parts: list[Steps], names: list[str]) -> pa.Table:
    lists = [pa.array([getattr(p, c).tolist() for p in parts], pa.list_(pa.int64())) for c in ("bounds", "opened", "place")]
    return pa.table([pa.array([key.as_py()] * len(parts), key.type), pa.array(numbers, pa.int64()), *lists, pa.array([p.closed for p in parts])], names=names)


def _parts_of(table: pa.Table) -> list[Steps]:
    of = lambda c: [np.array(x, np.int64) for x in table.column(c).to_pylist()]
    return [Steps(*x) for x in zip(of("bounds"), of("opened"), of("place"), table.column("closed").to_pylist(), strict=True)]


def _entries(hot: DataFrame, key: str, span: int) -> DataFrame:
    """(key_, segment_, opened, opened_place): the window that is open before each segment of hits (key, us, place, segment).

    Segments' steps are put together by TOGETHER, and these again, until one is left for each key;
    then the open window goes down the same way. No task holds more than TOGETHER segments.
    """
    kind = f"{key} {hot.schema[key].dataType.simpleString()}"
    at_once = TOGETHER
    names = [key, "segment", "bounds", "opened", "place", "closed"]
    steps = f"{kind}, segment long, bounds array<long>, opened array<long>, place array<long>, closed boolean"

    def cut(rows):  # noqa: ANN001, ANN202 - Spark would read annotations
        rows = rows.sort_by("place")
        return _rows_of(rows.column(key)[0], [rows.column("segment")[0].as_py()], [steps_of(rows.column("us").to_numpy(), rows.column("place").to_numpy(), span)], names)

    def join(rows):  # noqa: ANN001, ANN202
        rows = rows.sort_by("segment")
        return _rows_of(rows.column(key)[0], [rows.column("segment")[0].as_py() // at_once], [composed(_parts_of(rows), span)], names)

    def down(rows):  # noqa: ANN001, ANN202
        rows = rows.sort_by("segment")
        at, out = (rows.column("from_opened")[0].as_py(), rows.column("from_place")[0].as_py()), []
        for part in _parts_of(rows):
            out.append(at)
            at = after(at[0], at[1] or 0, part, span)
        columns = [rows.column(key), rows.column("segment"), *(pa.array([x[k] for x in out], pa.int64()) for k in (0, 1))]
        return pa.table(columns, names=["key_", "segment_", "opened", "opened_place"])

    levels = [staged(hot.groupBy(key, "segment").applyInArrow(cut, steps))]
    while levels[-1].agg(F.max("segment")).first()[0]:
        levels.append(staged(levels[-1].groupBy(key, F.expr(f"segment div {at_once}").alias("parent")).applyInArrow(join, steps)))
    known = levels.pop().select(F.col(key).alias("key_"), F.col("segment").alias("segment_"), F.lit(None).cast("long").alias("opened"), F.lit(None).cast("long").alias("opened_place"))
    for level in reversed(levels):
        above = known.select("key_", "segment_", F.col("opened").alias("from_opened"), F.col("opened_place").alias("from_place"))
        met = level.withColumn("parent", F.expr(f"segment div {at_once}")).join(above, F.col(key).eqNullSafe(F.col("key_")) & (F.col("parent") == F.col("segment_"))).drop("key_", "segment_")
        known = staged(met.groupBy(key, "parent").applyInArrow(down, f"key_ {hot.schema[key].dataType.simpleString()}, segment_ long, opened long, opened_place long"))
    return known


def _opened(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Hits (key, segment, us, event_id, place, opened, opened_place), sorted by segment and place, with the start of their window and their number in it."""
    now, opened, first = None, None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, segments, times, events, places, known, known_place = batch.columns
        codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        segment, us, place = segments.to_numpy(), times.to_numpy(), places.to_numpy()
        starts, counts = us.copy(), np.ones(n, np.int64)
        bounds = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (segment[1:] != segment[:-1])) + 1).tolist(), n]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if lo or (keys[0].as_py(), segment[0]) != now:
                opened, first = known[lo].as_py(), known_place[lo].as_py() or 0
            at = lo
            while at < hi:
                if opened is None or us[at] >= opened + span:
                    opened, first = int(us[at]), int(place[at])
                end = at + max(1, int(np.searchsorted(us[at:hi], opened + span)))
                starts[at:end], counts[at:end] = opened, place[at:end] - first + 1
                at = end
        now = keys[n - 1].as_py(), segment[n - 1]
        yield pa.RecordBatch.from_arrays([keys, events, times, pa.array(starts), pa.array(counts)], [batch.schema.names[0], "event_id", "us", "opened", "count"])


def fixed_windows(hits: DataFrame, key: str, seconds: int, limit: int) -> DataFrame:
    """Hits (key, ts, event_id) with count, allowed and retry_after; a window opens at a key's first hit outside one.

    A key's hits are cut into segments of SEGMENT; for each it is worked out which window is open
    after it, for every window that may be open before it, and these are composed over the segments.
    So a key with very many hits is many tasks' work. A hit without a time is a window of its own;
    hits of one time follow by event_id; a null key is a key like others.
    """
    span = seconds * 1_000_000
    timed = hits.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").cast("long").alias("event_id"))
    lined = placed(timed.where("us is not null").withColumn("row_no", F.monotonically_increasing_id()), key, ["us", "event_id", "row_no"], "place")
    lined = lined.drop("row_no").withColumn("segment", F.expr(f"place div {SEGMENT}"))
    long_keys = lined.where("segment > 0").select(F.col(key).alias("key_")).distinct()
    same = F.col(key).eqNullSafe(F.col("key_"))
    if long_keys.isEmpty():
        known = lined.withColumns({c: F.lit(None).cast("long") for c in ("opened", "opened_place")})
    else:
        entries = _entries(lined.join(long_keys, same, "left_semi"), key, span)
        known = lined.join(entries, same & (F.col("segment") == F.col("segment_")), "left")
    dealt = known.select(key, "segment", "us", "event_id", "place", "opened", "opened_place").repartition(key, "segment").sortWithinPartitions(key, "segment", "place")
    kind = T.StructType([timed.schema[key], *(T.StructField(c, T.LongType()) for c in ("event_id", "us", "opened", "count"))])
    rows = dealt.mapInArrow(partial(_opened, span=span), kind)
    alone = timed.where("us is null").select(key, "event_id", "us", F.col("us").alias("opened"), F.lit(1).cast("long").alias("count"))
    allowed = (F.col("count") == 1) | (F.col("count") <= limit)
    wait = F.ceil((F.col("opened") + span - F.col("us")) / 1_000_000)
    return rows.unionByName(alone).select(key, "event_id", F.col("count").cast("int").alias("count"), allowed.alias("allowed"), F.when(~allowed, F.greatest(wait, F.lit(1))).cast("long").alias("retry_after"))


def limit_key(bucket: str, id_: Column) -> Column:
    return F.concat(F.lit(f"{bucket}:"), F.sha2(F.lower(F.trim(id_)), 256))


def client_address(forwarded: Column, *fallbacks: Column) -> Column:
    """The first hop of a forwarded list, else the first fallback that isn't blank."""
    filled = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(filled(F.split(forwarded, ",")[0]), *(filled(f) for f in fallbacks), F.lit("unknown"))


def page(rows: DataFrame, created: str, id_: str, number: int, size: int, deleted: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A page of the newest first, and the total, without deleted rows."""
    live = rows.where(~F.col(deleted)) if deleted else rows
    return live.orderBy(F.desc(created), id_).offset((number - 1) * size).limit(size), live.agg(F.count("*").alias("total"))


def version_history(versions: DataFrame) -> DataFrame:
    """Versions of every prompt with their number; the newest is active."""
    order = Window.partitionBy("prompt_id").orderBy("created_at", "version_id")
    number = F.row_number().over(order)
    return versions.withColumns({"version_number": number, "is_active": F.lead("version_id").over(order).isNull()})


def activated(history: DataFrame, activations: DataFrame) -> DataFrame:
    """The history after activations (prompt_id, version_number, at): the last one of a known version counts."""
    known = activations.join(history.select("prompt_id", "version_number"), ["prompt_id", "version_number"])
    chosen = known.groupBy("prompt_id").agg(F.max_by("version_number", F.struct("at", "version_number")).alias("chosen"))
    rows = history.join(chosen, "prompt_id", "left")
    return rows.withColumn("is_active", F.when(F.col("chosen").isNotNull(), F.col("version_number") == F.col("chosen")).otherwise(F.col("is_active"))).drop("chosen")
