"""Time series: values at an instant, trends and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def latest(series: DataFrame, value: str, at: str | None = None, lookback: str = "5 minutes", names: str = ".*") -> DataFrame:
    """(name, value) of every series by its last value up to `at` and within the lookback; without `at`, the last of all."""
    rows = series.where(F.col("name").rlike(names))
    if at:
        end = F.lit(at).cast("timestamp_ntz")
        rows = rows.where((F.col("ts") <= end) & (F.col("ts") > end - F.expr(f"INTERVAL {lookback}")))
    return rows.groupBy("name").agg(F.max_by(value, F.struct("ts", "event_id")).alias("value"))


def instant_totals(current: DataFrame) -> DataFrame:
    return current.agg(F.count("*").alias("series"), F.round(F.sum("value"), 6).alias("total"))


def top(current: DataFrame, k: int = 10) -> DataFrame:
    return current.orderBy(F.desc("value"), "name").limit(k)


def trend(series: DataFrame, value: str, step: str) -> DataFrame:
    """(name, start, value): every series' last value in each step."""
    return series.groupBy("name", F.window(F.col("ts").cast("timestamp"), step).alias("w")).agg(F.max_by(value, F.struct("ts", "event_id")).alias("value")).select("name", F.col("w.start").cast("timestamp_ntz").alias("start"), "value")


def _micros(series: DataFrame, ts: str) -> Column:
    """Microseconds since 1970; of a time without zone by its own clock, whatever the session's zone and its summer time."""
    if not isinstance(series.schema[ts].dataType, TimestampNTZType):
        return F.unix_micros(F.col(ts).cast("timestamp"))
    return F.expr(f"unix_date(CAST({ts} AS DATE)) * 86400000000L + hour({ts}) * 3600000000L + minute({ts}) * 60000000L + CAST(extract(SECOND FROM {ts}) * 1000000 AS BIGINT)")


def rate(series: DataFrame, counter: str, seconds: int = 60, windows: int = 8) -> DataFrame:
    """(name, event_id, rate) a second over the `seconds` before each sample; a falling counter began anew. No extrapolation to the window's ends.

    A series is cut into slices of `windows` windows' length, so that one with very many samples is
    many tasks' work. What a slice needs from before comes as a halo: the last sample before it for
    the first increase, and the increases of one window before its start. Only one value for each
    slice is put in order over a whole series. Samples that share a time and an id are taken as a
    counter goes, by their value, so that no order of arrival makes it begin anew.
    """
    span = seconds * 1_000_000
    width = span * windows
    rows = series.select("name", "event_id", "ts", F.col(counter).alias("value"), _micros(series, "ts").alias("us"))
    rows = rows.withColumn("slice", F.expr(f"us div {width}L - if(us < 0 and us % {width}L <> 0, 1, 0)"))
    lasts = rows.groupBy("name", "slice").agg(F.max_by("value", F.struct("ts", "event_id", "value")).alias("last"))
    earlier = lasts.select(F.col("name").alias("name_"), F.col("slice").alias("slice_"), F.lag("last").over(Window.partitionBy("name").orderBy("slice")).alias("earlier"))
    met = rows.join(earlier, F.col("name").eqNullSafe(F.col("name_")) & F.col("slice").eqNullSafe(F.col("slice_")), "left")
    inside = Window.partitionBy("name", "slice").orderBy("ts", "event_id", "value")
    before = F.when(F.row_number().over(inside) == 1, F.col("earlier")).otherwise(F.lag("value").over(inside))
    up = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    late = F.col("us") >= (F.col("slice") + 1) * width - span
    dealt = met.withColumn("up", up).withColumn("dealt", F.explode(F.when(late, F.array(F.col("slice"), F.col("slice") + 1)).otherwise(F.array("slice"))))
    reach = Window.partitionBy("name", "dealt").orderBy("us").rangeBetween(-span, 0)
    return dealt.withColumn("rate", F.round(F.sum("up").over(reach) / seconds, 6)).where(F.col("dealt").eqNullSafe(F.col("slice"))).select("name", "event_id", "rate")


def names(series: DataFrame) -> DataFrame:
    return series.select("name").distinct()
