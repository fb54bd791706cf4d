"""Intervals [start, end) by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.names import free


def merged(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals of a key as one, and of how many."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    changed, island = free("changed", rows), free("island", rows)
    islands = rows.withColumn(changed, new).withColumn(island, F.sum(changed).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, island).agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged")).drop(island)


def intersecting(probes: DataFrame, spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Probes with the spans of their key that hold the probe's first or last place; places are whole numbers.

    A span lies in bins of the least power of two that isn't below its length, so in two or three of
    them; a probe's two places are looked up in each width that occurs (64 at most). So a key with very
    many spans is cut by time. A span that holds both places is met at the first of them only. Empty
    spans and nulls meet nothing.
    """
    a, b, level, at, which, bin_ = (free(n, probes, spans) for n in ("span_start", "span_end", "span_level", "probe_place", "probe_which", "span_bin"))
    number = lambda x, width: F.expr(f"cast(({x} - pmod({x}, {width})) as bigint) div {width}")
    held = spans.withColumnRenamed(start, a).withColumnRenamed(end, b).where(F.col(a) < F.col(b))
    width = f"shiftleft(1L, `{level}`)"
    held = held.withColumn(level, F.least(F.ceil(F.log2((F.col(b) - F.col(a)).cast("double"))), F.lit(62)).cast("int"))
    levels = sorted(r[0] for r in held.select(level).distinct().collect())
    if not levels:
        return probes.join(held.drop(level), keys).drop(a, b)
    last = f"(`{b}` - 1)"
    held = held.withColumn(bin_, F.explode(F.sequence(number(f"`{a}`", width), number(last, width))))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("w"), F.col(start).cast("long").alias("p")), F.struct(F.lit(1).alias("w"), (F.col(end) - 1).cast("long").alias("p"))))
    looked = probes.withColumn(which, ends).withColumn(at, F.col(which)["p"]).withColumn(which, F.col(which)["w"])
    looked = looked.withColumn(level, F.explode(F.array(*map(F.lit, levels)))).withColumn(bin_, number(f"`{at}`", width))
    holds = lambda x: (F.col(a) <= x) & (x < F.col(b))
    met = looked.join(held, [*keys, level, bin_]).where(holds(F.col(at)) & ((F.col(which) == 0) | ~holds(F.col(start))))
    return met.drop(a, b, level, at, which, bin_)
