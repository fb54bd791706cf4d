"""Places of rows in a long order, without one task for a long group."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from corpusmill.plans.staging import staged


def _count(batches: Iterator[pa.RecordBatch], group: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A sorted range's rows with its number, the number of their group in it, and their place there."""
    part, run, place, last = TaskContext.get().partitionId(), -1, 0, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(group)
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        starts = np.concatenate(([run < 0 or column[0].as_py() != last], codes[1:] != codes[:-1]))
        runs = run + np.cumsum(starts)
        begin = np.maximum.accumulate(np.where(starts, np.arange(n), -place))
        places = np.arange(n) - begin
        run, place, last = int(runs[-1]), int(places[-1]) + 1, column[n - 1].as_py()
        more = [pa.array(np.full(n, part, np.int32)), pa.array(runs), pa.array(places)]
        yield pa.RecordBatch.from_arrays(batch.columns + more, names)


def placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """`rows`, written once, with the place (from 0) of each within its `group` by `order`; nulls come first.

    Rows are dealt by ranges of group and order and numbered as they stream, so that a long group is
    many tasks' work. What the driver gets, and sends out again, is one row for each range: where its last group stands.
    Rows that are equal in all of these share a range; give `order` a last column that tells them apart.
    """
    spark = rows.sparkSession
    kind = StructType([*rows.schema, StructField("range_no", IntegerType()), StructField("run_no", LongType()), StructField("run_place", LongType())])
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    counted = staged(dealt.mapInArrow(partial(_count, group=group, names=kind.names), kind))
    ends = lambda pick: counted.groupBy("range_no").agg(pick(F.struct("run_no", "run_place", group)).alias("e"))
    firsts = {r.range_no: r.e[2] for r in ends(F.min).collect()}
    before, last, held = [], None, 0
    for r in sorted(ends(F.max).collect(), key=lambda r: r.range_no):
        run, place, own = r.e
        start = held if before and firsts[r.range_no] == last else 0
        before.append((r.range_no, start))
        last, held = own, place + 1 + (start if run == 0 else 0)
    starts = spark.createDataFrame([x for x in before if x[1]], "range_no int, before long")
    place = F.col("run_place") + F.when(F.col("run_no") == 0, F.coalesce("before", F.lit(0))).otherwise(0)
    return counted.join(F.broadcast(starts), "range_no", "left").select(*rows.columns, place.cast("long").alias(name))
