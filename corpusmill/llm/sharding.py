"""Sharding by vector bin packing.

Groups of equal texts are placed whole, the largest first, each where the dot product of its vector
(bytes, tokens, rows, as shares of a shard) with the shard's residual capacity is highest. Only a
group that no shard can hold, as it is larger than a shard's share, is split, into about as many parts as
it needs. Groups are dealt by a hash into lots of bounded size, each packed by one task; the bins of
the lots are items of the next round, until one lot is left.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.plans.staging import staged

SHARDS = 24
#: Items in a lot; rows in a run of slots.
LOT_ITEMS, SLOT_ROWS = 4000, 2000
#: What bytes, tokens and rows weigh in the dot product: bytes, whose sizes the law is about, come first.
WEIGHTS = np.array([64.0, 1.0, 1.0])
_SIZES = ["bytes", "tokens", "rows"]


def _pack_lot(items: pd.DataFrame, shards: int) -> pd.DataFrame:
    items = items.sort_values(["bytes", "tokens", "rows", "a", "b", "c"], ascending=False, kind="stable", ignore_index=True)
    sizes = items[_SIZES].to_numpy(np.float64)
    share = sizes / np.maximum(sizes.sum(axis=0) / shards, 1)
    order = np.argsort(-share.max(axis=1), kind="stable")
    left, chosen = np.ones((shards, 3)), np.zeros(len(items), np.int32)
    for i in order.tolist():
        k = int(np.argmax(left @ (share[i] * WEIGHTS)))
        left[k] -= share[i]
        chosen[i] = k
    return items[["a", "b", "c", "lot", *_SIZES]].assign(bin=chosen)


def packed_items(items: DataFrame, shards: int) -> DataFrame:
    """(a, b, c, shard) of items (a, b, c, bytes, tokens, rows); a, b and c are the long keys of an item."""
    lots = -(-items.count() // LOT_ITEMS) or 1
    dealt = items.withColumn("lot", F.expr(f"pmod(xxhash64(a, b, c), {lots}L)"))
    kind = "a long, b long, c long, lot long, bytes long, tokens long, rows long, bin int"
    placed = staged(dealt.groupBy("lot").applyInPandas(lambda rows: _pack_lot(rows, shards), kind))
    if lots == 1:
        return placed.select("a", "b", "c", F.col("bin").alias("shard"))
    bins = placed.groupBy("lot", "bin").agg(*(F.sum(s).alias(s) for s in _SIZES))
    upper = packed_items(bins.selectExpr("lot a", "cast(bin as bigint) b", "0L c", *_SIZES), shards)
    return placed.join(upper.selectExpr("a lot", "cast(b as int) bin", "shard"), ["lot", "bin"]).select("a", "b", "c", "shard")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of `docs` (doc_id, text).

    The law is `bytes`: the shards' sizes are nearly equal, and so are their words and rows. size is
    the UTF-8 bytes of the text plus 8 (null: 8); equal texts share a shard unless their group has
    more bytes, words or rows than a shard's share; null is a text of its own. slot numbers a shard's rows from 0 without gaps. grown_shard
    is null. Repeated rows are placed one by one; other columns are ignored; no rows give none.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text", F.col("text").isNull()).alias("a"),
        F.size(F.split(text, r"[\x20\x09-\x0D]+")).cast("long").alias("tokens"),
    )
    # A number for each row, kept by the written table: rows that share an id, or have none, are dealt apart by it.
    rows = staged(rows.withColumns({"b": F.col("size") * (1 << 32) + F.col("text_crc32"), "deal": F.monotonically_increasing_id()}))
    total = rows.agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).first()
    groups = rows.groupBy("a", "b").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    share = F.ceil(F.greatest(*(F.col(s) * float(shards) / max(1, total[s] or 1) for s in _SIZES)))
    parts = F.when(share > 1, share + 1).otherwise(1)  # one more than needed, as rows are dealt by a hash, not evenly
    # At most 3 * shards groups are larger than a shard's share of bytes, tokens or rows.
    hot = groups.withColumn("parts", parts).where("parts > 1 and rows > 1").select("a", "b", "parts")
    cut = rows.join(F.broadcast(hot), ["a", "b"], "left").withColumn("c", F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(F.expr("pmod(xxhash64(deal), parts)")))
    items = cut.groupBy("a", "b", "c").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    placed = cut.join(packed_items(staged(items), shards), ["a", "b", "c"]).select("doc_id", "size", "text_crc32", "deal", "shard")
    # A shard's rows are numbered in runs of bounded length, each from where the one before ends.
    runs = max(1, (total["rows"] or 0) // (shards * SLOT_ROWS))
    placed = staged(placed.withColumn("run", F.expr(f"pmod(xxhash64(deal, 5L), {runs}L)")))
    before = placed.groupBy("shard", "run").agg(F.count("*").alias("m"))
    before = before.withColumn("base", F.sum("m").over(Window.partitionBy("shard").orderBy("run")) - F.col("m")).select("shard", "run", "base")
    numbered = placed.withColumn("k", F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size", "deal")))
    out = numbered.join(before, ["shard", "run"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
