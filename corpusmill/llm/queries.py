"""The queries of this package: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, chat, exact, gam, merkle, packing, repair, rules, sharding, sql, suffixes, topk, toxicity
from corpusmill.llm.neardup import near_duplicates

Query = Callable[[SparkSession, str], DataFrame]
RANKS, TOKENIZER = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_vector_bin_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where("vec_id % 20 = 0"), vectors)


def op5_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat.digests(chat.format_turns(turns.unionByName(more)))


def op10_robust_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"))


def op11_grace_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.copies(table(spark, sf_dir, "documents"))


def op12_merkle_multiproof(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    of = lambda n_chars: merkle.leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    claimed = F.when(tampered, of(F.col("n_chars") + 1)).otherwise(F.col("hash"))
    leaves = docs.withColumn("hash", of(F.col("n_chars"))).select("doc_id", "lang", "hash", claimed.alias("claimed"))
    made = merkle.manifest(leaves, "lang", "doc_id")
    proofs = merkle.prove(made, made.leaves)
    proof = F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256")
    return proofs.select("doc_id", F.col("hash").alias("leaf"), "subroot", F.lit(made.root).alias("root"), proof, F.col("folded").alias("folded_root"), "verified")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with one row in four dropped, emptied, cut, repeated or given to the user, by a hash of its place."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(filled("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return turns.withColumn("kind", kind).where("kind > 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    made = repair.repair(damaged(turns))
    whole = turns.select(F.col("conv_id").alias("id")).distinct()
    same = F.col("id").eqNullSafe(F.col("conv_id"))
    out = whole.join(made.conversations, same, "left").drop("conv_id").join(repair.repaired_digests(made), same, "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Query] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_vector_bin_sharding": op2_vector_bin_sharding,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_pivot_top_k": op4_pivot_top_k,
    "op5_additive_quality": op5_additive_quality,
    "op6_differencing_packing": op6_differencing_packing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_toxicity_chain": op8_toxicity_chain,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_robust_quality_rules": op10_robust_quality_rules,
    "op11_grace_exact_dedup": op11_grace_exact_dedup,
    "op12_merkle_multiproof": op12_merkle_multiproof,
    "op13_structure_repair": op13_structure_repair,
}
ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": sql.NEAR_DUPLICATES,
    "op4_pivot_top_k": sql.TOP_K,
    "op11_grace_exact_dedup": sql.COPIES,
    "op12_merkle_multiproof": sql.PROOFS,
    "op13_structure_repair": sql.REPAIRS,
}
