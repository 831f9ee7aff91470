"""The queries of this subpackage, by name; each takes (spark, sf_dir). Their SQL is in oracles.py."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, mixing, neardup, pii, quality, rules, sharding, toxicity, warc
from .common import Scratch, table

#: Score from which a text counts as toxic.
TOXIC = 0.3
#: The public tokenizer file, at the same path on every executor.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.schedule(docs).select("row.doc_id", "source", "block_no", "slot", "position")


def op3_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digested(table(spark, sf_dir, "documents"), WORD_BPE)


def remainder(n: int) -> Column:
    """crc32 of the doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranker = quality.fit(docs, table(spark, sf_dir, "labels").where(remainder(3) != 1))
    return quality.scored(docs, ranker).select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = pii.key_of(spark)
    return pii.reported(pii.checked(table(spark, sf_dir, "documents"), key), key)


def toxicity_scorer(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Scorer:
    """Learnt from the labels of rows whose remainder by 4 isn't 2; the character model from all of docs."""
    labels = table(spark, sf_dir, "labels").where(remainder(4) != 2)
    return toxicity.fit(docs, labels, toxicity.character_model(docs), Scratch(spark, "toxicity"))


def op7_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity_scorer(spark, sf_dir, docs))
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), f"{scratch.folder}/archives")
    return warc.read_archives(spark, f"{scratch.folder}/archives")


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "shards")
    records = sharding.split(scratch.keep(sharding.sized(table(spark, sf_dir, "documents")), "records"))
    sharding.save_map(sharding.build_map(sharding.slot_bytes(records), 8), f"{scratch.folder}/map")
    placed = sharding.assign(records, sharding.load_map(spark, f"{scratch.folder}/map"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op10_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.cascade(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
