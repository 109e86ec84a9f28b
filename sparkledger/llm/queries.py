"""The registered query of each operator, over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkledger.llm import brown, hilbert, imatch, lengths, mixing, oracles, packing, simhash, topk, toxicity, warc
from sparkledger.llm.base import crc_bucket

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    """The tokenizer file of the production queries, where the public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Shares of tokens that the mixture aims at, by domain.
MIXTURE = {"high": 0.9, "low": 0.08, "toxic": 0.02}


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.labelled_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found, report = mixing.rates(documents(spark, sf_dir), labelled, MIXTURE)
    names = [F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(report["domains"])]
    rows = found.select(F.col("id").alias("doc_id"), F.col("tokens").cast("long").alias("tokens"), *names, "rate", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return rows.drop("copy")


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), offsets=False)
    revisit = F.col("type") == "revisit"
    stated = F.regexp_extract("http_head", r"(?im)^Content-Length: ([0-9]+)", 1).cast("long")
    return found.select(
        F.col("record_id").alias("page_id"),
        F.when(revisit, stated).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(warc.sha1_base32(F.col("payload"))).alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_edited(documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard_documents(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_bucket(F.col("doc_id"), 4) == 2
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~held_out))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", toxicity.is_toxic(F.col("score")).alias("predicted"))


def op7_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_bucket(F.col("doc_id"), 7) == 2
    model, counts = brown.fit(docs.where(~held_out))
    scored = brown.score(docs, model, counts)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_impact_ordered_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


def op9_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.suffix_sums(lengths.histogram(documents(spark, sf_dir), tokenizer_path()))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_soft_mixing, op2_warc_round_trip, op3_imatch, op4_best_fit_packing, op5_hilbert_shards, op6_toxicity,
        op7_brown_scores, op8_impact_ordered_top_k, op9_length_histogram, op10_simhash_near_dedup,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express; tests hold the others against brute force."""
    return {
        "op2_warc_round_trip": oracles.warc(),
        "op3_imatch": oracles.imatch_fingerprints(),
        "op5_hilbert_shards": oracles.hilbert_shards(),
        "op8_impact_ordered_top_k": oracles.top_k(),
    }
