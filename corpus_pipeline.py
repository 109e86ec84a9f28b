"""The corpus pipeline: toxicity, near-duplicates, mixture, packing, each over all that the stage before it kept."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkledger.llm import mixing, packing, simhash, toxicity
from sparkledger.llm.base import crc_bucket, fresh, materialise
from sparkledger.llm.queries import MIXTURE, tokenizer_path

#: Documents whose toxicity score reaches this go.
TOXIC = 0.3
#: Jaccard similarity of five-word runs from which two documents are near-duplicates.
SIMILAR = 0.8
#: Tokens of the mixture, as a multiple of those there are (None: as many as the targets take); every document stays at least once.
EPOCHS, LEAST = None, 1.0
#: A domain's share of tokens that is further from its target is warned of.
OFF = 0.005


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC, by a classifier learnt from the labels outside the held-out part."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(crc_bucket(F.col("doc_id"), 4) != 2))
    (score,) = fresh(docs.columns, "toxicity")
    return toxicity.score(docs, model, name=score).where(F.col(score) < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with five-word similarity SIMILAR or more: the one with the smallest id."""
    return simhash.one_per_component(docs, words=5, least=SIMILAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates towards MIXTURE say, each at least once."""
    labelled = mixing.labelled_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found, report = mixing.rates(docs, labelled, MIXTURE, EPOCHS, LEAST)
    shares = mixing.shares(report)
    off = report["unmet"] or any(abs(aim - got) > OFF for aim, got in shares.values())
    said = ", ".join(f"{d} {got:.4f} of {aim:.4f}" for d, (aim, got) in shares.items())
    logging.getLogger(__name__).log(logging.WARNING if off else logging.INFO, "mixture, shares of tokens: %s", said)
    return mixing.repeated(docs, found)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2,048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: No stage but the choice of one document a group can be written in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
