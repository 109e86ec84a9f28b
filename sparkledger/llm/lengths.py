"""Exact length histogram: documents by encoded length, and suffix sums that answer every context limit.

The histogram holds one row a distinct length, so it grows with the longest text and not with the corpus; all
answers (totals, quantiles, truncated totals) come from it and are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkledger.llm.base import materialise, small_batches
from sparkledger.llm.tokens import encoder

#: Lengths that share a band; suffix sums are taken within bands and over bands, so no task gathers all lengths.
BAND = 1024
#: Files that a histogram is kept in: it is small, so few tasks sum it up and write it.
FILES = 8


def histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(length, documents): how many rows of `docs` have each encoded length.

    `tokenizer` is the path of a public tokenizer file on every machine. Whole texts are encoded; null and empty texts
    have length 0; repeated rows count each time; an empty table gives no rows. Other columns are not read. The result
    is kept on shared storage, so texts are encoded once however many answers are drawn from it.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer).ids
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(ids(t.as_py())) for t in b.column(0)], pa.int64())], ["length"])

    sizes = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "length long")
    return materialise(sizes.groupBy("length").agg(F.count(F.lit(1)).alias("documents")).coalesce(FILES), "lengths")


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with what each length answers as a context limit.

    tokens: of documents of this length; documents_over, tokens_over: of strictly longer ones (the suffix sums);
    documents_within, tokens_within: of this length or shorter; truncated_total: tokens kept when every document is
    cut at this length; lost_tokens: those cut off; share_within: share of documents kept whole.
    """
    sized = hist.withColumn("tokens", F.col("length") * F.col("documents")).withColumn("_band", F.floor(F.col("length") / BAND).cast("long"))
    over = Window.orderBy(F.col("_band").desc())
    bands = sized.groupBy("_band").agg(F.sum("documents").alias("_d"), F.sum("tokens").alias("_t"))
    rest = over.rowsBetween(Window.unboundedPreceding, -1)
    every = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bands = bands.select("_band", *[F.coalesce(F.sum(c).over(rest), F.lit(0)).alias(f"{c}over") for c in ("_d", "_t")], *[F.sum(c).over(every).alias(f"{c}all") for c in ("_d", "_t")])
    above = Window.partitionBy("_band").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = sized.join(bands, "_band").select(
        "length", "documents", "tokens",
        (F.coalesce(F.sum("documents").over(above), F.lit(0)) + F.col("_dover")).alias("documents_over"),
        (F.coalesce(F.sum("tokens").over(above), F.lit(0)) + F.col("_tover")).alias("tokens_over"),
        "_dall", "_tall",
    )
    kept = F.col("_tall") - F.col("tokens_over") + F.col("length") * F.col("documents_over")
    return out.select(
        "length", "documents", "tokens", "documents_over", "tokens_over",
        (F.col("_dall") - F.col("documents_over")).alias("documents_within"),
        (F.col("_tall") - F.col("tokens_over")).alias("tokens_within"),
        kept.alias("truncated_total"),
        (F.col("_tall") - kept).alias("lost_tokens"),
        ((F.col("_dall") - F.col("documents_over")) / F.col("_dall")).alias("share_within"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, documents_within, documents_over, truncated_total) for any limits, whether a document has that length or not."""
    spark = hist.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "context_limit long")
    sums = [F.struct(F.lit(int(x)).alias("context_limit"), F.sum(F.when(F.col("length") <= x, F.col("documents")).otherwise(0)).alias("w"), F.sum(F.when(F.col("length") > x, F.col("documents")).otherwise(0)).alias("o"), F.sum(F.least(F.col("length"), F.lit(int(x))) * F.col("documents")).alias("t")) for x in sorted(set(limits))]
    if not sums:
        return asked.selectExpr("context_limit", "0L documents_within", "0L documents_over", "0L truncated_total")
    got = hist.agg(F.array(*sums).alias("a")).select(F.explode("a").alias("s"))
    return got.select("s.context_limit", *[F.coalesce(f"s.{a}", F.lit(0)).alias(b) for a, b in (("w", "documents_within"), ("o", "documents_over"), ("t", "truncated_total"))])


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that at least this share of the documents doesn't exceed; none on an empty table."""
    sums = suffix_sums(hist)
    picked = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("share_within") >= q, F.col("length"))).alias("length")) for q in shares]
    return sums.agg(F.array(*picked).alias("a")).select(F.explode("a").alias("s")).select("s.share", "s.length").where("length IS NOT NULL")
