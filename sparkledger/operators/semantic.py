"""Semantic counts: a ranked pool, a stratified sample of it judged, and the share accepted carried over to the pool."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkledger.functions.stats import allocate, stratified, wilson_counts
from sparkledger.functions.text import grounded, tokens


@dataclass(frozen=True)
class Limits:
    """Most hits that are judged and pooled, and the scores and confidences that count."""

    validated: int = 40
    pool: int = 400
    min_score: float = 0.15
    min_confidence: float = 0.70
    #: Text ranks aren't on the scale of fused scores: in text-only mode the score is no reason to reject, unless strict.
    strict: bool = False

    def clamped(self) -> "Limits":
        return Limits(max(1, min(self.validated, 120)), max(1, min(self.pool, 2000)), self.min_score, self.min_confidence, self.strict)


def eligible(hits: DataFrame, mode: str, limits: Limits) -> DataFrame:
    """Hits that count towards the population; every one in text-only mode."""
    return hits if mode == "fts_only" else hits.where(F.col("retrieval_score") >= limits.min_score)


def lexical_judge(concept: str) -> Callable[[DataFrame], DataFrame]:
    """A judge without a model: a text matches if it has all words of the concept; its first 60 characters support that."""

    def judge(sampled: DataFrame) -> DataFrame:
        words = F.array(*[F.lit(w) for w in sorted(set(concept.lower().split()))])
        match = F.size(F.array_except(words, tokens(F.col("content")))) == 0
        return sampled.select("source_id", "field", match.alias("is_match"), F.lit(1.0).alias("confidence"), F.substring("content", 1, 60).alias("snippet"))

    return judge


def contract_problems(sampled: DataFrame, judged: DataFrame) -> DataFrame:
    """(source_id, field, problem): items that a judge left out, added or judged twice."""
    key = ["source_id", "field"]
    n = judged.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    both = sampled.select(*key, F.lit(1).alias("asked")).join(n, key, "full")
    problem = F.when(F.col("asked").isNull(), "not asked for").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "judged twice")
    return both.select(*key, problem.alias("problem")).where("problem IS NOT NULL")


def rejection(mode: str, limits: Limits) -> Column:
    """Why a judged hit doesn't count, first reason first; null if it does."""
    score = F.lit(False) if mode == "fts_only" and not limits.strict else F.col("retrieval_score") < limits.min_score
    return (
        F.when(~F.col("is_match"), "rejected_by_judge")
        .when(score, "below_retrieval_threshold")
        .when(F.col("confidence") < limits.min_confidence, "below_validation_confidence")
        .when(~F.coalesce(grounded(F.col("snippet"), F.col("content")), F.lit(False)), "ungrounded_snippet")
    )


def validated(hits: DataFrame, judge: Callable[[DataFrame], DataFrame], mode: str = "hybrid", limits: Limits = Limits()) -> tuple[DataFrame, int]:
    """The judged sample, with reason (null: accepted), and how many hits are eligible.

    `hits` has source_id, field, content, retrieval_score and rank; the pool is a few hundred rows at most.
    """
    limits = limits.clamped()
    pool = eligible(hits.where(F.col("rank") <= limits.pool), mode, limits)
    # a few hundred rows at most, read by the count, the judge, the contract and the estimate
    ranked = pool.withColumn("place", F.row_number().over(Window.orderBy("rank"))).cache()
    n = ranked.count()
    sampled = stratified(ranked, "place", n, limits.validated)
    judged = judge(sampled)
    wrong = contract_problems(sampled, judged).first()
    if wrong:
        raise ValueError(f"the judge's answer is unusable: {wrong.source_id}/{wrong.field} {wrong.problem}")
    return sampled.join(judged, ["source_id", "field"]).withColumn("reason", rejection(mode, limits)), n


def estimate(judged: DataFrame, population: int) -> DataFrame:
    """One row: estimated_count, bounds, how many were judged and accepted, rate and confidences (three places)."""
    ok = F.col("reason").isNull()
    three = lambda c: F.coalesce(F.bround(c, 3), F.lit(0.0))
    out = judged.agg(
        F.count(F.lit(1)).alias("validated_count"), F.count_if(ok).alias("verified_count"),
        three(F.avg(F.when(ok, F.col("confidence")))).alias("accepted_avg"), three(F.min(F.when(ok, F.col("confidence")))).alias("accepted_min"), three(F.max(F.when(ok, F.col("confidence")))).alias("accepted_max"),
    )
    rate = F.coalesce(F.try_divide(F.col("verified_count"), F.col("validated_count")), F.lit(0.0))
    low, high = wilson_counts(F.col("verified_count"), F.col("validated_count"), F.lit(population))
    return out.withColumns({"candidate_count": F.lit(population).cast("long"), "estimated_count": F.bround(rate * population).cast("long"), "acceptance_rate": F.bround(rate, 3), "rejected_count": F.col("validated_count") - F.col("verified_count"), "lower": low, "upper": high})


def grouped_estimate(hits: DataFrame, judged: DataFrame, values: DataFrame, value: str, total: int, evidence_n: int = 3) -> DataFrame:
    """(value, pool_count, allocated, evidence): the estimate shared out over the pool's values of a column."""
    pool = hits.join(values, "source_id", "left")
    groups = allocate(pool.groupBy(value).agg(F.count(F.lit(1)).alias("pool_count")), value, "pool_count", total)
    accepted = judged.where("reason IS NULL").join(values, "source_id", "left")
    ranked = accepted.withColumn("_rn", F.row_number().over(Window.partitionBy(value).orderBy("rank"))).where(F.col("_rn") <= evidence_n)
    ids = ranked.groupBy(F.col(value).alias("_v")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "source_id"))), lambda x: x["source_id"]).alias("evidence"))
    out = groups.join(ids, F.col(value).eqNullSafe(F.col("_v")), "left").drop("_v")
    return out.orderBy(F.col("pool_count").desc(), F.coalesce(F.col(value).cast("string"), F.lit("None")))
