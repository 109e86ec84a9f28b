"""Entity resolution: names to candidate pairs, decisions, clusters and merged tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkledger.functions import names as N
from sparkledger.functions.text import trigrams, words_of
from sparkledger.operators.aggregates import evidence
from sparkledger.plans.filters import like_pattern
from sparkledger.storage import discard, materialise


@dataclass(frozen=True)
class Thresholds:
    candidate: float = 0.62
    merge: float = 0.86
    review: float = 0.72
    token: float = 0.80
    model: float = 0.90

    @property
    def phonetic(self) -> float:
        return max(0.45, self.candidate - 0.12)


ACCEPTED, REVIEW, REJECTED = "accepted", "needs_review", "rejected"


def load_names(records: DataFrame, entity: str, aliases: DataFrame | None = None, retry: list[str] | None = None) -> DataFrame:
    """(raw, normalized, record_count, firm_id, selected_reason): distinct names, and why an incremental run takes each.

    Without aliases every name is selected ("full"). Names that normalise to nothing have an empty `normalized`.
    """
    raw = records.where(F.col(entity).isNotNull() & (F.btrim(entity) != "")).groupBy(F.col(entity).alias("raw")).agg(F.count(F.lit(1)).alias("record_count"))
    rows = raw.withColumn("folded", N.ascii_fold(F.col("raw"))).withColumn("normalized", N.normalize_name(F.col("folded")))
    if aliases is None:
        return rows.withColumn("firm_id", F.lit(None).cast("long")).withColumn("selected_reason", F.lit("full"))
    known = aliases.select(F.col("raw_firm").alias("raw"), "firm_id", F.col("record_count").alias("_before"))
    reason = F.when(F.col("_before").isNull(), "new_raw_firm").when(F.col("_before") != F.col("record_count"), "record_count_changed")
    if retry:
        reason = reason.when(F.col("raw").isin(retry) & ~F.col("raw").like("% <-> %"), "retry_logged_value")
    return rows.join(known, "raw", "left").withColumn("selected_reason", reason).drop("_before")


def candidate_pairs(names: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Pairs of distinct normalised names that are similar enough, at least one of them selected.

    Names at a trigram similarity t share enough trigrams that one of the rarest ones of either must be common (a
    prefix filter), and so have names at a word similarity of t; the phonetic rule asks for trigrams as well. Equality
    joins on these grams find all pairs; no pair of names is compared that shares none. Names with equal normalised
    forms are joined on that form instead, as a chain in order of the raw names.
    """
    rows = names.where("normalized <> ''").select("raw", "normalized", "folded", "record_count", "firm_id", "selected_reason", trigrams(F.col("normalized")).alias("grams"))
    rows = rows.withColumn("sound", N.metaphone(F.element_at(words_of(F.col("normalized")), 1)))
    forms = rows.groupBy("normalized").agg(F.first("grams").alias("grams"))
    counts = forms.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    ranked = forms.select("normalized", F.size("grams").alias("size"), F.explode("grams").alias("g")).join(counts, "g")
    rank = Window.partitionBy("normalized").orderBy("n", "g")
    # the least share of its own grams that any rule asks a name to have in common
    least = min(limits.phonetic, limits.candidate)
    keep = F.col("size") - F.ceil(F.col("size") * F.lit(least)) + 1
    rare = ranked.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= keep).select("normalized", "g")
    every = ranked.select(F.col("normalized").alias("other"), "g")
    pairs = rare.join(every, "g").where("normalized <> other").select(F.least("normalized", "other").alias("ln"), F.greatest("normalized", "other").alias("rn")).distinct()
    side = lambda p: rows.select(*[F.col(c).alias(f"{p}_{c}") for c in rows.columns])
    left, right = side("l"), side("r")
    apart = pairs.join(left, F.col("ln") == F.col("l_normalized")).join(right, F.col("rn") == F.col("r_normalized")).drop("ln", "rn")
    order = Window.partitionBy("normalized").orderBy("raw")
    chain = rows.withColumn("_next", F.lead("raw").over(order)).where("_next IS NOT NULL").select("normalized", "raw", "_next")
    same = chain.join(left, F.col("raw") == F.col("l_raw")).join(right, F.col("_next") == F.col("r_raw")).drop("normalized", "raw", "_next")
    both = apart.unionByName(same).where("l_selected_reason IS NOT NULL OR r_selected_reason IS NOT NULL")
    scored = score_pairs(both)
    t = F.col("trigram_similarity")
    near = (t >= limits.candidate) | (F.col("word_similarity") >= limits.candidate) | (F.col("phonetic_match") & (t >= limits.phonetic))
    return scored.where(near).drop("l_grams", "r_grams")


def score_pairs(pairs: DataFrame) -> DataFrame:
    """`pairs` (l_*, r_*) with trigram, word and token similarity, phonetic match and score; the cheap one comes first."""
    a, b = F.col("l_normalized"), F.col("r_normalized")
    out = pairs.withColumn("trigram_similarity", N.similarity(a, b))
    out = out.withColumn("word_similarity", F.greatest(N.word_similarity(a, b), N.word_similarity(b, a))).withColumn("token_jaccard", N.token_jaccard(a, b))
    out = out.withColumn("phonetic_match", (F.col("l_sound") == F.col("r_sound")) & (F.col("l_sound") != ""))
    return out.withColumn("score", F.greatest("trigram_similarity", "word_similarity", "token_jaccard"))


def decide(pairs: DataFrame, limits: Thresholds = Thresholds(), verdicts: DataFrame | None = None) -> DataFrame:
    """`pairs` with decision, decision_reason and confidence.

    Rules in order: accept, reject by legal form, reject by score, then a verifier's verdicts (l_raw, r_raw,
    same_entity, verdict_confidence) if given, else review.
    """
    lf, rf = N.foreign_forms(F.col("l_folded")), N.foreign_forms(F.col("r_folded"))
    out = pairs.withColumns({"_lf": lf, "_rf": rf, "_lu": N.us_forms(F.col("l_folded")), "_ru": N.us_forms(F.col("r_folded"))})
    same = F.col("l_normalized") == F.col("r_normalized")
    domestic = (F.size("_lf") == 0) & (F.size("_rf") == 0)
    overlap = F.col("token_jaccard") >= limits.token
    accept = (
        F.when(same, "equal normalised names")
        .when(domestic & (N.token_key(F.col("l_normalized")) == N.token_key(F.col("r_normalized"))), "equal words")
        .when(domestic & (F.col("trigram_similarity") >= limits.merge) & overlap, "trigram similarity and shared words")
        .when(domestic & (F.col("word_similarity") >= limits.merge) & overlap, "word similarity and shared words")
        .when(domestic & F.col("phonetic_match") & (F.col("token_jaccard") >= max(limits.token, 0.9)), "phonetic match and shared words")
    )
    conflict = F.when(~same, N.form_conflict(F.col("_lf"), F.col("_lu"), F.col("_rf"), F.col("_ru")))
    low = F.when(F.col("score") < limits.review, "below the review threshold")
    out = out.withColumns({"_accept": accept, "_reject": F.coalesce(conflict, low)})
    decision = F.when(F.col("_accept").isNotNull(), ACCEPTED).when(F.col("_reject").isNotNull(), REJECTED)
    confidence = F.when(F.col("_accept").isNotNull(), F.greatest("score", F.lit(limits.merge))).otherwise(F.col("score"))
    reason = F.coalesce("_accept", "_reject")
    if verdicts is not None:
        out = out.join(verdicts.select("l_raw", "r_raw", "same_entity", "verdict_confidence"), ["l_raw", "r_raw"], "left")
        sure = F.col("verdict_confidence") >= limits.model
        asked = decision.isNull() & F.col("same_entity").isNotNull()
        confidence = F.when(asked, F.col("verdict_confidence")).otherwise(confidence)
        reason = F.coalesce(reason, F.when(F.col("same_entity").isNotNull(), "verified"))
        decision = decision.when(sure & F.col("same_entity"), ACCEPTED).when(sure & ~F.col("same_entity"), REJECTED)
    out = out.withColumn("decision", decision.otherwise(REVIEW)).withColumn("decision_reason", F.coalesce(reason, F.lit("between the thresholds"))).withColumn("confidence", confidence)
    return out.drop("_lf", "_rf", "_lu", "_ru", "_accept", "_reject", "same_entity", "verdict_confidence")


def evidence_payload() -> Column:
    """The figures behind a decision, rounded to five places."""
    five = lambda c: F.bround(c, 5).alias(c)
    return F.to_json(F.struct("decision_reason", five("trigram_similarity"), five("word_similarity"), five("token_jaccard"), "phonetic_match"))


def clusters(names: DataFrame, decided: DataFrame, components: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(raw, cluster, record_count, firm_id, selected_reason, confidence, canonical): names by accepted pairs.

    A cluster is named by its smallest raw name. The canonical member is one that has a firm already if there is any,
    then the one with most records, the shortest, the first. confidence is the least of the cluster's pairs, 1 alone.
    """
    accepted = decided.where(F.col("decision") == ACCEPTED).select(F.col("l_raw").alias("a"), F.col("r_raw").alias("b"), "confidence")
    roots = (components or smallest_reachable)(accepted.select("a", "b"))
    rows = names.where("normalized <> ''").join(roots.select(F.col("node").alias("raw"), "root"), "raw", "left").withColumn("cluster", F.coalesce("root", "raw")).drop("root")
    least = accepted.join(roots, F.col("a") == F.col("node")).groupBy(F.col("root").alias("cluster")).agg(F.min("confidence").alias("confidence"))
    best = F.struct(F.col("firm_id").isNull().alias("a"), (-F.col("record_count")).alias("b"), F.length("raw").alias("c"), F.lower("raw").alias("d"), F.col("raw").alias("e"))
    chosen = rows.groupBy("cluster").agg(F.min_by("raw", best).alias("canonical"), F.min_by("firm_id", best).alias("cluster_firm_id"))
    out = rows.join(chosen, "cluster").join(least, "cluster", "left")
    return out.withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))


def smallest_reachable(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component, by rounds of label propagation and pointer jumping.

    Each round is written to shared storage, so the plan doesn't grow and a lost executor costs one round.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    state = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "roots")
    for _ in range(max_rounds):
        near = both.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        step = state.join(near, "node").select("node", F.least("root", "seen").alias("root"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("far"))
        after = materialise(step.join(jump, "root").select("node", F.least("root", "far").alias("root")), "roots")
        settled = after.join(state.withColumnRenamed("root", "was"), "node").where("root <> was").isEmpty()
        discard(state)
        state = after
        if settled:
            return state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def merged_firms(clustered: DataFrame, firms: DataFrame) -> DataFrame:
    """The firm table after an upsert of the clusters that have a selected member; confidence never falls."""
    touched = clustered.groupBy("cluster").agg(F.max(F.col("selected_reason").isNotNull()).alias("t"), F.first("canonical").alias("canonical_name"), F.first("cluster_firm_id").alias("known"), F.min("confidence").alias("confidence")).where("t")
    canonical = N.normalize_name(N.ascii_fold(F.col("canonical_name")))
    new = touched.select(F.coalesce("known", F.xxhash64("canonical_name")).alias("id"), "canonical_name", canonical.alias("normalized_name"), F.col("confidence").cast("decimal(5,4)").alias("confidence"))
    old = firms.select("id", F.col("canonical_name").alias("old_name"), F.col("normalized_name").alias("old_norm"), F.col("confidence").alias("old_conf"))
    return new.join(old, "id", "full").select("id", F.coalesce("canonical_name", "old_name").alias("canonical_name"), F.coalesce("normalized_name", "old_norm").alias("normalized_name"), F.greatest("confidence", "old_conf").alias("confidence"))


def merged_aliases(clustered: DataFrame, aliases: DataFrame) -> DataFrame:
    """The alias table after the same upsert: every member's raw name leads to its cluster's firm."""
    new = clustered.where("selected_reason IS NOT NULL").select(F.col("raw").alias("raw_firm"), F.coalesce("cluster_firm_id", F.xxhash64("canonical")).alias("firm_id"), F.col("normalized").alias("normalized_raw_firm"), F.col("record_count").cast("int").alias("record_count"), F.col("confidence").cast("decimal(5,4)").alias("confidence"))
    old = aliases.select("raw_firm", *[F.col(c).alias(f"old_{c}") for c in ("firm_id", "normalized_raw_firm", "record_count", "confidence")])
    pick = lambda c: F.coalesce(c, f"old_{c}").alias(c)
    return new.join(old, "raw_firm", "full").select("raw_firm", pick("firm_id"), pick("normalized_raw_firm"), pick("record_count"), F.greatest("confidence", "old_confidence").alias("confidence"))


def log_rows(names: DataFrame, decided: DataFrame) -> DataFrame:
    """(input_value, status, reason, evidence): pairs for review, and names that normalise to nothing."""
    pairs = decided.where(F.col("decision") == REVIEW).select(F.concat("l_raw", F.lit(" <-> "), "r_raw").alias("input_value"), F.lit(REVIEW).alias("status"), F.col("decision_reason").alias("reason"), evidence_payload().alias("evidence"))
    skipped = names.where("normalized = ''").select(F.col("raw"), F.lit("skipped"), F.lit("nothing left after normalisation"), F.lit("{}"))
    return pairs.union(skipped)


def run_summary(decided: DataFrame, mode: str) -> DataFrame:
    """One row of a run's figures."""
    of = lambda d: F.count_if(F.col("decision") == d)
    return decided.agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("candidate_pairs"), of(ACCEPTED).alias("accepted"), of(REVIEW).alias("needs_review"), of(REJECTED).alias("rejected"))


def pair_table(spark: SparkSession, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """Labelled pairs of names (left, right, same/different/uncertain) with the signals of candidate_pairs()."""
    rows = spark.createDataFrame(pairs, "l_raw string, r_raw string, label string")
    for p in ("l", "r"):
        rows = rows.withColumn(f"{p}_folded", N.ascii_fold(F.col(f"{p}_raw"))).withColumn(f"{p}_normalized", N.normalize_name(F.col(f"{p}_folded")))
        rows = rows.withColumn(f"{p}_sound", N.metaphone(F.element_at(F.array_append(words_of(F.col(f"{p}_normalized")), ""), 1)))
    return score_pairs(rows)


def calibration(labelled: DataFrame) -> DataFrame:
    """One row (tp, fp, fn, tn, precision, recall, f1) of decided pairs with a label; uncertain ones don't count."""
    same, yes = F.col("label") == "same", F.col("decision") == ACCEPTED
    n = labelled.where("label <> 'uncertain'").agg(F.count_if(same & yes).alias("tp"), F.count_if(~same & yes).alias("fp"), F.count_if(same & ~yes).alias("fn"), F.count_if(~same & ~yes).alias("tn"))
    n = n.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
    return n.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def brand_matches(brands: DataFrame, firms: DataFrame, parents: DataFrame, known: DataFrame, threshold: float = 0.86) -> DataFrame:
    """(brand, firm_id, parent_group_id, tier, confidence): known aliases first, then similar firms, then similar parents.

    Only names that share a trigram with the brand are compared. Brands without a match get the tier unknown.
    """
    asked = brands.select("brand", N.normalize_name(N.ascii_fold(F.col("brand"))).alias("norm")).distinct()
    order = Window.partitionBy("brand").orderBy(F.col("first").desc(), F.col("confidence").desc(), "id")
    exact = asked.join(known.select(F.col("normalized_brand_name").alias("norm"), "firm_id", "parent_group_id", "provenance_tier", F.col("confidence").cast("double").alias("confidence")), "norm")
    exact = exact.select("brand", F.coalesce("firm_id", "parent_group_id").alias("id"), "firm_id", "parent_group_id", "provenance_tier", "confidence", (F.col("provenance_tier") == "fda_fact").cast("int").alias("first"))
    exact = exact.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn").withColumn("step", F.lit(0))

    def similar(table: DataFrame, role: str, step: int) -> DataFrame:
        grams = asked.select("brand", "norm", F.explode(trigrams(F.col("norm"))).alias("g"))
        there = table.select("id", "normalized_name", F.explode(trigrams(F.col("normalized_name"))).alias("g"))
        pairs = grams.join(there, "g").select("brand", "norm", "id", "normalized_name").distinct().withColumn("confidence", N.similarity(F.col("norm"), F.col("normalized_name"))).where(F.col("confidence") >= threshold)
        best = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("brand").orderBy(F.col("confidence").desc(), "id"))).where("rn = 1")
        null = F.lit(None).cast("long")
        ids = [F.col("id").alias("firm_id"), null.alias("parent_group_id")] if role == "firm" else [null.alias("firm_id"), F.col("id").alias("parent_group_id")]
        return best.select("brand", "id", *ids, F.lit("inferred").alias("provenance_tier"), "confidence", F.lit(0).alias("first"), F.lit(step).alias("step"))

    found = exact.unionByName(similar(firms, "firm", 1)).unionByName(similar(parents, "parent", 2))
    first = found.withColumn("rn", F.row_number().over(Window.partitionBy("brand").orderBy("step"))).where("rn = 1")
    out = asked.join(first.select("brand", "firm_id", "parent_group_id", "provenance_tier", "confidence"), "brand", "left")
    return out.select("brand", "firm_id", "parent_group_id", F.coalesce("provenance_tier", F.lit("unknown")).alias("provenance_tier"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def brand_candidates(records: DataFrame, brand: str, product: str, entity: str, shown_id: str, date: str, evidence_n: int = 5) -> DataFrame:
    """(entity, n, evidence, confidence) of records whose product mentions a brand: 0.85 for the most frequent entity if it's alone, else 0.65."""
    rows = records.where(F.col(product).ilike(like_pattern(brand)) & F.col(entity).isNotNull())
    counts = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    alone = counts.agg(F.count(F.lit(1)).alias("entities"))
    out = counts.crossJoin(F.broadcast(alone)).join(evidence(rows, [entity], [F.col(date).desc_nulls_last(), F.col(shown_id)], F.col(shown_id), evidence_n), entity)
    return out.select(entity, "n", "evidence", F.when(F.col("entities") == 1, 0.85).otherwise(0.65).alias("confidence"))


def routed_brands(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alias rows to write, log rows): matches with a target become aliases, the rest is logged for review."""
    hit = F.col("firm_id").isNotNull() | F.col("parent_group_id").isNotNull()
    logged = matches.where(~hit).select(F.lit("brand").alias("entity_type"), F.col("brand").alias("input_value"), F.lit("unresolved").alias("status"), F.lit("no alias, firm or parent is similar").alias("reason"), "provenance_tier")
    return matches.where(hit), logged


def run_record(run_id: str, mode: str, limits: Thresholds, summary: DataFrame | None = None, error: str | None = None) -> dict:
    """A run's audit row: running without figures, succeeded with them, failed with an error."""
    row = {"run_id": run_id, "mode": mode, "status": "failed" if error else "succeeded" if summary is not None else "running", "error": error, **{f"{k}_threshold": getattr(limits, k) for k in ("candidate", "merge", "review", "token")}}
    return row | (summary.drop("mode").first().asDict() if summary is not None else {})
