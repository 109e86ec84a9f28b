"""Counting with evidence: totals, distributions, trends, samples and leaderboards.

Counts are partial aggregations. Evidence (ids behind a figure) is taken for the groups shown only, by a ranked
window whose limit Spark applies before its shuffle, so a group of any size hands on no more than a few rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkledger.plans.catalog import Catalog, Kind
from sparkledger.plans.filters import Filter, apply, not_blank, with_label

GRAINS = ("year", "quarter", "month", "week", "day")
RANKS = ("severity_weighted_exposure", "recall_count")
DEFAULT_LIMIT, MAX_LIMIT, MAX_EVIDENCE = 50, 100, 10


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(int(n), high))


def selected(records: DataFrame, catalog: Catalog, filters: Iterable[Filter] = (), labels: DataFrame | None = None, node_id: str | None = None, version: str = "v1") -> DataFrame:
    """Records that satisfy the filters and, if a node is given, have its label."""
    rows = apply(records, filters, catalog)
    return with_label(rows, labels, node_id, catalog, version) if node_id else rows


def evidence(rows: DataFrame, by: list[str], order: list[Column], shown: Column, n: int) -> DataFrame:
    """(by..., evidence): the first n ids of each group in the given order, as an array."""
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n)
    pairs = F.array_sort(F.collect_list(F.struct("_rn", shown.alias("_id"))))
    return ranked.groupBy(*by).agg(F.transform(pairs, lambda p: p["_id"]).alias("evidence"))


def newest_first(catalog: Catalog) -> list[Column]:
    return [F.col(catalog.event_date).desc_nulls_last(), F.col(catalog.shown_id).asc_nulls_last()]


def severity(catalog: Catalog) -> Column:
    """The weight of a record's class; 0 for others and none."""
    out = F.lit(0)
    for name, weight in reversed(catalog.classes):
        out = F.when(F.col(catalog.severity) == name, weight).otherwise(out)
    return out


def count_total(records: DataFrame, catalog: Catalog, filters: Iterable[Filter] = (), labels: DataFrame | None = None, node_id: str | None = None, version: str = "v1") -> DataFrame:
    """One row (n)."""
    return selected(records, catalog, filters, labels, node_id, version).agg(F.count(F.lit(1)).alias("n"))


def _with_evidence(groups: DataFrame, rows: DataFrame, by: list[str], order: list[Column], shown: Column, n: int) -> DataFrame:
    """`groups` (few rows) with the evidence of each; null group values match null."""
    few = F.broadcast(groups.select(*[F.col(c).alias(f"_{c}") for c in by]))
    same = None
    for c in by:
        test = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = test if same is None else same & test
    found = evidence(rows.join(few, same, "left_semi"), by, order, shown, n).select(*[F.col(c).alias(f"_{c}") for c in by], "evidence")
    return groups.join(found, same, "left").drop(*[f"_{c}" for c in by])


def count_by(records: DataFrame, catalog: Catalog, dimension: str, filters: Iterable[Filter] = (), limit: int = DEFAULT_LIMIT, evidence_n: int = 0, labels: DataFrame | None = None, node_id: str | None = None, version: str = "v1") -> DataFrame:
    """(dimension, n[, evidence]) of the largest groups; NULL is a group, ties go by value with NULL last."""
    catalog.kind(dimension)
    rows = selected(records, catalog, filters, labels, node_id, version)
    order = [F.col("n").desc(), F.col(dimension).asc_nulls_last()]
    top = rows.groupBy(dimension).agg(F.count(F.lit(1)).alias("n")).orderBy(*order).limit(limit)
    return _with_evidence(top, rows, [dimension], newest_first(catalog), F.col(catalog.shown_id), evidence_n).orderBy(*order) if evidence_n else top


def labelled(rows: DataFrame, labels: DataFrame, taxonomy: DataFrame, catalog: Catalog, version: str, keep: list[str]) -> DataFrame:
    """(keep..., node_id, label, level): rows with each of their labels once; taxonomies are small, so broadcast."""
    marks = labels.where(F.col("version") == version).select(F.col("record_id").alias(catalog.key), "node_id").distinct()
    nodes = taxonomy.where(F.col("version") == version).select("node_id", "label", "level")
    return rows.select(*dict.fromkeys([catalog.key, *keep])).join(marks, catalog.key).join(F.broadcast(nodes), "node_id")


def count_by_taxonomy(records: DataFrame, labels: DataFrame, taxonomy: DataFrame, catalog: Catalog, filters: Iterable[Filter] = (), version: str = "v1", level: int | None = None, limit: int = DEFAULT_LIMIT, evidence_n: int = 0) -> DataFrame:
    """(node_id, label, n[, evidence]): distinct records a label, most first, then by label and node."""
    found = labelled(apply(records, filters, catalog), labels, taxonomy, catalog, version, [catalog.shown_id, catalog.event_date])
    if level is not None:
        found = found.where(F.col("level") == level)
    order = [F.col("n").desc(), F.col("label").asc(), F.col("node_id").asc()]
    top = found.groupBy("node_id", "label").agg(F.countDistinct(catalog.key).alias("n")).orderBy(*order).limit(limit)
    return _with_evidence(top, found, ["node_id", "label"], newest_first(catalog), F.col(catalog.shown_id), evidence_n).orderBy(*order) if evidence_n else top


def trend(records: DataFrame, catalog: Catalog, filters: Iterable[Filter] = (), grain: str = "month", date_column: str | None = None) -> DataFrame:
    """(period date, n), ascending; rows without the date are left out and gaps are not filled."""
    if grain not in GRAINS:
        raise ValueError(f"unknown grain: {grain!r}")
    column = catalog.require(date_column or catalog.event_date, Kind.DATE)
    rows = apply(records, filters, catalog).where(F.col(column).isNotNull())
    return rows.groupBy(F.date_trunc(grain, F.col(column)).cast("date").alias("period")).agg(F.count(F.lit(1)).alias("n")).orderBy("period")


def sample(records: DataFrame, catalog: Catalog, filters: Iterable[Filter] = (), columns: Iterable[str] | None = None, n: int = 5) -> DataFrame:
    """The first n records by key, with whitelisted columns."""
    columns = list(columns or catalog.sample_columns)
    for c in columns:
        catalog.kind(c)
    top = apply(records, filters, catalog).orderBy(F.col(catalog.key).asc_nulls_last()).limit(max(0, int(n)))
    return top.select(*columns)


def class_counts(catalog: Catalog) -> list[Column]:
    """total_recalls, one count a class, unclassified_recalls and exposure_score."""
    c = F.col(catalog.severity)
    names = [name for name, _ in catalog.classes]
    slots = ["class_i_recalls", "class_ii_recalls", "class_iii_recalls"]
    return [
        F.count(F.lit(1)).alias("total_recalls"),
        *[F.count_if(c == name).alias(slot) for name, slot in zip(names, slots, strict=True)],
        F.count_if(c.isNull() | ~c.isin(names)).alias("unclassified_recalls"),
        F.sum(severity(catalog)).cast("long").alias("exposure_score"),
    ]


def class_breakdown(records: DataFrame, catalog: Catalog, filters: Iterable[Filter] = ()) -> DataFrame:
    """One row of class_counts()."""
    out = apply(records, filters, catalog).agg(*class_counts(catalog))
    return out.withColumn("exposure_score", F.coalesce("exposure_score", F.lit(0)))


def rank_order(rank_by: str, name: str) -> list[Column]:
    if rank_by not in RANKS:
        raise ValueError(f"rank_by is one of {', '.join(RANKS)}")
    both = [F.col("exposure_score").desc(), F.col("total_recalls").desc()]
    return [*(both if rank_by == RANKS[0] else reversed(both)), F.col(name).asc()]


def top_reason(rows: DataFrame, by: str, labels: DataFrame, taxonomy: DataFrame, catalog: Catalog, version: str = "v1") -> DataFrame:
    """(by, top_reason_category, top_reason_node_id, top_reason_count): the commonest label of each group, ties by label."""
    found = labelled(rows, labels, taxonomy, catalog, version, [by])
    counts = found.groupBy(by, "label", "node_id").agg(F.countDistinct(catalog.key).alias("top_reason_count"))
    order = Window.partitionBy(by).orderBy(F.col("top_reason_count").desc(), F.col("label").asc(), F.col("node_id").asc())
    best = counts.withColumn("_rn", F.row_number().over(order)).where("_rn = 1")
    return best.select(by, F.col("label").alias("top_reason_category"), F.col("node_id").alias("top_reason_node_id"), "top_reason_count")


def by_severity(catalog: Catalog) -> list[Column]:
    return [severity(catalog).desc(), *newest_first(catalog)]


def exposure_leaderboard(records: DataFrame, labels: DataFrame, taxonomy: DataFrame, catalog: Catalog, filters: Iterable[Filter] = (), limit: int = 20, rank_by: str = RANKS[0], evidence_n: int = 3, version: str = "v1") -> DataFrame:
    """Entities by severity-weighted exposure or by number of records.

    (rank, entity, exposure_score, total_recalls, class counts, top reason, evidence): only entities that are shown
    are joined with labels and asked for evidence. Blank and null entities take no part.
    """
    limit, evidence_n = clamp(limit, 1, MAX_LIMIT), clamp(evidence_n, 1, MAX_EVIDENCE)
    entity = catalog.entity
    order = rank_order(rank_by, entity)
    rows = apply(records, filters, catalog).where(not_blank(entity)).select(*dict.fromkeys([catalog.key, catalog.shown_id, entity, catalog.severity, catalog.event_date]))
    top = rows.groupBy(entity).agg(*class_counts(catalog)).orderBy(*order).limit(limit)
    shown = rows.join(F.broadcast(top.select(entity)), entity, "left_semi")
    out = top.join(top_reason(shown, entity, labels, taxonomy, catalog, version), entity, "left")
    out = out.join(evidence(shown, [entity], by_severity(catalog), F.col(catalog.shown_id), evidence_n), entity, "left")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_values(records: DataFrame, catalog: Catalog, column: str, filters: Iterable[Filter] = (), limit: int = 5) -> DataFrame:
    """(section value, n) of the commonest non-blank values of any column."""
    rows = apply(records, filters, catalog).where(not_blank(column))
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("value").asc()).limit(limit)


def reasons_and_products(records: DataFrame, labels: DataFrame, taxonomy: DataFrame, catalog: Catalog, filters: Iterable[Filter], product: str, reason: str, limit: int = 5, version: str = "v1") -> DataFrame:
    """(section, value, n): top labels (raw reason texts if there are none) and top products of the records selected."""
    filters = list(filters)
    reasons = count_by_taxonomy(records, labels, taxonomy, catalog, filters, version, limit=limit).select(F.lit("reasons").alias("section"), F.col("label").alias("value"), "n")
    if reasons.isEmpty():
        reasons = top_values(records, catalog, reason, filters, limit).select(F.lit("reasons").alias("section"), "value", "n")
    return reasons.union(top_values(records, catalog, product, filters, limit).select(F.lit("products").alias("section"), "value", "n"))


def explain_node(records: DataFrame, labels: DataFrame, taxonomy: DataFrame, catalog: Catalog, node_id: str, version: str = "v1", examples: int = 5) -> DataFrame:
    """(node_id, label, definition, parent_label, evidence) of a node, with the newest records that have its label."""
    nodes = taxonomy.where(F.col("version") == version)
    parent = nodes.select(F.col("node_id").alias("parent_id"), F.col("label").alias("parent_label"))
    node = nodes.where(F.col("node_id") == node_id).join(parent, "parent_id", "left").select("node_id", "label", "definition", "parent_label")
    have = with_label(records, labels, node_id, catalog, version).withColumn("node_id", F.lit(node_id))
    return node.join(evidence(have, ["node_id"], newest_first(catalog), F.col(catalog.shown_id), examples), "node_id", "left")


def record_detail(records: DataFrame, catalog: Catalog, shown_id: str, raw: str = "raw") -> DataFrame:
    """The record with this id, catalog columns falling back to its raw JSON; no row if the id isn't well formed or known."""
    if not re.fullmatch(r"[A-Z]-[0-9]{3,4}-[0-9]{4}", shown_id or ""):
        return records.where(F.lit(False)).select(*[F.lit(None).cast("string").alias(c) for c in catalog.columns])
    row = records.where(F.col(catalog.shown_id) == shown_id).limit(1)
    parts = []
    for c in catalog.columns:
        stored = F.col(c).cast("string") if c in records.columns else F.lit(None).cast("string")
        parts.append((F.coalesce(stored, F.get_json_object(raw, f"$.{c}")) if raw in records.columns else stored).alias(c))
    return row.select(*parts)


def lookup(records: DataFrame, catalog: Catalog, ids: Iterable[str], columns: Iterable[str] = ()) -> DataFrame:
    """Rows of a few ids, for enriching a result."""
    return records.where(F.col(catalog.shown_id).isin(list(ids))).select(catalog.shown_id, *(c for c in columns if c != catalog.shown_id))
