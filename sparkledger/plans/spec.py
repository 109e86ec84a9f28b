"""The constrained query specification: what a question may become, its refinement and its execution."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkledger.operators import aggregates as A
from sparkledger.operators import parents as P
from sparkledger.plans.catalog import Catalog
from sparkledger.plans.filters import Filter, lower_filter

MIN_LIMIT, MAX_LIMIT, USUAL_LIMIT = 1, 100, 20


class Intent(str, Enum):
    count_total = "count_total"
    count_by = "count_by"
    count_by_taxonomy = "count_by_taxonomy"
    trend = "trend"
    sample = "sample"
    raw_firm_exposure = "raw_firm_exposure"
    parent_group_exposure = "parent_group_exposure"
    explain_taxonomy_node = "explain_taxonomy_node"


class Op(str, Enum):
    eq = "eq"
    ne = "ne"
    in_ = "in"
    gte = "gte"
    lte = "lte"
    between = "between"
    ilike = "ilike"


class ExposureMetric(str, Enum):
    severity_weighted = "severity_weighted"
    recall_count = "recall_count"


EXPOSURE = (Intent.raw_firm_exposure, Intent.parent_group_exposure)


@dataclass(frozen=True)
class FilterSpec:
    column: str
    op: Op
    values: tuple[str, ...]


# fixed values: how the metrics of an exposure are called
METRIC_LABELS = {ExposureMetric.severity_weighted: "severity-weighted exposure score", ExposureMetric.recall_count: "recall count"}


@dataclass(frozen=True)
class QuerySpec:
    intent: Intent
    filters: tuple[FilterSpec, ...] = ()
    group_by: str | None = None
    taxonomy_node_id: str | None = None
    taxonomy_level: int | None = None
    semantic_query: str | None = None
    semantic_aliases: tuple[str, ...] = ()
    exposure_metric: ExposureMetric | None = None
    grain: str | None = None
    date_column: str | None = None
    limit: int | None = None


def refine(spec: QuerySpec, lists_records: bool = False) -> QuerySpec:
    """The spec with a limit in range and without slots that its intent doesn't use.

    Exact categories win over estimates, and a wording that lists records without counting (`lists_records`) samples.
    """
    n = min(MAX_LIMIT, max(MIN_LIMIT, spec.limit or USUAL_LIMIT))
    node = (spec.taxonomy_node_id or "").strip() or None
    out = replace(spec, limit=n, taxonomy_node_id=node)
    if spec.intent is Intent.explain_taxonomy_node:
        return QuerySpec(spec.intent, limit=n, taxonomy_node_id=node)
    if spec.intent in EXPOSURE:
        return QuerySpec(spec.intent, spec.filters, exposure_metric=spec.exposure_metric or ExposureMetric.severity_weighted, limit=n)
    concept = (spec.semantic_query or "").strip()
    if node or spec.intent is Intent.count_by_taxonomy or not concept:
        return replace(out, exposure_metric=None, semantic_query=None, semantic_aliases=())
    kept = {a.strip().casefold(): a.strip() for a in reversed(spec.semantic_aliases) if a.strip() and a.strip().casefold() != concept.casefold()}
    out = replace(out, exposure_metric=None, semantic_query=concept, semantic_aliases=tuple(reversed(kept.values())))
    if lists_records and spec.intent in (Intent.count_total, Intent.count_by):
        return replace(out, intent=Intent.sample, group_by=None)
    return out


def lowered(spec: QuerySpec, catalog: Catalog, strict: bool = False) -> list[Filter]:
    """The spec's filters with dates parsed; errors name what is wrong, so that a spec can be repaired."""
    out = []
    for f in spec.filters:
        values = list(f.values)
        if f.op not in (Op.in_, Op.between):
            if not values:
                raise ValueError(f"op {f.op.value!r} needs a value")
            values = values[:1]
        out.append(lower_filter(f.column, f.op.value, values, catalog, strict))
    return out


@dataclass
class Tables:
    """What an execution may read; sidecar tables may be missing."""

    records: DataFrame
    labels: DataFrame | None = None
    taxonomy: DataFrame | None = None
    aliases: DataFrame | None = None
    firms: DataFrame | None = None
    edges: DataFrame | None = None
    parents: DataFrame | None = None


@dataclass
class Answer:
    """A lazy result and what kind of payload it becomes."""

    kind: str
    rows: DataFrame | None
    metadata: dict = field(default_factory=dict)


def execute(spec: QuerySpec, tables: Tables, catalog: Catalog, version: str = "v1", semantic: Callable[[QuerySpec, list[Filter]], Answer] | None = None, evidence_n: int = 3) -> Answer:
    """The answer of a refined spec; a spec that can't be answered is an error that says why."""
    records, n = tables.records, spec.limit or USUAL_LIMIT
    if spec.intent is Intent.explain_taxonomy_node:
        if not spec.taxonomy_node_id:
            raise ValueError("explaining needs a category")
        if tables.labels is None or tables.labels.where((F.col("version") == version) & (F.col("node_id") == spec.taxonomy_node_id)).isEmpty():
            raise ValueError(f"no record has the category {spec.taxonomy_node_id!r}")
        return Answer("taxonomy_explanation", A.explain_node(records, tables.labels, tables.taxonomy, catalog, spec.taxonomy_node_id, version))
    filters = lowered(spec, catalog)
    rank_by = A.RANKS[spec.exposure_metric is ExposureMetric.recall_count]
    if spec.intent is Intent.parent_group_exposure:
        parts = {"firm_alias": tables.aliases, "firm": tables.firms, "edge": tables.edges, "parent_group": tables.parents}
        missing = [k for k, v in parts.items() if v is None]
        if missing:
            return Answer("raw_firm_exposure", None, {"available": False, "missing_tables": missing})
        if tables.edges.where(P.backed()).isEmpty():
            return Answer("raw_firm_exposure", None, {"available": False, "backed_edge_count": 0, "excluded_recall_count": None})
        return Answer("raw_firm_exposure", P.parent_leaderboard(records, tables.aliases, tables.firms, tables.edges, tables.parents, tables.labels, tables.taxonomy, catalog, filters, n, rank_by, evidence_n, version), {"available": True})
    if spec.intent is Intent.raw_firm_exposure:
        return Answer("raw_firm_exposure", A.exposure_leaderboard(records, tables.labels, tables.taxonomy, catalog, filters, n, rank_by, evidence_n, version))
    if spec.intent is Intent.count_by_taxonomy:
        return Answer("distribution", A.count_by_taxonomy(records, tables.labels, tables.taxonomy, catalog, filters, version, spec.taxonomy_level, n, evidence_n))
    if spec.taxonomy_node_id:
        if spec.intent is Intent.count_total:
            return Answer("scalar", A.count_total(records, catalog, filters, tables.labels, spec.taxonomy_node_id, version))
        if spec.intent is Intent.count_by and spec.group_by:
            return Answer("distribution", A.count_by(records, catalog, spec.group_by, filters, n, evidence_n, tables.labels, spec.taxonomy_node_id, version))
        raise ValueError("a category filter goes with count_total and count_by only")
    if spec.semantic_query:
        if spec.intent not in (Intent.sample, Intent.count_total, Intent.count_by):
            raise ValueError("a concept goes with sample, count_total and count_by only")
        if semantic is None:
            raise ValueError("no retrieval is bound for concepts")
        return semantic(spec, filters)
    if spec.intent is Intent.count_total:
        return Answer("scalar", A.count_total(records, catalog, filters))
    if spec.intent is Intent.count_by:
        if not spec.group_by:
            raise ValueError("count_by needs a column")
        return Answer("distribution", A.count_by(records, catalog, spec.group_by, filters, n, evidence_n))
    if spec.intent is Intent.trend:
        grain = spec.grain if spec.grain in A.GRAINS else "year"
        return Answer("series", A.trend(records, catalog, filters, grain, spec.date_column))
    if not filters:
        raise ValueError("a sample needs a filter")
    return Answer("rows", A.sample(records, catalog, filters, None, n))


def answer(question: str, make_spec: Callable[[str, str | None], QuerySpec], run: Callable[[QuerySpec], Answer]) -> Answer:
    """Runs a question's spec; after an error its text goes back once for a repaired spec."""
    try:
        return run(refine(make_spec(question, None)))
    except ValueError as e:
        try:
            return run(refine(make_spec(question, str(e))))
        except ValueError as again:
            return Answer("clarification", None, {"message": str(again)})


def payload(a: Answer, shown: int = MAX_LIMIT) -> dict:
    """The answer as plain data of its kind; results are short, so they are collected."""
    rows = [r.asDict(recursive=True) for r in a.rows.limit(shown).collect()] if a.rows is not None else []
    if a.kind == "scalar":
        return {"kind": a.kind, "value": next(iter(rows[0].values())) if rows else None, **a.metadata}
    name = {"distribution": "groups", "series": "points", "raw_firm_exposure": "items"}.get(a.kind, "rows")
    return {"kind": a.kind, name: rows, **a.metadata}


def summary(a: Answer, data: dict) -> list[str]:
    """Up to six lines, made only of what the payload holds."""
    if a.kind == "scalar":
        return [f"{data['value']} records match."]
    if a.kind == "raw_firm_exposure" and data.get("available") is False:
        return ["No confirmed parent edges with a source are there yet."]
    rows = next((v for v in data.values() if isinstance(v, list)), [])
    lines = [", ".join(f"{k}: {v}" for k, v in r.items() if not isinstance(v, (list, dict))) for r in rows[:5]]
    if data.get("mode") == "fts_only":
        lines.insert(0, "Found by words alone; the embedding provider did not answer.")
    return lines[:6] or ["No records match."]


def exposure_section(a: Answer, metric: ExposureMetric = ExposureMetric.severity_weighted) -> dict:
    """A leaderboard of parents as the one section of a multi-section payload, counted by the metric it is ranked by."""
    data = payload(a)
    primary = "total_recalls" if metric is ExposureMetric.recall_count else "exposure_score"
    items = []
    for r in data["items"]:
        more = {k: v for k, v in r.items() if k != "evidence"} | {"primary_metric": metric.value, "primary_value": r[primary]}
        items.append({"value": r["parent_group_name"], "label": r["parent_group_name"], "count": r[primary], "evidence": r.get("evidence") or [], "metadata": more})
    about = {"metric": metric.value, "metric_label": METRIC_LABELS[metric], **a.metadata}
    section = {"id": "parent_group_exposure", "title": f"Parent-group exposure by {METRIC_LABELS[metric]} (top {len(items)})", "kind": "distribution", "dimension": "parent_group", "source": "parent_group_exposure_v1", "items": items, "metadata": about}
    return {"kind": "multi_section", "intent": Intent.parent_group_exposure.value, "sections": [section]}
