"""Audit and evaluation: fingerprints, retrieval metrics, run comparison and traces."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the list of a payload that is counted, by its kind, and the figures of an estimate
LISTS = {"retrieval": ("items", "rows"), "distribution": ("items", "groups"), "semantic_count": ("evidence_items",), "semantic_distribution": ("items", "groups"), "series": ("points",), "rows": ("rows",), "raw_firm_exposure": ("items",), "message": ("suggestions",), "clarification": ("suggestions",)}
ESTIMATES = ("estimated_count", "verified_count", "validated_count", "candidate_count")


def fingerprint(df: DataFrame, key: str) -> DataFrame:
    """One row (rows, distinct_keys, digest) that changes when any value of any row does, whatever the row order.

    Rows are hashed where they are and the hashes added up in 8 parts, so nothing is sorted or gathered; sums tell
    repeated rows apart, which an exclusive or would not.
    """
    cols = sorted(df.columns)
    canonical = F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]), {"ignoreNullFields": "false"})
    h = F.sha2(canonical, 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)"))
    sums = [F.coalesce(part(i), F.lit(0)).cast("string") for i in range(8)]
    out = df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("distinct_keys"), F.sha2(F.concat_ws(",", *sums), 256).alias("digest"))
    return out


def column_stats(df: DataFrame, distinct: list[str], date: str | None = None) -> DataFrame:
    """One row: rows, a distinct count a column, and the range of a date."""
    parts = [F.count(F.lit(1)).alias("rows"), *[F.countDistinct(c).alias(f"distinct_{c}") for c in distinct]]
    parts += [F.min(date).alias("first_date"), F.max(date).alias("last_date")] if date else []
    return df.agg(*parts)


def retrieval_metrics(returned: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """(case_id, recall_at_k, mrr_at_k, ndcg_at_k) of ranked ids against expected ones; an id counts once, at its first rank."""
    first = returned.groupBy("case_id", "id").agg(F.min("rank").alias("rank")).where(F.col("rank") <= k)
    goal = expected.select("case_id", "id").distinct()
    sizes = goal.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    hits = first.join(goal, ["case_id", "id"]).groupBy("case_id").agg(F.count(F.lit(1)).alias("found"), F.min("rank").alias("best"), F.sum(F.lit(1.0) / F.log2(F.col("rank") + 1)).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1.0))
    out = sizes.join(hits, "case_id", "left")
    return out.select("case_id", (F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall_at_k"), F.coalesce(F.lit(1.0) / F.col("best"), F.lit(0.0)).alias("mrr_at_k"), F.coalesce(F.col("gain") / ideal, F.lit(0.0)).alias("ndcg_at_k"))


def compare_runs(before: DataFrame, after: DataFrame, tolerance_ms: dict[str, int] | None = None, default_ms: int = 1000, recall_tolerance: float = 0.0) -> DataFrame:
    """(case_id, change): improved, unchanged, regressed, added or removed, from status, latency and recall.

    Both have case_id, suite, status, latency_ms and recall. Any regression outweighs any improvement.
    """
    old = before.select("case_id", *[F.col(c).alias(f"old_{c}") for c in ("suite", "status", "latency_ms", "recall")])
    rows = after.join(old, "case_id", "full")
    allowed = F.lit(default_ms)
    for suite, ms in (tolerance_ms or {"core": 500, "rag": 2000}).items():
        allowed = F.when(F.coalesce("suite", "old_suite") == suite, ms).otherwise(allowed)
    passed, had = F.col("status") == "pass", F.col("old_status") == "pass"
    slower = F.coalesce(F.col("latency_ms") > F.col("old_latency_ms") + allowed, F.lit(False))
    faster = F.coalesce(F.col("latency_ms") < F.col("old_latency_ms") - allowed, F.lit(False))
    worse = F.coalesce(F.col("recall") < F.col("old_recall") - recall_tolerance, F.lit(False))
    better = F.coalesce(F.col("recall") > F.col("old_recall") + recall_tolerance, F.lit(False))
    change = F.when(F.col("old_status").isNull(), "added").when(F.col("status").isNull(), "removed").when((had & ~passed) | slower | worse, "regressed").when((~had & passed) | faster | better, "improved").otherwise("unchanged")
    return rows.select("case_id", change.alias("change"))


def roll_up(results: DataFrame) -> DataFrame:
    """(suite, passed, failed, skipped, pass_rate): overall as suite all; a case counts in each of its suites."""
    rows = results.select("case_id", "status", F.explode(F.array_append("suites", "all")).alias("suite"))
    of = lambda s: F.count_if(F.col("status") == s)
    out = rows.groupBy("suite").agg(of("pass").alias("passed"), of("fail").alias("failed"), of("skip").alias("skipped"))
    return out.withColumn("pass_rate", F.coalesce(F.try_divide(F.col("passed"), F.col("passed") + F.col("failed")), F.lit(0.0)))


def gate(results: DataFrame, allowed_skips: list[str] | None = None, suite: str = "core") -> DataFrame:
    """(case_id, problem) of cases of a suite that failed or were skipped without leave; none if the gate is open."""
    rows = results.where(F.array_contains("suites", suite))
    problem = F.when(F.col("status") == "fail", "failed").when((F.col("status") == "skip") & ~F.col("case_id").isin(allowed_skips or [""]), "skipped")
    return rows.select("case_id", problem.alias("problem")).where("problem IS NOT NULL")


def debug_record(df: DataFrame, query_id: str, seq: int, title: str, params: dict, source: str) -> dict:
    """What was run, for an answer's audit trail."""
    plan = df._jdf.queryExecution().analyzed().toString()
    return {"id": f"{query_id}_{seq}", "title": title, "plan": plan, "params": {k: str(v) for k, v in params.items()}, "source": source}


def trace(spark: SparkSession, path: str, rows: list[dict], schema: str) -> list[str]:
    """Appends request traces as JSON lines and returns the ids they got, in the order of the rows."""
    fields = [f.split()[0] for f in schema.split(", ")]
    ids = [str(uuid.uuid4()) for _ in rows]
    spark.createDataFrame([(*(r.get(f) for f in fields), i) for r, i in zip(rows, ids, strict=True)], f"{schema}, trace_id string").write.mode("append").json(path)
    return ids


def _shown(part: Mapping, names: Iterable[str]) -> int | None:
    return next((len(part[n]) for n in names if isinstance(part.get(n), list)), None)


def response_metadata(data: Mapping | None, summary: str = "", model: str | None = None, provider: str | None = None) -> dict:
    """What a log keeps of a payload: its kind, sizes, estimates and how it was found, but none of its rows."""
    out = {"data_kind": data.get("kind") if data else None, "summary_chars": len(summary or "")}
    out |= {k: v for k, v in (("provider", provider), ("model", model)) if v}
    if not data:
        return out
    kind = data.get("kind")
    if kind == "multi_section":
        sections = [s for s in data.get("sections") or [] if isinstance(s, Mapping)]
        kept = [{**{k: s.get(k) for k in ("id", "kind", "dimension", "source")}, "result_count": _shown(s, ("items", "rows")) or 0} for s in sections]
        return out | {"section_count": len(kept), "result_count": sum(s["result_count"] for s in kept), "sections": kept}
    if (n := _shown(data, LISTS.get(kind, ()))) is not None:
        out["result_count"] = n
    if kind in ("semantic_count", "semantic_distribution"):
        out |= {k: data[k] for k in ESTIMATES if isinstance(data.get(k), int)}
    out |= {k: data[k] for k in ("retrieval_mode", "embedding_fallback_reason") if data.get(k)}
    if data.get("degraded"):
        out["degraded"] = True
    if kind in ("message", "clarification"):
        out |= {k: data[k] for k in ("route", "reason") if data.get(k)}
    return out


def search_request(query: str, field: str, k: int, aliases: Iterable[str], filters: list[dict], rejected: bool = False) -> dict:
    """The request of a search as it is logged: checked filters only; of rejected ones nothing but that they were."""
    shown = {"items": [] if rejected else filters}
    if rejected:
        shown |= {"valid": False, "omitted_raw": True}
    names = dict.fromkeys(a.strip() for a in aliases if a and a.strip())
    return {"query": query, "field": field, "k": k, "aliases": list(names), "filters": shown}


def provider_status(**providers: tuple[str | None, str | None, bool]) -> dict:
    """{role}_provider, {role}_model and {role}_configured of each role's (provider, model, configured)."""
    parts = ("provider", "model", "configured")
    return {f"{role}_{part}": value for role, given in providers.items() for part, value in zip(parts, given, strict=True)}


def highlights(rows: DataFrame, column: str, n: int = 3) -> list[str]:
    """The commonest repeated values of a shown result (few rows)."""
    top = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.col("n").desc(), "v").limit(n)
    return [f"{r.v}: {r.n}" for r in top.collect()]
