"""Parent groups: provenance-gated rollup of records, coverage, and effective-dated edges."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkledger.operators.aggregates import MAX_EVIDENCE, MAX_LIMIT, RANKS, by_severity, clamp, class_counts, evidence, rank_order, top_reason
from sparkledger.plans.catalog import Catalog
from sparkledger.plans.filters import Filter, apply, not_blank

#: Mapping states in order of precedence.
STATES = ("unaliased", "mapped", "unconfirmed_parent_edge", "unknown_parent_edge", "llm_only_parent_edge", "no_parent_edge")
#: Edges that a bound by size allows to be broadcast; more of them are joined by a shuffle.
SMALL_SIDE = 1_000_000
BACKED_SOURCES = ("fda", "external", "manual")


def backed() -> Column:
    """Active, confirmed, of a known tier and not suggested by a model alone."""
    return F.col("active") & (F.col("review_status") == "confirmed") & (F.col("provenance_tier") != "unknown") & (F.col("source") != "llm")


def missing_tables(spark: SparkSession, names: Iterable[str]) -> list[str]:
    """Those of the tables or views that don't exist."""
    return [n for n in names if not spark.catalog.tableExists(n)]


def mapped(records: DataFrame, aliases: DataFrame, firms: DataFrame, edges: DataFrame, parents: DataFrame, catalog: Catalog) -> DataFrame:
    """Records with their firm and provenance-backed parent.

    The sidecar tables are joined among themselves first, to one narrow row a raw name, and then to the records.
    """
    entity = catalog.entity
    names = aliases.select(F.col("raw_firm").alias(entity), "firm_id")
    gate = edges.where(backed()).select("firm_id", "parent_group_id", "provenance_tier", "source", "source_name", "as_of_date")
    chain = names.join(firms.select(F.col("id").alias("firm_id"), F.col("canonical_name").alias("firm_name")), "firm_id")
    chain = chain.join(gate, "firm_id").join(parents.select(F.col("id").alias("parent_group_id"), F.col("canonical_name").alias("parent_group_name")), "parent_group_id")
    keep = dict.fromkeys([catalog.key, catalog.shown_id, entity, catalog.severity, catalog.event_date])
    return records.where(not_blank(entity)).select(*keep).join(chain, entity)


def parent_leaderboard(records: DataFrame, aliases: DataFrame, firms: DataFrame, edges: DataFrame, parents: DataFrame, labels: DataFrame, taxonomy: DataFrame, catalog: Catalog, filters: Iterable[Filter] = (), limit: int = 20, rank_by: str = RANKS[0], evidence_n: int = 3, version: str = "v1") -> DataFrame:
    """Parents by exposure: counts, member firms, top reason and evidence. Without backed edges there are no rows."""
    limit, evidence_n = clamp(limit, 1, MAX_LIMIT), clamp(evidence_n, 1, MAX_EVIDENCE)
    order = rank_order(rank_by, "parent_group_name")
    rows = mapped(apply(records, filters, catalog), aliases, firms, edges, parents, catalog)
    by = ["parent_group_id", "parent_group_name"]
    top = rows.groupBy(*by).agg(*class_counts(catalog), F.countDistinct("firm_id").alias("member_firm_count")).orderBy(*order).limit(limit)
    shown = rows.join(F.broadcast(top.select("parent_group_id")), "parent_group_id", "left_semi")
    out = top.join(top_reason(shown, "parent_group_id", labels, taxonomy, catalog, version), "parent_group_id", "left")
    out = out.join(evidence(shown, ["parent_group_id"], by_severity(catalog), F.col(catalog.shown_id), evidence_n), "parent_group_id", "left")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def members(records: DataFrame, aliases: DataFrame, firms: DataFrame, edges: DataFrame, parents: DataFrame, catalog: Catalog, filters: Iterable[Filter] = (), evidence_n: int = 3) -> DataFrame:
    """One row a member firm of a parent: counts, the provenance of its edge and evidence, to be nested or shown as it is."""
    rows = mapped(apply(records, filters, catalog), aliases, firms, edges, parents, catalog)
    by = ["parent_group_id", "parent_group_name", "firm_id", "firm_name"]
    lowest = [F.min(c).alias(c) for c in ("provenance_tier", "source", "source_name", "as_of_date")]
    counts = rows.groupBy(*by).agg(*class_counts(catalog), *lowest)
    return counts.join(evidence(rows, ["parent_group_id", "firm_id"], by_severity(catalog), F.col(catalog.shown_id), evidence_n), ["parent_group_id", "firm_id"], "left")


def edge_evidence(edges: DataFrame, column: str, by: Iterable[str] = ("parent_group_id", "firm_id")) -> DataFrame:
    """(by, edge_evidence): the distinct evidence of backed edges that isn't empty, in order.

    Taken from the edges, of which a firm has few, and not from the records that they are joined to.
    """
    said = edges.where(backed() & F.col(column).isNotNull() & ~F.btrim(column).isin("", "{}"))
    return said.groupBy(*by).agg(F.array_sort(F.collect_set(column)).alias("edge_evidence"))


def nested_members(member_rows: DataFrame) -> DataFrame:
    """(parent_group_id, member_breakdown): members as a JSON list, by exposure, number of records and name."""
    entry = F.struct(-F.col("exposure_score"), -F.col("total_recalls"), F.col("firm_name"), F.struct("firm_id", "firm_name", "total_recalls", "exposure_score").alias("m"))
    return member_rows.groupBy("parent_group_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["m"])).alias("member_breakdown"))


def parent_view(member_rows: DataFrame) -> DataFrame:
    """Second stage of the rollup: members' counts added up by parent."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("total_recalls", "class_i_recalls", "class_ii_recalls", "class_iii_recalls", "unclassified_recalls", "exposure_score")]
    return member_rows.groupBy("parent_group_id", "parent_group_name").agg(F.countDistinct("firm_id").alias("member_firm_count"), *sums)


def mapping_status(records: DataFrame, aliases: DataFrame, edges: DataFrame, catalog: Catalog) -> DataFrame:
    """Records (key, entity) with how their firm stands to a parent.

    Edges are first reduced to flags, one row a firm, instead of being probed by one subquery a state.
    """
    active = edges.where("active")
    flag = lambda test, name: F.max(F.when(test, 1).otherwise(0)).alias(name)
    confirmed = F.col("review_status") == "confirmed"
    flags = active.groupBy("firm_id").agg(flag(backed(), "is_mapped"), flag(~confirmed, "is_open"), flag(confirmed & (F.col("provenance_tier") == "unknown"), "is_unknown"), flag(confirmed & (F.col("source") == "llm"), "is_llm"))
    names = aliases.select(F.col("raw_firm").alias(catalog.entity), "firm_id").join(flags, "firm_id", "left").withColumn("is_aliased", F.lit(1))
    rows = records.where(not_blank(catalog.entity)).select(catalog.key, catalog.entity).join(names, catalog.entity, "left")
    state = F.when(F.col("is_aliased").isNull(), STATES[0])
    for column, name in (("is_mapped", STATES[1]), ("is_open", STATES[2]), ("is_unknown", STATES[3]), ("is_llm", STATES[4])):
        state = state.when(F.col(column) == 1, name)
    state = state.when(F.col("is_mapped").isNotNull(), STATES[2]).otherwise(STATES[5])
    return rows.select(catalog.key, catalog.entity, state.alias("mapping_status"))


def coverage(status: DataFrame, entity: str) -> DataFrame:
    """(mapped_recalls, excluded_recalls, excluded_raw_firms, status_counts JSON) of mapping_status() rows."""
    out = F.col("mapping_status") != "mapped"
    groups = status.groupBy("mapping_status").agg(F.count(F.lit(1)).alias("n"))
    sums = groups.agg(
        F.coalesce(F.sum(F.when(~out, F.col("n"))), F.lit(0)).cast("long").alias("mapped_recalls"),
        F.coalesce(F.sum(F.when(out, F.col("n"))), F.lit(0)).cast("long").alias("excluded_recalls"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mapping_status", "n"))))).alias("status_counts"),
    )
    return sums.crossJoin(status.where(out).agg(F.countDistinct(entity).alias("excluded_raw_firms")))


def unmapped_firms(aliases: DataFrame, firms: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """(firm_id, firm_name, records): firms without an active confirmed edge, by the records of their names."""
    have = edges.where(F.col("active") & (F.col("review_status") == "confirmed")).select("firm_id")
    sizes = aliases.groupBy("firm_id").agg(F.sum("record_count").cast("long").alias("records"))
    out = sizes.join(have, "firm_id", "left_anti").join(firms.select(F.col("id").alias("firm_id"), F.col("canonical_name").alias("firm_name")), "firm_id")
    return out.orderBy(F.col("records").desc(), F.col("firm_name").asc()).limit(limit)


def placeholders(unmapped: DataFrame, as_of: Column) -> DataFrame:
    """Confirmed edges of unknown provenance from unmapped firms to a group of their own."""
    unknown = F.lit("unknown")
    return unmapped.select("firm_id", F.xxhash64("firm_name").alias("parent_group_id"), unknown.alias("provenance_tier"), unknown.alias("source"), as_of.cast("date").alias("as_of_date"), F.lit("confirmed").alias("review_status"), F.lit(True).alias("active"), F.lit(0.0).cast("decimal(5,4)").alias("confidence"))


def seed_problem() -> Column:
    """Why a seed can't become an edge, or null."""
    tier, source = F.col("provenance_tier"), F.col("source")
    known = tier != "unknown"
    return (
        F.when((tier == "unknown") != (source == "unknown"), "unknown tier and unknown source go together")
        .when(source == "llm", "a model alone is no source")
        .when(known & F.coalesce(F.col("source_name") == "", F.lit(True)), "a source needs a name")
        .when(known & F.col("source_url").isNull() & F.col("source_id").isNull(), "a source needs a URL or an id")
    )


def resolve_seeds(seeds: DataFrame, firms: DataFrame, aliases: DataFrame) -> DataFrame:
    """(seed columns, matches, firm_id, outcome): each seed's firm_name against canonical, normalised and raw names.

    The alternatives are separate equality joins, so none of them needs a nested loop. One firm: resolved; several:
    ambiguous; none: unresolved.
    """
    name = F.col("firm_name")
    firm = firms.select(F.col("id").alias("_f"), F.col("canonical_name").alias("_c"), F.col("normalized_name").alias("_n"))
    alias = aliases.select(F.col("firm_id").alias("_f"), F.col("raw_firm").alias("_r"), F.col("normalized_raw_firm").alias("_n"))
    norm = F.col("normalized_firm_name")
    found = [seeds.join(firm, norm == F.col("_n")), seeds.join(alias, norm == F.col("_n")), seeds.join(firm, F.lower(name) == F.lower("_c")), seeds.join(alias, F.lower(name) == F.lower("_r"))]
    pairs = found[0].select("seed_id", "_f")
    for f in found[1:]:
        pairs = pairs.union(f.select("seed_id", "_f"))
    counts = pairs.groupBy("seed_id").agg(F.countDistinct("_f").alias("matches"), F.min("_f").alias("_m"))
    out = seeds.join(counts, "seed_id", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    outcome = F.when(F.col("matches") == 1, "resolved").when(F.col("matches") > 1, "ambiguous").otherwise("unresolved")
    return out.withColumn("firm_id", F.when(F.col("matches") == 1, F.col("_m"))).drop("_m").withColumn("outcome", outcome)


#: What makes two edges of a firm the same statement.
IDENTITY = ("firm_id", "parent_group_id", "provenance_tier", "source", "source_id", "as_of_date")


def write_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """The edge table after `new` confirmed edges: others of their firms superseded, identical ones refreshed, the rest opened.

    Both have IDENTITY, review_status, active and confidence. Of several new edges of a firm the last by as_of_date
    (then parent and source) counts. An identical edge that had been closed is opened again; confidence never falls.
    """
    last = Window.partitionBy("firm_id").orderBy(F.col("as_of_date").desc_nulls_last(), F.col("parent_group_id").desc(), F.col("source").desc())
    new = new.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")
    both = edges.select(*IDENTITY, "review_status", "active", "confidence", F.lit(0).alias("_new")).union(new.select(*IDENTITY, F.lit("confirmed"), F.lit(True), "confidence", F.lit(1)))
    same = both.groupBy(*IDENTITY).agg(F.max("_new").alias("_new"), F.max("confidence").alias("_high"), F.max_by("review_status", "_new").alias("_status"), F.max(F.when(F.col("_new") == 0, F.col("active"))).alias("_was"), F.max(F.when(F.col("_new") == 0, F.col("confidence"))).alias("_old"))
    touched = same.withColumn("_touched", F.max("_new").over(Window.partitionBy("firm_id")))
    closes = (F.col("_touched") == 1) & (F.col("_new") == 0) & F.col("_was") & (F.col("_status") == "confirmed")
    return touched.select(
        *IDENTITY,
        F.when(F.col("_new") == 1, "confirmed").when(closes, "superseded").otherwise(F.col("_status")).alias("review_status"),
        F.when(F.col("_new") == 1, True).when(closes, False).otherwise(F.col("_was")).alias("active"),
        F.when(F.col("_new") == 1, F.col("_high")).otherwise(F.col("_old")).alias("confidence"),
    )


def edge_problems(edges: DataFrame) -> DataFrame:
    """(firm_id, problem) of every broken rule; a sound table gives no rows."""
    unknown = F.col("provenance_tier") == "unknown"
    confirmed = F.col("review_status") == "confirmed"
    rules = (
        F.when(unknown & ((F.col("source") != "unknown") | (F.col("confidence") != 0)), "unknown tier needs unknown source and no confidence")
        .when(confirmed & ~unknown & ~F.col("source").isin(*BACKED_SOURCES), "confirmed edges need a backed source")
        .when((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence outside 0 to 1")
    )
    single = edges.select("firm_id", rules.alias("problem")).where("problem IS NOT NULL")
    several = edges.where(F.col("active") & confirmed).groupBy("firm_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return single.union(several.select("firm_id", F.lit("several active confirmed edges").alias("problem")))
