"""One registered query an operator, over the driver tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkledger import bindings as B
from sparkledger.bindings import ORDERS, with_sql
from sparkledger.functions import names as N
from sparkledger.functions import stats, text
from sparkledger.operators import aggregates as A
from sparkledger.operators import entities, evaluation, fulltext, parents, recall_reasons, retrieval, semantic
from sparkledger.operators import taxonomy as T
from sparkledger.plans import catalog as C
from sparkledger.plans import filters, routers, spec
from sparkledger.plans.filters import Filter
from sparkledger.sources import ingest
from sparkledger.storage import shared_path
from sparkledger.streaming import updates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return keep


def joined(df: DataFrame, column: str = "evidence") -> DataFrame:
    """An array column as text, for comparison."""
    return df.withColumn(column, F.coalesce(F.array_join(column, ","), F.lit("")))


def ev(order: str, n: int = 3, ids: str = "recall_number") -> str:
    return f"array_to_string(list_slice(array_agg({ids} ORDER BY {order}), 1, {n}), ',')"


NEWEST = "recall_initiation_date DESC NULLS LAST, recall_number"
SEVERE = f"CASE classification WHEN 'Class I' THEN 3 WHEN 'Class II' THEN 2 WHEN 'Class III' THEN 1 ELSE 0 END DESC, {NEWEST}"
CLASSES = """count(*) AS total_recalls, count(*) FILTER (WHERE classification = 'Class I') AS class_i_recalls, count(*) FILTER (WHERE classification = 'Class II') AS class_ii_recalls,
    count(*) FILTER (WHERE classification = 'Class III') AS class_iii_recalls, count(*) FILTER (WHERE classification IS NULL OR classification NOT IN ('Class I', 'Class II', 'Class III')) AS unclassified_recalls,
    3 * count(*) FILTER (WHERE classification = 'Class I') + 2 * count(*) FILTER (WHERE classification = 'Class II') + count(*) FILTER (WHERE classification = 'Class III') AS exposure_score"""

# -- filters and totals ------------------------------------------------------------------------------------------------

FILTERS: dict[str, tuple[list[Filter], str]] = {
    "count_total_all": ([], "true"),
    "filter_eq": ([Filter("status", "eq", "F")], "status = 'F'"),
    "filter_ne_nulls": ([Filter("classification", "ne", "Class I")], "classification <> 'Class I'"),
    "filter_in": ([Filter("status", "in", ["F", "P"])], "status IN ('F', 'P')"),
    "filter_in_empty": ([Filter("status", "in", [])], "false"),
    "filter_gte_lte": ([Filter("report_date", "gte", date(1996, 1, 1)), Filter("report_date", "lte", date(1997, 6, 30))], "report_date >= DATE '1996-01-01' AND report_date <= DATE '1997-06-30'"),
    "filter_between_dates": ([Filter("report_date", "between", (date(1996, 1, 1), date(1996, 12, 31)))], "report_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"),
    "filter_ilike_wildcards": ([Filter("recalling_firm", "ilike", "CUSTOMER#%0_1")], "recalling_firm ILIKE '%CUSTOMER#%0_1%'"),
    "filter_conjunction": ([Filter("status", "eq", "O"), Filter("classification", "in", ["Class I", "Class II"]), Filter("report_date", "gte", date(1999, 1, 1))], "status = 'O' AND classification IN ('Class I', 'Class II') AND report_date >= DATE '1999-01-01'"),
}
for _name, (_filters, _where) in FILTERS.items():
    query(with_sql("r", f"SELECT count(*) AS n FROM r WHERE {_where}"), _name)(lambda s, d, f=_filters: A.count_total(B.records(s, d), ORDERS, f))


@query("SELECT count(*) AS n FROM documents WHERE text ILIKE '%tion%' AND lang = 'en'")
def filter_ilike(s: SparkSession, d: str) -> DataFrame:
    docs = C.Catalog({"text": C.Kind.TEXT, "lang": C.Kind.DIMENSION}, key="doc_id")
    return A.count_total(B.table(s, d, "documents"), docs, [Filter("text", "ilike", "tion"), Filter("lang", "eq", "en")])


@query(with_sql("r", "SELECT count(*) AS n FROM r WHERE recalling_firm IS NOT NULL AND trim(recalling_firm, ' ') <> ''"))
def filter_not_blank(s: SparkSession, d: str) -> DataFrame:
    return B.records(s, d).where(filters.not_blank("recalling_firm")).agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("r", "SELECT count(*) AS n FROM r WHERE status IN ('F', 'O') AND report_date >= DATE '1996-01-01' AND report_date <= DATE '1998-12-31' AND country = 'NATION_3'"))
def filter_request_object(s: SparkSession, d: str) -> DataFrame:
    asked = {"status": ["F", "O"], "report_date": {"gte": "1996-01-01", "lte": "19981231"}, "country": {"op": "eq", "value": "NATION_3"}, "state": None, "segment": []}
    return A.count_total(B.records(s, d), ORDERS, filters.coerce_filters(asked, ORDERS))


@query(with_sql("rl", "SELECT count(*) AS n FROM r WHERE EXISTS (SELECT 1 FROM l WHERE l.record_id = r.id AND l.version = 'v1' AND l.node_id = 'promo')"))
def taxonomy_semi_count(s: SparkSession, d: str) -> DataFrame:
    return A.count_total(B.records(s, d), ORDERS, [], B.labels(s, d), "promo")


@query(with_sql("rl", "SELECT status, count(*) AS n FROM r WHERE EXISTS (SELECT 1 FROM l WHERE l.record_id = r.id AND l.node_id = 'promo') GROUP BY status"))
def taxonomy_semi_count_by(s: SparkSession, d: str) -> DataFrame:
    return A.count_by(B.records(s, d), ORDERS, "status", labels=B.labels(s, d), node_id="promo")


# -- distributions, trends, samples ------------------------------------------------------------------------------------


@query(with_sql("r", "SELECT status, count(*) AS n FROM r GROUP BY status"))
def count_by_status(s: SparkSession, d: str) -> DataFrame:
    return A.count_by(B.records(s, d), ORDERS, "status")


@query(with_sql("r", "SELECT classification, count(*) AS n FROM r GROUP BY classification"))
def count_by_classification_nulls(s: SparkSession, d: str) -> DataFrame:
    return A.count_by(B.records(s, d), ORDERS, "classification")


@query(with_sql("r", "SELECT recalling_firm, count(*) AS n FROM r GROUP BY recalling_firm ORDER BY n DESC, recalling_firm LIMIT 50"))
def count_by_entity_top(s: SparkSession, d: str) -> DataFrame:
    return A.count_by(B.records(s, d), ORDERS, "recalling_firm")


@query(with_sql("r", f"SELECT classification, count(*) AS n, {ev(NEWEST)} AS evidence FROM r WHERE status = 'F' GROUP BY classification"))
def count_by_with_evidence(s: SparkSession, d: str) -> DataFrame:
    return joined(A.count_by(B.records(s, d), ORDERS, "classification", [Filter("status", "eq", "F")], evidence_n=3))


@query(with_sql("rlt", "SELECT t.node_id, t.label, count(DISTINCT r.id) AS n FROM r JOIN l ON l.record_id = r.id JOIN t ON t.version = l.version AND t.node_id = l.node_id GROUP BY ALL"))
def count_by_taxonomy(s: SparkSession, d: str) -> DataFrame:
    return A.count_by_taxonomy(B.records(s, d), B.labels(s, d), B.taxonomy(s), ORDERS)


@query(with_sql("rlt", "SELECT t.node_id, t.label, count(DISTINCT r.id) AS n FROM r JOIN l ON l.record_id = r.id JOIN t ON t.node_id = l.node_id WHERE t.level = 1 AND r.status = 'P' GROUP BY ALL ORDER BY n DESC, label LIMIT 3"))
def count_by_taxonomy_level(s: SparkSession, d: str) -> DataFrame:
    return A.count_by_taxonomy(B.records(s, d), B.labels(s, d), B.taxonomy(s), ORDERS, [Filter("status", "eq", "P")], level=1, limit=3)


@query(with_sql("rlt", f"SELECT t.node_id, t.label, count(DISTINCT r.id) AS n, {ev(NEWEST, 5)} AS evidence FROM r JOIN l ON l.record_id = r.id JOIN t ON t.node_id = l.node_id GROUP BY ALL"))
def count_by_taxonomy_evidence(s: SparkSession, d: str) -> DataFrame:
    return joined(A.count_by_taxonomy(B.records(s, d), B.labels(s, d), B.taxonomy(s), ORDERS, evidence_n=5))


for _grain in A.GRAINS:
    query(with_sql("r", f"SELECT CAST(date_trunc('{_grain}', report_date) AS DATE) AS period, count(*) AS n FROM r WHERE report_date IS NOT NULL GROUP BY 1"), f"trend_{_grain}")(lambda s, d, g=_grain: A.trend(B.records(s, d), ORDERS, [], g, "report_date"))


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS period, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def trend_events(s: SparkSession, d: str) -> DataFrame:
    events = C.Catalog({"ts": C.Kind.DATE, "event_type": C.Kind.DIMENSION}, key="event_id")
    return A.trend(B.table(s, d, "events"), events, [Filter("event_type", "eq", "error")], "day", "ts")


@query(with_sql("r", "SELECT recall_number, recalling_firm, classification, country FROM r WHERE status = 'F' ORDER BY id LIMIT 25"))
def sample_ordered(s: SparkSession, d: str) -> DataFrame:
    return A.sample(B.records(s, d), ORDERS, [Filter("status", "eq", "F")], None, 25)


@query(with_sql("r", f"SELECT {CLASSES} FROM r WHERE country = 'NATION_1'"))
def class_breakdown(s: SparkSession, d: str) -> DataFrame:
    return A.class_breakdown(B.records(s, d), ORDERS, [Filter("country", "eq", "NATION_1")])


@query(with_sql("r", " UNION ALL ".join(f"(SELECT '{c}' AS column_name, {c} AS value FROM r WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY value LIMIT 60)" for c in ORDERS.indexed)))
def value_index(s: SparkSession, d: str) -> DataFrame:
    return C.value_index(B.records(s, d), ORDERS)


@query(with_sql("r", "SELECT recall_number, recalling_firm, country FROM r WHERE recall_number IN ('1', '17', '4711', '999999999')"))
def point_lookup(s: SparkSession, d: str) -> DataFrame:
    return A.lookup(B.records(s, d), ORDERS, ["1", "17", "4711", "999999999"], ["recalling_firm", "country"])


# -- exposure and parents ----------------------------------------------------------------------------------------------


def _board(order: str, where: str) -> str:
    return with_sql(
        "rlt",
        f""", b AS (SELECT * FROM r WHERE {where}), fc AS (SELECT recalling_firm, {CLASSES}, {ev(SEVERE)} AS evidence FROM b GROUP BY recalling_firm),
        rc AS (SELECT recalling_firm, label, t.node_id, count(DISTINCT b.id) AS n, row_number() OVER (PARTITION BY recalling_firm ORDER BY count(DISTINCT b.id) DESC, label) AS rn
            FROM b JOIN l ON l.record_id = b.id JOIN t ON t.node_id = l.node_id GROUP BY recalling_firm, label, t.node_id)
        SELECT fc.*, label AS top_reason_category, node_id AS top_reason_node_id, n AS top_reason_count, CAST(row_number() OVER (ORDER BY {order}, fc.recalling_firm) AS INTEGER) AS rank
        FROM fc LEFT JOIN rc ON rc.recalling_firm = fc.recalling_firm AND rn = 1 ORDER BY rank LIMIT 20""",
    ).replace(") , b AS", "), b AS")


@query(_board("exposure_score DESC, total_recalls DESC", "status <> 'P'"))
def exposure_by_score(s: SparkSession, d: str) -> DataFrame:
    return joined(A.exposure_leaderboard(B.records(s, d), B.labels(s, d), B.taxonomy(s), ORDERS, [Filter("status", "ne", "P")]))


@query(_board("total_recalls DESC, exposure_score DESC", "true"))
def exposure_by_count(s: SparkSession, d: str) -> DataFrame:
    return joined(A.exposure_leaderboard(B.records(s, d), B.labels(s, d), B.taxonomy(s), ORDERS, rank_by="recall_count"))


@query(with_sql("rlt", """SELECT recalling_firm, label AS top_reason_category, node_id AS top_reason_node_id, n AS top_reason_count FROM (SELECT recalling_firm, label, t.node_id, count(DISTINCT r.id) AS n,
    row_number() OVER (PARTITION BY recalling_firm ORDER BY count(DISTINCT r.id) DESC, label) AS rn FROM r JOIN l ON l.record_id = r.id JOIN t ON t.node_id = l.node_id GROUP BY recalling_firm, label, t.node_id) WHERE rn = 1"""))
def top_reason_per_entity(s: SparkSession, d: str) -> DataFrame:
    return A.top_reason(B.records(s, d), "recalling_firm", B.labels(s, d), B.taxonomy(s), ORDERS)


@query(with_sql("rafepmlt", f""", pc AS (SELECT parent_group_id, parent_group_name, {CLASSES}, count(DISTINCT firm_id) AS member_firm_count, {ev(SEVERE)} AS evidence FROM m GROUP BY ALL),
    rc AS (SELECT parent_group_id, label, t.node_id, count(DISTINCT m.id) AS n, row_number() OVER (PARTITION BY parent_group_id ORDER BY count(DISTINCT m.id) DESC, label) AS rn FROM m JOIN l ON l.record_id = m.id JOIN t ON t.node_id = l.node_id GROUP BY parent_group_id, label, t.node_id)
    SELECT pc.*, label AS top_reason_category, node_id AS top_reason_node_id, n AS top_reason_count, CAST(row_number() OVER (ORDER BY exposure_score DESC, total_recalls DESC, parent_group_name) AS INTEGER) AS rank
    FROM pc LEFT JOIN rc ON rc.parent_group_id = pc.parent_group_id AND rn = 1"""))
def parent_exposure(s: SparkSession, d: str) -> DataFrame:
    t = B.tables(s, d)
    return joined(parents.parent_leaderboard(t.records, t.aliases, t.firms, t.edges, t.parents, t.labels, t.taxonomy, ORDERS))


MEMBERS_SQL = f"""SELECT parent_group_id, parent_group_name, firm_id, firm_name, {CLASSES}, min(provenance_tier) AS provenance_tier, min(source) AS source, min(source_name) AS source_name, min(as_of_date) AS as_of_date, {ev(SEVERE)} AS evidence FROM m GROUP BY ALL"""


def _members(s: SparkSession, d: str) -> DataFrame:
    t = B.tables(s, d)
    return parents.members(t.records, t.aliases, t.firms, t.edges, t.parents, ORDERS)


@query(with_sql("rafepm", MEMBERS_SQL))
def member_exposure_view(s: SparkSession, d: str) -> DataFrame:
    return joined(_members(s, d))


@query(with_sql("rafepm", "SELECT parent_group_id, parent_group_name, count(DISTINCT firm_id) AS member_firm_count, " + CLASSES + " FROM m GROUP BY ALL"))
def parent_exposure_view(s: SparkSession, d: str) -> DataFrame:
    return parents.parent_view(_members(s, d))


@query(with_sql("rafepm", f""", x AS ({MEMBERS_SQL}) SELECT parent_group_id, CAST(to_json(list({{'firm_id': firm_id, 'firm_name': firm_name, 'total_recalls': total_recalls, 'exposure_score': exposure_score}} ORDER BY exposure_score DESC, total_recalls DESC, firm_name)) AS VARCHAR) AS member_breakdown FROM x GROUP BY 1"""))
def parent_members(s: SparkSession, d: str) -> DataFrame:
    return parents.nested_members(_members(s, d))


STATUS_SQL = """, fl AS (SELECT firm_id, bool_or(review_status = 'confirmed' AND provenance_tier <> 'unknown' AND source <> 'llm') AS is_mapped, bool_or(review_status <> 'confirmed') AS is_open,
    bool_or(review_status = 'confirmed' AND provenance_tier = 'unknown') AS is_unknown, bool_or(review_status = 'confirmed' AND source = 'llm') AS is_llm FROM e WHERE active GROUP BY firm_id),
    st AS (SELECT r.id, r.recalling_firm, CASE WHEN a.firm_id IS NULL THEN 'unaliased' WHEN is_mapped THEN 'mapped' WHEN is_open THEN 'unconfirmed_parent_edge' WHEN is_unknown THEN 'unknown_parent_edge'
    WHEN is_llm THEN 'llm_only_parent_edge' WHEN is_mapped IS NOT NULL THEN 'unconfirmed_parent_edge' ELSE 'no_parent_edge' END AS mapping_status FROM r LEFT JOIN a ON a.raw_firm = r.recalling_firm LEFT JOIN fl ON fl.firm_id = a.firm_id)"""


def _status(s: SparkSession, d: str) -> DataFrame:
    return parents.mapping_status(B.records(s, d), B.aliases(s, d), B.edges(s, d), ORDERS)


@query(with_sql("rae", STATUS_SQL + " SELECT mapping_status, count(*) AS n FROM st GROUP BY 1"))
def parent_status_histogram(s: SparkSession, d: str) -> DataFrame:
    return _status(s, d).groupBy("mapping_status").agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("rae", STATUS_SQL + """ SELECT count(*) FILTER (WHERE mapping_status = 'mapped') AS mapped_recalls, count(*) FILTER (WHERE mapping_status <> 'mapped') AS excluded_recalls,
    count(DISTINCT recalling_firm) FILTER (WHERE mapping_status <> 'mapped') AS excluded_raw_firms,
    (SELECT '{' || string_agg('"' || mapping_status || '":' || n, ',' ORDER BY mapping_status) || '}' FROM (SELECT mapping_status, count(*) AS n FROM st GROUP BY 1)) AS status_counts FROM st"""))
def parent_coverage(s: SparkSession, d: str) -> DataFrame:
    return parents.coverage(_status(s, d), "recalling_firm")


@query(with_sql("afe", """SELECT f.id AS firm_id, f.canonical_name AS firm_name, CAST(sum(a.record_count) AS BIGINT) AS records FROM a JOIN f ON f.id = a.firm_id
    WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.firm_id = f.id AND e.active AND e.review_status = 'confirmed') GROUP BY ALL ORDER BY records DESC, firm_name LIMIT 20"""))
def unmapped_top_firms(s: SparkSession, d: str) -> DataFrame:
    return parents.unmapped_firms(B.aliases(s, d), B.firms(s, d), B.edges(s, d))


@query(with_sql("rlt", """, b AS (SELECT * FROM r WHERE recalling_firm = 'Customer#000000007'), x AS (SELECT 'reasons' AS section, label AS value, count(DISTINCT b.id) AS n FROM b JOIN l ON l.record_id = b.id JOIN t ON t.node_id = l.node_id GROUP BY ALL ORDER BY n DESC, value LIMIT 5),
    y AS (SELECT 'products' AS section, segment || '/' || status AS value, count(*) AS n FROM b GROUP BY ALL ORDER BY n DESC, value LIMIT 5) SELECT * FROM x UNION ALL SELECT * FROM y"""))
def multi_section_reasons(s: SparkSession, d: str) -> DataFrame:
    rows = B.records(s, d).withColumn("product", F.concat_ws("/", "segment", "status"))
    return A.reasons_and_products(rows, B.labels(s, d), B.taxonomy(s), ORDERS, [Filter("recalling_firm", "eq", "Customer#000000007")], "product", "status")


@query(with_sql("rlt", f"""SELECT t.node_id, t.label, t.definition, q.label AS parent_label, (SELECT {ev(NEWEST, 5)} FROM (SELECT DISTINCT r.* FROM r JOIN l ON l.record_id = r.id WHERE l.node_id = 'large')) AS evidence
    FROM t JOIN t q ON q.node_id = t.parent_id WHERE t.node_id = 'large'"""))
def explain_node(s: SparkSession, d: str) -> DataFrame:
    return joined(A.explain_node(B.records(s, d), B.labels(s, d), B.taxonomy(s), ORDERS, "large"))


# -- taxonomy and labels -----------------------------------------------------------------------------------------------


@query(with_sql("t", "SELECT node_id, CASE WHEN parent_id IS NULL THEN 0 ELSE 1 END AS depth FROM t WHERE node_id = 'size_class' OR parent_id = 'size_class'"))
def taxonomy_tree(s: SparkSession, d: str) -> DataFrame:
    return T.subtree(B.taxonomy(s), "size_class")


@query(with_sql("rl", "SELECT status, count(*) AS n FROM r WHERE EXISTS (SELECT 1 FROM l WHERE l.record_id = r.id AND l.node_id IN ('small', 'medium', 'large') AND l.confidence >= 0.7) GROUP BY status"))
def subtree_count_by(s: SparkSession, d: str) -> DataFrame:
    return A.count_by(T.with_subtree(B.records(s, d), B.labels(s, d), B.taxonomy(s), "id", "size_class", min_confidence=0.7), ORDERS, "status")


@query(with_sql("rl", """, x AS (SELECT (SELECT count(*) FROM r) AS total_records, count(*) AS label_rows, count(DISTINCT record_id) AS labelled_records FROM l)
    SELECT *, greatest(total_records - labelled_records, 0) AS unlabelled_records, round_even(labelled_records / total_records, 4) AS coverage FROM x"""))
def label_coverage(s: SparkSession, d: str) -> DataFrame:
    return T.coverage(B.records(s, d), B.labels(s, d), "id")


@query(with_sql("lt", "SELECT t.node_id, t.label, count(DISTINCT l.record_id) AS records, count(l.record_id) AS label_rows FROM t LEFT JOIN l ON l.node_id = t.node_id GROUP BY ALL"))
def label_counts_by_node(s: SparkSession, d: str) -> DataFrame:
    return T.node_counts(B.labels(s, d), B.taxonomy(s))


RESIDUAL = "NOT EXISTS (SELECT 1 FROM l WHERE l.record_id = r.id) OR EXISTS (SELECT 1 FROM l WHERE l.record_id = r.id AND l.confidence < 0.7)"


@query(with_sql("rl", f"SELECT status, count(*) AS n FROM r WHERE {RESIDUAL} GROUP BY status"))
def residual_records(s: SparkSession, d: str) -> DataFrame:
    return T.residual(B.records(s, d), B.labels(s, d), "id", "rules").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("rl", f"SELECT country, count(*) AS records, count(*) FILTER (WHERE report_date >= DATE '2001-01-01' - 180) AS recent FROM r WHERE {RESIDUAL} GROUP BY country"))
def residual_growth(s: SparkSession, d: str) -> DataFrame:
    return T.growth(T.residual(B.records(s, d), B.labels(s, d), "id", "rules"), "country", "report_date", F.lit("2001-01-01").cast("date"))


#: Rules over the words of the invented prose.
PROSE_RULES = (T.Rule("contact", 0.9, (r"\b[0-9]{3} [0-9]{3}-[0-9]{4}\b", r"\([0-9]{3}\)")), T.Rule("insult", 0.8, (r"\b(idiot|worthless|clown)\b",)), T.Rule("table", 0.7, (r" \| ",)))
NORM_SQL = "regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '^ | $', '', 'g')"
_RULE_SQL = " UNION ALL ".join(f"SELECT CAST(doc_id AS VARCHAR) AS record_id, '{r.node_id}' AS node_id, CAST({r.confidence} AS DECIMAL(5,4)) AS confidence FROM x WHERE regexp_matches(norm, '{'|'.join(f'(?:{p})' for p in r.patterns)}')" for r in PROSE_RULES)


@query(f"WITH x AS (SELECT doc_id, {NORM_SQL} AS norm FROM documents WHERE trim(text, ' ') <> '') {_RULE_SQL}")
def rule_labels(s: SparkSession, d: str) -> DataFrame:
    return T.rule_labels(B.table(s, d, "documents"), "text", "doc_id", PROSE_RULES).select("record_id", "node_id", "confidence")


@query(f"WITH x AS (SELECT doc_id, {NORM_SQL} AS norm FROM documents WHERE trim(text, ' ') <> ''), y AS ({_RULE_SQL}) SELECT node_id, count(*) AS n FROM y GROUP BY 1")
def rule_label_counts(s: SparkSession, d: str) -> DataFrame:
    return rule_labels(s, d).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(DISTINCT sha256({NORM_SQL})) AS texts, count(*) AS records FROM documents WHERE trim(text, ' ') <> ''")
def text_dedupe_groups(s: SparkSession, d: str) -> DataFrame:
    g = T.distinct_texts(B.table(s, d, "documents"), "text", "doc_id")
    return g.agg(F.count(F.lit(1)).alias("texts"), F.sum("records").alias("records"))


def _products(s: SparkSession, d: str) -> DataFrame:
    """Part names as phrases with a leading colour, one row a part."""
    return B.table(s, d, "part").select(F.concat(F.split("p_name", " ")[0], F.lit(": "), "p_name", F.lit(" "), "p_brand").alias("text"), F.col("p_size").cast("long").alias("w"))


@query("""WITH x AS (SELECT split_part(p_name, ' ', 1) AS prefix, split_part(p_name, ' ', 1) || ': ' || p_name || ' ' || p_brand AS text, p_size FROM part),
    g AS (SELECT prefix, count(*) AS texts, CAST(sum(p_size) AS BIGINT) AS records FROM x GROUP BY 1 HAVING count(*) >= 5 ORDER BY texts DESC, prefix LIMIT 50)
    SELECT g.*, (SELECT array_to_string(list_slice(array_agg(text ORDER BY text), 1, 5), '|') FROM x WHERE x.prefix = g.prefix) AS examples FROM g""")
def prefix_mining(s: SparkSession, d: str) -> DataFrame:
    return T.mine_prefixes(_products(s, d), "text", "w", 5).withColumn("examples", F.array_join("examples", "|"))


@query("""WITH x AS (SELECT split_part(p_name, ' ', 1) AS prefix, sha256(lower(split_part(p_name, ' ', 1) || ': ' || p_name || ' ' || p_brand)) AS h, p_size FROM part)
    SELECT prefix, count(*) AS texts, CAST(sum(p_size) AS BIGINT) AS records, substr(sha256('prefix:' || array_to_string(list_slice(array_agg(h ORDER BY h), 1, 50), '|')), 1, 16) AS cluster_key, CAST(1.0 AS DOUBLE) AS coherence
    FROM x GROUP BY 1 HAVING count(*) >= 10 ORDER BY texts DESC, prefix LIMIT 24""")
def prefix_clusters(s: SparkSession, d: str) -> DataFrame:
    return T.prefix_clusters(_products(s, d), "text", "w")


@query(with_sql("lt", "SELECT node_id, label FROM t WHERE EXISTS (SELECT 1 FROM l WHERE l.node_id = t.node_id)"))
def labelled_nodes(s: SparkSession, d: str) -> DataFrame:
    return T.labelled_nodes(B.labels(s, d), B.taxonomy(s)).select("node_id", "label")


@query("""WITH c AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS node_id FROM part), x AS (SELECT node_id, CASE WHEN regexp_matches(node_id, '^(red|blue|green)$') THEN 'colour' WHEN regexp_matches(node_id, '^(hot|cold)$') THEN 'warmth' ELSE 'other' END AS parent_id FROM c)
    SELECT node_id, parent_id, 1 AS level FROM x UNION ALL SELECT DISTINCT parent_id, NULL, 0 FROM x""")
def taxonomy_draft(s: SparkSession, d: str) -> DataFrame:
    themes = [("colour", "^(red|blue|green)$"), ("warmth", "^(hot|cold)$")]
    return T.drafted(T.mine_prefixes(_products(s, d), "text", "w"), themes).select("node_id", "parent_id", "level")


@query("SELECT node_id, count(*) AS n FROM (SELECT CASE WHEN contains(lower(p_name), 'blue widget') THEN 'bw' WHEN contains(lower(p_name), 'widget') THEN 'w' WHEN contains(lower(p_name), 'cold') THEN 'c' END AS node_id FROM part) WHERE node_id IS NOT NULL GROUP BY 1")
def draft_match(s: SparkSession, d: str) -> DataFrame:
    terms = [("Blue widget", "bw"), ("widget", "w"), ("cold", "c")]
    return T.match_terms(B.table(s, d, "part"), "p_name", "p_partkey", terms).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT split_part(p_name, ' ', 1) AS prefix, sha256(lower(split_part(p_name, ' ', 1) || ': ' || p_name || ' ' || p_brand)) AS h, p_size FROM part)
    SELECT prefix AS candidate_node_id, upper(substr(prefix, 1, 1)) || substr(prefix, 2) AS proposed_label, CAST(sum(p_size) AS BIGINT) AS size, substr(sha256('prefix:' || array_to_string(list_slice(array_agg(h ORDER BY h), 1, 50), '|')), 1, 16) AS cluster_key
    FROM x WHERE prefix NOT IN ('small', 'medium', 'large', 'economy', 'standard', 'promo') GROUP BY prefix HAVING count(*) >= 10 ORDER BY size DESC, prefix LIMIT 20""")
def taxonomy_candidates(s: SparkSession, d: str) -> DataFrame:
    found = T.candidate_nodes(T.prefix_clusters(_products(s, d), "text", "w"), B.taxonomy(s))
    return found.select("candidate_node_id", "proposed_label", "size", "cluster_key")


@query(with_sql("l", "SELECT node_id, labeler, count(*) AS n FROM (SELECT node_id, CASE WHEN record_id % 2 = 0 THEN 'other' ELSE 'rules' END AS labeler FROM l WHERE record_id % 2 = 0 UNION ALL SELECT 'promo', 'rules' FROM orders) GROUP BY ALL"))
def labels_replaced(s: SparkSession, d: str) -> DataFrame:
    old = B.labels(s, d).withColumn("labeler", F.when(F.col("record_id") % 2 == 0, "other").otherwise("rules"))
    new = B.table(s, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.lit("v1").alias("version"), F.lit("promo").alias("node_id"), F.lit("rules").alias("labeler"))
    return T.replaced(old, new, "rules").groupBy("node_id", "labeler").agg(F.count(F.lit(1)).alias("n"))


@query()
def kmeans_clusters(s: SparkSession, d: str) -> DataFrame:
    return T.vector_clusters(B.table(s, d, "embeddings"), "vec_id", "embedding").withColumn("members", F.array_join("members", ","))


# -- ingest ------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, 'sha1:' || sha1(replace(props, ' ', '')) AS id FROM events")
def json_projection(s: SparkSession, d: str) -> DataFrame:
    e = B.table(s, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), text.record_id(F.lit(None).cast("string"), F.col("props")).alias("id"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(ts AS DATE) END AS compact, CASE WHEN event_id % 4 < 2 THEN CAST(ts AS DATE) END AS lenient FROM events""")
def date_parsers(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    written = F.when(k == 0, F.date_format("ts", "yyyyMMdd")).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH")).when(k == 2, F.lit("20230230")).otherwise(F.lit("soon"))
    rows = B.table(s, d, "events").withColumn("t", written)
    return rows.select("event_id", text.compact_date(F.col("t")).alias("compact"), text.ingest_date(F.col("t")).alias("lenient"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS top FROM events GROUP BY 1")
def json_typed_agg(s: SparkSession, d: str) -> DataFrame:
    e = B.table(s, d, "events").withColumn("r", F.from_json("props", "k long"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("r.k").alias("total"), F.max("r.k").alias("top"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_last_write_wins(s: SparkSession, d: str) -> DataFrame:
    e = B.table(s, d, "events").select("user_id", "event_id", "event_type", "ts")
    return ingest.latest(e, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT CAST(max(ts) AS DATE) AS high_water FROM events")
def incremental_high_water(s: SparkSession, d: str) -> DataFrame:
    return ingest.high_water(B.table(s, d, "events").withColumn("day", F.col("ts").cast("date")), "day")


@query("SELECT CAST(doc_id AS VARCHAR) AS source_id, md5(text) AS content_hash FROM documents WHERE length(trim(text, ' ')) > 0 AND (doc_id % 3 = 0 OR doc_id % 5 = 0)")
def pending_changed(s: SparkSession, d: str) -> DataFrame:
    docs = B.table(s, d, "documents")
    texts = ingest.text_registry({"documents": docs}, {"documents": ("doc_id", ["text"])})
    # an index that lacks some texts and holds others as they once were
    old = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("text"))
    index = docs.where("doc_id % 3 <> 0").select(F.lit("documents").alias("source"), F.col("doc_id").cast("string").alias("source_id"), F.lit("text").alias("field"), text.content_hash(old).alias("content_hash"))
    return ingest.pending(texts, index).select("source_id", "content_hash")


@query("SELECT change, count(*) AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN 'insert' WHEN doc_id % 11 = 0 THEN 'delete' WHEN doc_id % 13 = 0 THEN 'update' ELSE 'unchanged' END AS change FROM documents) GROUP BY 1")
def planned_changes(s: SparkSession, d: str) -> DataFrame:
    docs = B.table(s, d, "documents").select("doc_id", "lang")
    after = docs.where("doc_id % 7 = 0 OR doc_id % 11 <> 0").withColumn("lang", F.when((F.col("doc_id") % 7 != 0) & (F.col("doc_id") % 13 == 0), "xx").otherwise(F.col("lang")))
    return ingest.planned(docs.where("doc_id % 7 <> 0"), after, ["doc_id"])


@query("SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_linenumber, l_suppkey) AS rn FROM lineitem) WHERE rn = 1")
def distinct_on_best(s: SparkSession, d: str) -> DataFrame:
    rows = B.table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber", "l_suppkey")
    return ingest.newest_per_key(rows, "l_orderkey", [F.col("l_quantity").desc(), F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")]).select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT CAST(ts AS DATE) AS period, event_type, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 GROUP BY ALL")
def stream_upsert_trend(s: SparkSession, d: str) -> DataFrame:
    """Events as a stream that is merged into one row a user, and a trend of what is left."""
    columns = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    stream = s.readStream.schema(columns).parquet(f"{d}/events.parquet*").select(F.col("user_id").alias("id"), "event_type", F.struct("ts", "event_id").alias("fetched_at"))
    path = shared_path(s, "stream")
    updates.upsert_stream(stream, f"{path}/table", f"{path}/log").awaitTermination()
    rows = updates.current(s, f"{path}/table").withColumn("ts", F.col("fetched_at.ts"))
    return updates.windowed_counts(rows, "ts", "event_type")


# -- retrieval ---------------------------------------------------------------------------------------------------------

WORDS = ["with", "idiot"]
_DOT = "list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_NORM = "sqrt(list_inner_product(CAST({0}.embedding AS DOUBLE[]), CAST({0}.embedding AS DOUBLE[])))"
VECTORS = f"v AS (SELECT e.vec_id, e.label, 1 - {_DOT} / ({_NORM.format('e')} * {_NORM.format('q')}) AS dist FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
BAG = "b AS (SELECT doc_id, source, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w IN ('with', 'idiot'))) AS score FROM documents)"


def _query_vector(s: SparkSession, d: str) -> list[float]:
    row = B.table(s, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]]


def _five(dist: Column) -> Column:
    """Rounded to five places as the SQL does it: the scaled double half away from zero, signed zeros kept."""
    scaled = dist * 1e5
    whole = F.floor(F.abs(scaled)).cast("double")
    away = F.signum(scaled) * (whole + F.when(F.abs(scaled) - whole >= 0.5, 1.0).otherwise(0.0)) / 1e5
    return F.when(F.isnan(dist), dist).otherwise(away)


def _index(s: SparkSession, d: str) -> DataFrame:
    return B.table(s, d, "embeddings").select(F.col("vec_id").alias("source_id"), F.lit("text").alias("field"), "embedding", "label")


@query(f"WITH {VECTORS} SELECT vec_id AS source_id, round(dist, 5) AS dist, CAST(row_number() OVER (ORDER BY dist, vec_id) AS INTEGER) AS rank FROM v ORDER BY dist, vec_id LIMIT 20")
def vector_topk(s: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_candidates(_index(s, d), _query_vector(s, d), 20, "text", _five).select("source_id", _five(F.col("dist")).alias("dist"), "rank")


@query(f"WITH {VECTORS} SELECT vec_id AS source_id, round(dist, 5) AS dist, CAST(row_number() OVER (ORDER BY dist, vec_id) AS INTEGER) AS rank FROM v JOIN documents ON doc_id = vec_id WHERE lang = 'en' ORDER BY dist, vec_id LIMIT 20")
def vector_topk_filtered(s: SparkSession, d: str) -> DataFrame:
    docs = B.table(s, d, "documents").withColumnRenamed("doc_id", "recall_number")
    rows = retrieval.hard_filtered(_index(s, d), docs, C.Catalog({"lang": C.Kind.DIMENSION}), [Filter("lang", "eq", "en")])
    return retrieval.vector_candidates(rows, _query_vector(s, d), 20, "text", _five).select("source_id", _five(F.col("dist")).alias("dist"), "rank")


@query(f"WITH {VECTORS} SELECT label AS source_id, round(min(dist), 5) AS dist FROM v GROUP BY 1")
def vector_best_per_record(s: SparkSession, d: str) -> DataFrame:
    rows = _index(s, d).select(F.col("label").alias("source_id"), F.col("source_id").cast("string").alias("field"), "embedding")
    return retrieval.vector_candidates(rows, _query_vector(s, d), 50, "both").select("source_id", F.round("dist", 5).alias("dist"))


@query(f"WITH {BAG} SELECT count(*) AS n FROM b WHERE score > 0")
def text_match_count(s: SparkSession, d: str) -> DataFrame:
    return B.table(s, d, "documents").where(fulltext.bag_search("text", WORDS) > 0).agg(F.count(F.lit(1)).alias("n"))


def _bag(s: SparkSession, d: str, where: str = "true") -> DataFrame:
    docs = B.table(s, d, "documents").where(where)
    rows = docs.select(F.col("doc_id").alias("source_id"), F.lit("text").alias("field"), fulltext.bag_search("text", WORDS).cast("double").alias("score"), F.lit(1.0).alias("dist")).where("score > 0")
    return retrieval._ranked(rows, [F.col("score").desc(), F.col("source_id")], 50)


@query(f"WITH {BAG} SELECT doc_id AS source_id, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM b WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50")
def text_topk_bag(s: SparkSession, d: str) -> DataFrame:
    return _bag(s, d).select("source_id", "score", "rank")


def _rrf(where: str) -> str:
    return f"""WITH {VECTORS}, {BAG}, vr AS (SELECT vec_id AS id, row_number() OVER (ORDER BY dist, vec_id) AS rk FROM v {"JOIN documents ON doc_id = vec_id WHERE " + where if where else ""} ORDER BY rk LIMIT 50),
    tr AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rk FROM b {"JOIN documents USING (doc_id)" if where else ""} WHERE score > 0 {"AND " + where if where else ""} ORDER BY rk LIMIT 50),
    u AS (SELECT id, rk, 0 AS t FROM vr UNION ALL SELECT id, rk, 1 FROM tr)
    SELECT id AS source_id, round(sum(1.0 / (60 + rk)), 9) AS score, CAST(min(rk) FILTER (WHERE t = 0) AS INTEGER) AS vector_rank, CAST(min(rk) FILTER (WHERE t = 1) AS INTEGER) AS text_rank FROM u GROUP BY id"""


def _fused(v: DataFrame, t: DataFrame) -> DataFrame:
    return retrieval.fuse(v, t, 1000).select("source_id", F.round("score", 9).alias("score"), "vector_rank", "text_rank")


@query(_rrf(""))
def hybrid_rrf(s: SparkSession, d: str) -> DataFrame:
    return _fused(retrieval.vector_candidates(_index(s, d), _query_vector(s, d), 50, "text"), _bag(s, d))


@query(_rrf("lang = 'en'"))
def hybrid_rrf_filtered(s: SparkSession, d: str) -> DataFrame:
    docs = B.table(s, d, "documents").withColumnRenamed("doc_id", "recall_number")
    rows = retrieval.hard_filtered(_index(s, d), docs, C.Catalog({"lang": C.Kind.DIMENSION}), [Filter("lang", "eq", "en")])
    return _fused(retrieval.vector_candidates(rows, _query_vector(s, d), 50, "text"), _bag(s, d, "lang = 'en'"))


def _text_index(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = B.table(s, d, "documents").select(F.col("doc_id").alias("source_id"), F.lit("text").alias("field"), "text", F.lit(None).cast("array<float>").alias("embedding"))
    return docs, fulltext.positions(docs, ["source_id", "field"], "text")


@query()
def fts_only_fallback(s: SparkSession, d: str) -> DataFrame:
    index, postings = _text_index(s, d)

    def down(_: str) -> list[float]:
        raise retrieval.provider_error("unavailable")

    first = B.table(s, d, "documents").orderBy("doc_id").first().text.split()[:3]
    return retrieval.search(index, postings, " ".join(first), 10, down, types="source_id long, field string").hits


@query()
def text_cover_density(s: SparkSession, d: str) -> DataFrame:
    index, postings = _text_index(s, d)
    return fulltext.search(postings, ["source_id", "field"], "erer OR thion OR edly", "source_id long, field string")


# -- semantic counts ---------------------------------------------------------------------------------------------------


def _pool(s: SparkSession, d: str) -> DataFrame:
    docs = B.table(s, d, "documents").select(F.col("doc_id").alias("source_id"), F.lit("text").alias("field"), F.col("text").alias("content"), "source")
    scored = docs.withColumn("retrieval_score", F.size(F.filter(text.tokens(F.col("content")), lambda w: w.isin(WORDS))).cast("double"))
    top = scored.where("retrieval_score > 0").orderBy(F.col("retrieval_score").desc(), "source_id").limit(200)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("retrieval_score").desc(), "source_id")))


POOL = f"{BAG}, p AS (SELECT doc_id, source, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rk FROM b WHERE score > 0 ORDER BY rk LIMIT 200), k AS (SELECT count(*) AS n FROM p)"
CHOSEN = "c AS (SELECT DISTINCT CAST(round_even(i * (n - 1) / 39.0, 0) AS BIGINT) + 1 AS rk FROM k, range(40) t(i) WHERE n > 40 UNION SELECT rk FROM p, k WHERE n <= 40)"


@query(f"WITH {POOL}, {CHOSEN} SELECT doc_id AS source_id, rk AS place FROM p JOIN c USING (rk)")
def stratified_sample(s: SparkSession, d: str) -> DataFrame:
    pool = _pool(s, d)
    return stats.stratified(pool, "rank", pool.count(), 40).select("source_id", F.col("rank").cast("long").alias("place"))


def _judge(s: SparkSession, d: str) -> Callable[[DataFrame], DataFrame]:
    """Judgements of the label table: toxic texts match; unlabelled ones don't."""
    marks = B.table(s, d, "labels").groupBy(F.col("doc_id").alias("source_id")).agg(F.max("toxic").alias("toxic"))
    return lambda rows: rows.join(marks, "source_id", "left").select("source_id", "field", (F.coalesce("toxic", F.lit(0)) == 1).alias("is_match"), F.lit(0.9).alias("confidence"), F.substring("content", 1, 40).alias("snippet"))


JUDGED = f"{POOL}, {CHOSEN}, j AS (SELECT p.doc_id, p.source, p.rk, coalesce((SELECT max(toxic) FROM labels WHERE labels.doc_id = p.doc_id), 0) = 1 AS ok FROM p JOIN c USING (rk))"


@query(f"WITH {JUDGED}, w AS (SELECT count(*) FILTER (WHERE ok) AS verified_count, count(*) AS validated_count, (SELECT n FROM k) AS candidate_count FROM j) SELECT *, validated_count - verified_count AS rejected_count, CAST(round_even(verified_count / validated_count * candidate_count, 0) AS BIGINT) AS estimated_count FROM w")
def semantic_estimate(s: SparkSession, d: str) -> DataFrame:
    judged, n = semantic.validated(_pool(s, d), _judge(s, d))
    return semantic.estimate(judged, n).select("verified_count", "validated_count", "candidate_count", "rejected_count", "estimated_count")


@query(f"""WITH {JUDGED}, w AS (SELECT CAST(round_even(count(*) FILTER (WHERE ok) / count(*) * (SELECT n FROM k), 0) AS BIGINT) AS total FROM j), g AS (SELECT source, count(*) AS pool_count FROM p GROUP BY 1),
    x AS (SELECT *, CAST(pool_count AS DOUBLE) / (SELECT n FROM k) * (SELECT total FROM w) AS raw FROM g), y AS (SELECT *, floor(raw) AS fl FROM x), z AS (SELECT *, row_number() OVER (ORDER BY raw - fl DESC, source) AS place, (SELECT total FROM w) - sum(fl) OVER () AS rest FROM y)
    SELECT source, pool_count, CAST(fl + CASE WHEN place <= rest THEN 1 ELSE 0 END AS BIGINT) AS allocated, coalesce((SELECT array_to_string(list_slice(array_agg(CAST(doc_id AS VARCHAR) ORDER BY rk), 1, 3), ',') FROM j WHERE ok AND j.source = z.source), '') AS evidence FROM z""")
def semantic_groups(s: SparkSession, d: str) -> DataFrame:
    pool = _pool(s, d)
    judged, n = semantic.validated(pool.drop("source"), _judge(s, d))
    total = semantic.estimate(judged, n).first().estimated_count
    values = pool.select("source_id", "source")
    return joined(semantic.grouped_estimate(pool.drop("source"), judged, values, "source", total).withColumn("evidence", F.transform("evidence", lambda x: x.cast("string"))))


@query("""WITH x AS (SELECT CAST(event_id % 50 AS DOUBLE) AS s, 50.0::DOUBLE AS n, CAST(100 + event_id AS DOUBLE) AS big, event_id FROM events),
    y AS (SELECT *, s / n AS p, 1 + 3.8416 / n AS den FROM x), z AS (SELECT *, (p + 3.8416 / (2 * n)) / den AS c, 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n) / den AS m FROM y)
    SELECT event_id, CAST(greatest(0, round_even((c - m) * big, 0)) AS BIGINT) AS lower, CAST(least(big, round_even((c + m) * big, 0)) AS BIGINT) AS upper FROM z""")
def wilson_interval(s: SparkSession, d: str) -> DataFrame:
    low, high = stats.wilson_counts(F.col("event_id") % 50, F.lit(50), F.col("event_id") + 100)
    return B.table(s, d, "events").select("event_id", low.alias("lower"), high.alias("upper"))


@query("""WITH g AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), x AS (SELECT *, CAST(n AS DOUBLE) / (SELECT sum(n) FROM g) * 777 AS raw FROM g), y AS (SELECT *, floor(raw) AS fl FROM x),
    z AS (SELECT *, row_number() OVER (ORDER BY raw - fl DESC, event_type) AS place, 777 - sum(fl) OVER () AS rest FROM y) SELECT event_type, n, CAST(fl + CASE WHEN place <= rest THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM z""")
def group_allocation(s: SparkSession, d: str) -> DataFrame:
    return stats.allocate(B.table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "event_type", "n", 777)


# -- entities ----------------------------------------------------------------------------------------------------------

GRAMS = "list_distinct(flatten(list_transform(string_split({0}, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', CAST(i AS BIGINT), 3)))))"


def _part_names(s: SparkSession, d: str) -> DataFrame:
    return B.table(s, d, "part").select("p_name").distinct()


@query("SELECT DISTINCT p_name, upper(p_name) || ' Laboratories, L.L.C.' AS raw, p_name || ' labs' AS normalized, array_to_string(list_sort(string_split(p_name || ' labs', ' ')), ' ') AS token_key FROM part")
def name_normalize(s: SparkSession, d: str) -> DataFrame:
    rows = _part_names(s, d).withColumn("raw", F.concat(F.upper("p_name"), F.lit(" Laboratories, L.L.C.")))
    return rows.select("p_name", "raw", N.normalize_name(N.ascii_fold(F.col("raw"))).alias("normalized")).withColumn("token_key", N.token_key(F.col("normalized")))


PAIRS = "n AS (SELECT DISTINCT p_name AS name FROM part), q AS (SELECT x.name AS a, y.name AS b FROM n x JOIN n y ON x.name < y.name)"


def _name_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs of names that share a word or trigram."""
    grams = _part_names(s, d).select(F.col("p_name").alias("a"), F.explode(text.trigrams(F.col("p_name"))).alias("g"))
    return grams.join(grams.withColumnRenamed("a", "b"), "g").where("a < b").select("a", "b").distinct()


@query(f"WITH {PAIRS} SELECT a, b, round(len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))), 6) AS jaccard FROM q WHERE len(list_intersect(string_split(a, ' '), string_split(b, ' '))) > 0")
def token_jaccard_pairs(s: SparkSession, d: str) -> DataFrame:
    return _name_pairs(s, d).select("a", "b", F.round(N.token_jaccard(F.col("a"), F.col("b")), 6).alias("jaccard")).where("jaccard > 0")


_SIM = f"len(list_intersect({GRAMS.format('a')}, {GRAMS.format('b')})) / len(list_distinct(list_concat({GRAMS.format('a')}, {GRAMS.format('b')})))"


@query(f"WITH {PAIRS} SELECT a, b, round({_SIM}, 6) AS similarity FROM q WHERE {_SIM} >= 0.3")
def trigram_pairs(s: SparkSession, d: str) -> DataFrame:
    return _name_pairs(s, d).select("a", "b", N.similarity(F.col("a"), F.col("b")).alias("similarity")).where("similarity >= 0.3").withColumn("similarity", F.round("similarity", 6))


@query()
def word_similarity_pairs(s: SparkSession, d: str) -> DataFrame:
    return _name_pairs(s, d).select("a", "b", N.word_similarity(F.col("a"), F.col("b")).alias("word_similarity")).where("word_similarity >= 0.6")


@query()
def phonetic_pairs(s: SparkSession, d: str) -> DataFrame:
    rows = _part_names(s, d).select("p_name", N.metaphone("p_name").alias("sound"))
    return rows.groupBy("sound").agg(F.count(F.lit(1)).alias("n"), F.min("p_name").alias("first"))


def _suppliers(s: SparkSession, d: str) -> DataFrame:
    """Names of parts as firms, some with US, some with foreign legal forms, one row an occurrence."""
    p = B.table(s, d, "part")
    form = F.when(F.col("p_partkey") % 4 == 0, " Inc").when(F.col("p_partkey") % 4 == 1, " LLC").when(F.col("p_partkey") % 4 == 2, " Ltd").otherwise("")
    return p.select(F.concat(F.initcap("p_name"), form).alias("firm"))


def _decided(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    names = entities.load_names(_suppliers(s, d), "firm")
    return names, entities.decide(entities.candidate_pairs(names))


@query()
def candidate_pairs(s: SparkSession, d: str) -> DataFrame:
    return _decided(s, d)[1].select("l_raw", "r_raw", "decision", "decision_reason", F.bround("score", 5).alias("score"), F.bround("confidence", 5).alias("confidence"))


@query()
def resolution_summary(s: SparkSession, d: str) -> DataFrame:
    return entities.run_summary(_decided(s, d)[1], "full")


@query()
def resolved_firms(s: SparkSession, d: str) -> DataFrame:
    names, decided = _decided(s, d)
    return entities.clusters(names, decided).select("raw", "cluster", "canonical", "record_count", F.bround("confidence", 5).alias("confidence"))


@query()
def connected_links(s: SparkSession, d: str) -> DataFrame:
    """Components of all links of parts and suppliers; a test holds them against union-find, as recursive SQL doesn't bear so many."""
    return entities.smallest_reachable(B.table(s, d, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 100_000_000_000).alias("b")).distinct())


@query(with_sql("r", f"SELECT recalling_firm, count(*) AS n, {ev(NEWEST, 5)} AS evidence, CAST(0.65 AS DOUBLE) AS confidence FROM r WHERE segment ILIKE '%mach%' GROUP BY 1"))
def brand_candidates(s: SparkSession, d: str) -> DataFrame:
    return joined(entities.brand_candidates(B.records(s, d), "mach", "segment", "recalling_firm", "recall_number", "recall_initiation_date").withColumn("confidence", F.col("confidence").cast("double")))


@query()
def brand_matches(s: SparkSession, d: str) -> DataFrame:
    names = B.table(s, d, "part").select(F.concat("p_name", F.lit("s")).alias("brand")).distinct()
    table = lambda where: B.table(s, d, "part").where(where).select("p_name").distinct().select(F.xxhash64("p_name").alias("id"), F.col("p_name").alias("normalized_name"))
    known = names.where("brand LIKE 'red%'").select(F.col("brand").alias("normalized_brand_name"), F.lit(7).cast("long").alias("firm_id"), F.lit(None).cast("long").alias("parent_group_id"), F.lit("fda_fact").alias("provenance_tier"), F.lit(1.0).alias("confidence"))
    return entities.brand_matches(names, table("p_name LIKE 'cold%'"), table("p_name LIKE 'hot%'"), known, 0.7)


@query(with_sql("afe", """, u AS (SELECT f.id AS firm_id, f.canonical_name AS firm_name, CAST(sum(a.record_count) AS BIGINT) AS records FROM a JOIN f ON f.id = a.firm_id
    WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.firm_id = f.id AND e.active AND e.review_status = 'confirmed') GROUP BY ALL ORDER BY records DESC, firm_name LIMIT 20)
    SELECT firm_id, 'unknown' AS provenance_tier, 'unknown' AS source, DATE '2002-01-01' AS as_of_date, 'confirmed' AS review_status, true AS active, CAST(0 AS DECIMAL(5,4)) AS confidence FROM u"""))
def unknown_placeholders(s: SparkSession, d: str) -> DataFrame:
    return parents.placeholders(parents.unmapped_firms(B.aliases(s, d), B.firms(s, d), B.edges(s, d)), F.lit("2002-01-01")).drop("parent_group_id")


@query(with_sql("e", """, n AS (SELECT firm_id, (parent_group_id + firm_id % 2) % 5 AS parent_group_id, 'external' AS provenance_tier, 'external' AS source, source_id, CASE WHEN firm_id % 2 = 0 THEN as_of_date ELSE DATE '2002-01-01' END AS as_of_date FROM e WHERE firm_id % 10 IN (0, 1, 6)),
    x AS (SELECT e.firm_id, e.parent_group_id, e.provenance_tier, e.source, e.source_id, e.as_of_date, CASE WHEN n.firm_id IS NULL THEN e.review_status WHEN n.parent_group_id = e.parent_group_id AND n.as_of_date = e.as_of_date THEN 'confirmed' WHEN e.review_status = 'confirmed' THEN 'superseded' ELSE e.review_status END AS review_status,
        CASE WHEN n.firm_id IS NULL THEN e.active WHEN n.parent_group_id = e.parent_group_id AND n.as_of_date = e.as_of_date THEN true WHEN e.review_status = 'confirmed' THEN false ELSE e.active END AS active,
        CAST(CASE WHEN n.parent_group_id = e.parent_group_id AND n.as_of_date = e.as_of_date THEN greatest(e.confidence, 0.95) ELSE e.confidence END AS DECIMAL(5,4)) AS confidence FROM e LEFT JOIN n ON n.firm_id = e.firm_id)
    SELECT * FROM x UNION ALL SELECT n.firm_id, n.parent_group_id, n.provenance_tier, n.source, n.source_id, n.as_of_date, 'confirmed', true, CAST(0.95 AS DECIMAL(5,4)) FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.firm_id = n.firm_id AND e.parent_group_id = n.parent_group_id AND e.as_of_date = n.as_of_date)"""))
def edge_supersede(s: SparkSession, d: str) -> DataFrame:
    e = B.edges(s, d)
    odd = F.col("firm_id") % 2 != 0
    new = e.where("firm_id % 10 IN (0, 1, 6)").select(
        "firm_id", F.when(odd, (F.col("parent_group_id") + 1) % 5).otherwise(F.col("parent_group_id") % 5).alias("parent_group_id"), F.lit("external").alias("provenance_tier"), F.lit("external").alias("source"), "source_id",
        F.when(odd, F.lit("2002-01-01").cast("date")).otherwise(F.col("as_of_date")).alias("as_of_date"), F.lit(0.95).cast("decimal(5,4)").alias("confidence"),
    )
    return parents.write_edges(e, new)


# -- audit and evaluation ----------------------------------------------------------------------------------------------


@query("SELECT count(*) AS rows, count(DISTINCT o_custkey) AS distinct_o_custkey, count(DISTINCT o_orderstatus) AS distinct_o_orderstatus, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders")
def multi_distinct(s: SparkSession, d: str) -> DataFrame:
    return evaluation.column_stats(B.table(s, d, "orders"), ["o_custkey", "o_orderstatus"], "o_orderdate")


@query()
def fingerprint_rows(s: SparkSession, d: str) -> DataFrame:
    return evaluation.fingerprint(B.table(s, d, "orders"), "o_orderkey")


@query(f"""WITH {VECTORS}, g AS (SELECT vec_id, row_number() OVER (ORDER BY dist, vec_id) AS rk, label FROM v), w AS (SELECT label FROM embeddings WHERE vec_id = 0), x AS (SELECT vec_id FROM embeddings, w WHERE embeddings.label = w.label),
    h AS (SELECT rk FROM g JOIN x USING (vec_id) WHERE rk <= 10), n AS (SELECT count(*) AS n FROM x) SELECT 'first' AS case_id, round((SELECT count(*) FROM h) / n, 6) AS recall_at_k, round(coalesce(1.0 / (SELECT min(rk) FROM h), 0), 6) AS mrr_at_k,
    round(coalesce((SELECT sum(1 / log2(rk + 1)) FROM h), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n), 6) AS ndcg_at_k FROM n""")
def retrieval_metrics(s: SparkSession, d: str) -> DataFrame:
    vectors = B.table(s, d, "embeddings")
    label = vectors.where("vec_id = 0").first().label
    found = retrieval.vector_candidates(_index(s, d), _query_vector(s, d), 10, "text").select(F.lit("first").alias("case_id"), F.col("source_id").alias("id"), "rank")
    goal = vectors.where(F.col("label") == label).select(F.lit("first").alias("case_id"), F.col("vec_id").alias("id"))
    out = evaluation.retrieval_metrics(found, goal)
    return out.select("case_id", *[F.round(c, 6).alias(c) for c in ("recall_at_k", "mrr_at_k", "ndcg_at_k")])


def _run(s: SparkSession, d: str, shift: int) -> DataFrame:
    e = B.table(s, d, "events").where(f"event_id % 17 <> {shift}")
    return e.select(F.col("event_id").alias("case_id"), F.when(F.col("event_id") % 2 == 0, "core").otherwise("rag").alias("suite"), F.when((F.col("event_id") + shift) % 5 == 0, "fail").otherwise("pass").alias("status"), (F.col("event_id") * (10 + 40 * shift)).cast("long").alias("latency_ms"), F.lit(1.0).alias("recall"))


@query("""WITH a AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'fail' ELSE 'pass' END AS st, event_id * 10 AS ms FROM events WHERE event_id % 17 <> 0),
    b AS (SELECT event_id AS id, CASE WHEN (event_id + 1) % 5 = 0 THEN 'fail' ELSE 'pass' END AS st, event_id * 50 AS ms FROM events WHERE event_id % 17 <> 1)
    SELECT coalesce(a.id, b.id) AS case_id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN (a.st = 'pass' AND b.st <> 'pass') OR b.ms > a.ms + CASE WHEN a.id % 2 = 0 THEN 500 ELSE 2000 END THEN 'regressed'
    WHEN a.st <> 'pass' AND b.st = 'pass' OR b.ms < a.ms - CASE WHEN a.id % 2 = 0 THEN 500 ELSE 2000 END THEN 'improved' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.id = b.id""")
def baseline_compare(s: SparkSession, d: str) -> DataFrame:
    return evaluation.compare_runs(_run(s, d, 0), _run(s, d, 1))


@query("""WITH x AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'fail' WHEN 1 THEN 'skip' ELSE 'pass' END AS st, CASE WHEN event_id % 3 = 0 THEN ['core', 'rag'] ELSE ['rag'] END AS suites FROM events),
    y AS (SELECT st, unnest(list_append(suites, 'all')) AS suite FROM x), z AS (SELECT suite, count(*) FILTER (WHERE st = 'pass') AS passed, count(*) FILTER (WHERE st = 'fail') AS failed, count(*) FILTER (WHERE st = 'skip') AS skipped FROM y GROUP BY 1)
    SELECT *, passed / (passed + failed) AS pass_rate FROM z""")
def report_roll_up(s: SparkSession, d: str) -> DataFrame:
    return evaluation.roll_up(_results(s, d))


def _results(s: SparkSession, d: str) -> DataFrame:
    e, k = B.table(s, d, "events"), F.col("event_id")
    suites = F.when(k % 3 == 0, F.array(F.lit("core"), F.lit("rag"))).otherwise(F.array(F.lit("rag")))
    return e.select(k.cast("string").alias("case_id"), F.when(k % 4 == 0, "fail").when(k % 4 == 1, "skip").otherwise("pass").alias("status"), suites.alias("suites"))


@query("SELECT CAST(event_id AS VARCHAR) AS case_id, CASE event_id % 4 WHEN 0 THEN 'failed' ELSE 'skipped' END AS problem FROM events WHERE event_id % 3 = 0 AND event_id % 4 IN (0, 1) AND event_id NOT IN (9, 21)")
def core_gate(s: SparkSession, d: str) -> DataFrame:
    return evaluation.gate(_results(s, d), ["9", "21"])


@query(with_sql("e", "SELECT parent_group_id, array_to_string(list(DISTINCT source_name ORDER BY source_name), ',') AS edge_evidence FROM e WHERE active AND review_status = 'confirmed' AND provenance_tier <> 'unknown' AND source <> 'llm' GROUP BY 1"))
def edge_evidence(s: SparkSession, d: str) -> DataFrame:
    return joined(parents.edge_evidence(B.edges(s, d), "source_name", ["parent_group_id"]), "edge_evidence")


SEEDS_SQL = """, s AS (SELECT c_custkey AS seed_id, CASE c_custkey % 3 WHEN 0 THEN upper(c_name) WHEN 1 THEN c_name || ' X' ELSE 'no such' END AS firm_name, CASE c_custkey % 3 WHEN 1 THEN lower(c_name) ELSE '' END AS norm FROM customer),
    h AS (SELECT seed_id, f.id FROM s JOIN f ON norm = lower(canonical_name) OR lower(firm_name) = lower(canonical_name))
    SELECT seed_id, count(DISTINCT h.id) AS matches, min(h.id) AS firm_id, CASE WHEN count(h.id) = 0 THEN 'unresolved' WHEN count(DISTINCT h.id) > 1 THEN 'ambiguous' ELSE 'resolved' END AS outcome FROM s LEFT JOIN h USING (seed_id) GROUP BY 1"""


@query(with_sql("f", SEEDS_SQL))
def seed_names(s: SparkSession, d: str) -> DataFrame:
    third, name = F.col("c_custkey") % 3, F.col("c_name")
    seeds = B.table(s, d, "customer").select(F.col("c_custkey").alias("seed_id"), F.when(third == 0, F.upper(name)).when(third == 1, F.concat(name, F.lit(" X"))).otherwise("no such").alias("firm_name"), F.when(third == 1, F.lower(name)).otherwise("").alias("normalized_firm_name"))
    return parents.resolve_seeds(seeds, B.firms(s, d), B.aliases(s, d)).select("seed_id", "matches", "firm_id", "outcome")


REASONS = tuple(dict.fromkeys(e for *_, examples in recall_reasons.NODES for e in examples)) + ("Nothing of the kind",)
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
REASON_SQL = f"x AS (SELECT p_partkey, lower([{', '.join(_quoted(r) for r in REASONS)}][1 + p_partkey % {len(REASONS)}]) AS norm FROM part)"
_FROZEN_SQL = " UNION ALL ".join(f"SELECT p_partkey, {_quoted(r.node_id)} AS node_id, CAST({r.confidence} AS DECIMAL(5,4)) AS confidence FROM x WHERE regexp_matches(norm, {_quoted('|'.join(f'(?:{p})' for p in r.patterns))})" for r in recall_reasons.RULES)


def _reasons(s: SparkSession, d: str) -> DataFrame:
    """Parts with one of the taxonomy's example reasons each, or one that no rule takes."""
    one = F.element_at(F.array(*[F.lit(r) for r in REASONS]), (F.lit(1) + F.col("p_partkey") % len(REASONS)).cast("int"))
    return B.table(s, d, "part").select("p_partkey", one.alias("reason"))


@query(f"WITH {REASON_SQL}, y AS ({_FROZEN_SQL}) SELECT CAST(p_partkey AS VARCHAR) AS record_id, node_id, confidence, 1 AS level FROM y UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'other', CAST(0 AS DECIMAL(5,4)), 0 FROM x WHERE p_partkey NOT IN (SELECT p_partkey FROM y)")
def frozen_rule_labels(s: SparkSession, d: str) -> DataFrame:
    return recall_reasons.labels(_reasons(s, d), "reason", "p_partkey", taxonomy=recall_reasons.frozen(s)).select("record_id", "node_id", "confidence", "level")


@query("SELECT o_orderpriority AS text, sha256(lower(o_orderpriority)) AS text_hash, count(*) AS records, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders WHERE trim(o_orderpriority) <> '' GROUP BY 1")
def text_dates(s: SparkSession, d: str) -> DataFrame:
    return T.text_dates(B.table(s, d, "orders"), "o_orderpriority", "o_orderdate")


@query("SELECT c_mktsegment AS text, count(*) OVER (PARTITION BY c_mktsegment) AS records, c_custkey AS record_id FROM customer WHERE trim(c_mktsegment) <> ''")
def text_members(s: SparkSession, d: str) -> DataFrame:
    lists = T.text_members(B.table(s, d, "customer"), "c_mktsegment", "c_custkey", part_rows=100)
    return lists.select("text", "records", F.explode("record_ids").alias("record_id"))


_REGISTERED = {"part": ("p_partkey", ["p_name", "p_type"]), "supplier": ("s_suppkey", ["s_name"])}


@query(" UNION ALL ".join(f"SELECT '{t}' AS source, CAST({k} AS VARCHAR) AS source_id, '{c}' AS field, {c} AS content FROM {t}" for t, (k, cs) in _REGISTERED.items() for c in cs))
def registered_texts(s: SparkSession, d: str) -> DataFrame:
    return ingest.text_registry({t: B.table(s, d, t) for t in _REGISTERED}, _REGISTERED)


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'E-' || CAST(event_id AS VARCHAR) ELSE 'sha1:' || sha1('{"a":' || CAST(event_id AS VARCHAR) || ',"b":"x"}') END AS id FROM events""")
def row_ids(s: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("E-"), "event_id")).when(F.col("event_id") % 3 == 1, "")
    raw = F.concat(F.lit('{"b": "x", "a": '), "event_id", F.lit("}"))
    return B.table(s, d, "events").select("event_id", text.record_id(key, raw).alias("id"))


@query("""WITH x AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 80 THEN rtrim(substr(t, 1, 79), ' ') || '…' ELSE t END AS shown FROM x""")
def clipped_texts(s: SparkSession, d: str) -> DataFrame:
    return B.table(s, d, "documents").select("doc_id", text.clip(F.col("text"), 80).alias("shown"))


@query("""SELECT s_suppkey, 'https://example.org/x.json?search=' || url_encode('name:"' || s_name || ' *~"') || '&limit=1' AS url, '/recalls/' || url_encode(s_name || ' /') AS path FROM supplier""")
def evidence_links(s: SparkSession, d: str) -> DataFrame:
    name = F.col("s_name")
    return B.table(s, d, "supplier").select("s_suppkey", text.evidence_url("https://example.org/x.json", "name", F.concat(name, F.lit(" *~"))).alias("url"), text.detail_path(F.concat(name, F.lit(" /"))).alias("path"))


def _odd_tree(s: SparkSession, d: str) -> DataFrame:
    """Regions as roots and nations below them, some under no root, some at a wrong level, some of one label."""
    r, n = B.table(s, d, "region"), B.table(s, d, "nation")
    key = F.col("n_nationkey")
    roots = r.select(F.lit("v1").alias("version"), F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("label"), F.when(F.col("r_regionkey") == 2, 1).otherwise(0).alias("level"))
    below = n.select(F.lit("v1").alias("version"), F.concat(F.lit("n"), key).alias("node_id"), F.when(key % 7 == 0, "none").otherwise(F.concat(F.lit("r"), "n_regionkey")).alias("parent_id"), F.when(key % 5 == 0, "same").otherwise(F.col("n_name")).alias("label"), F.when(key % 4 == 0, 2).otherwise(1).alias("level"))
    return roots.union(below)


@query("""WITH t AS (SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS node_id, NULL AS parent_id, r_name AS label, CASE WHEN r_regionkey = 2 THEN 1 ELSE 0 END AS level FROM region UNION ALL
    SELECT 'n' || CAST(n_nationkey AS VARCHAR), CASE WHEN n_nationkey % 7 = 0 THEN 'none' ELSE 'r' || CAST(n_regionkey AS VARCHAR) END, CASE WHEN n_nationkey % 5 = 0 THEN 'same' ELSE n_name END, CASE WHEN n_nationkey % 4 = 0 THEN 2 ELSE 1 END FROM nation)
    SELECT 'v1' AS version, node_id, 'several nodes with this label' AS problem FROM t WHERE label IN (SELECT label FROM t GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'v1', node_id, 'roots are of level 0' FROM t WHERE parent_id IS NULL AND level <> 0
    UNION ALL SELECT 'v1', node_id, 'unknown parent' FROM t WHERE parent_id = 'none'
    UNION ALL SELECT 'v1', t.node_id, 'not one level below its parent' FROM t JOIN t p ON p.node_id = t.parent_id WHERE t.level <> p.level + 1""")
def taxonomy_problems(s: SparkSession, d: str) -> DataFrame:
    return T.problems(_odd_tree(s, d))


@query("""WITH a AS (SELECT CAST(p_partkey AS VARCHAR) AS text_hash, CASE p_partkey % 3 WHEN 0 THEN 'large' WHEN 1 THEN 'nonsense' ELSE 'promo' END AS node_id, least(greatest(p_size / 25.0 - 0.5, 0), 1) AS confidence FROM part)
    SELECT text_hash, CASE WHEN node_id = 'nonsense' THEN 'other' ELSE node_id END AS node_id, round(CASE WHEN node_id = 'nonsense' THEN 0 ELSE confidence END, 6) AS confidence FROM a""")
def guarded_answers(s: SparkSession, d: str) -> DataFrame:
    node = F.when(F.col("p_partkey") % 3 == 0, "large").when(F.col("p_partkey") % 3 == 1, "nonsense").otherwise("promo")
    answers = B.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("text_hash"), node.alias("node_id"), (F.col("p_size") / 25.0 - 0.5).alias("confidence"))
    return T.guarded(answers, B.taxonomy(s)).withColumn("confidence", F.round("confidence", 6))


# -- specifications ----------------------------------------------------------------------------------------------------


def _spec(s: SparkSession, d: str, q: spec.QuerySpec) -> DataFrame:
    out = spec.execute(spec.refine(q), B.tables(s, d), ORDERS).rows
    return joined(out) if "evidence" in out.columns else out


F_ONLY = (spec.FilterSpec("status", spec.Op.eq, ("F",)),)
SPECS: dict[str, tuple[spec.QuerySpec, str]] = {
    "spec_count_total": (spec.QuerySpec(spec.Intent.count_total, F_ONLY), with_sql("r", "SELECT count(*) AS n FROM r WHERE status = 'F'")),
    "spec_count_total_node": (spec.QuerySpec(spec.Intent.count_total, F_ONLY, taxonomy_node_id=" promo "), with_sql("rl", "SELECT count(*) AS n FROM r WHERE status = 'F' AND id IN (SELECT record_id FROM l WHERE node_id = 'promo')")),
    "spec_count_by": (spec.QuerySpec(spec.Intent.count_by, F_ONLY, group_by="state", limit=3), with_sql("r", f"SELECT state, count(*) AS n, {ev(NEWEST)} AS evidence FROM r WHERE status = 'F' GROUP BY state ORDER BY n DESC, state LIMIT 3")),
    "spec_count_by_taxonomy": (spec.QuerySpec(spec.Intent.count_by_taxonomy, F_ONLY), with_sql("rlt", f"SELECT t.node_id, t.label, count(DISTINCT r.id) AS n, {ev(NEWEST)} AS evidence FROM r JOIN l ON l.record_id = r.id JOIN t ON t.node_id = l.node_id WHERE status = 'F' GROUP BY ALL")),
    "spec_trend": (spec.QuerySpec(spec.Intent.trend, F_ONLY, grain="decade"), with_sql("r", "SELECT CAST(date_trunc('year', report_date) AS DATE) AS period, count(*) AS n FROM r WHERE status = 'F' GROUP BY 1")),
    "spec_sample": (spec.QuerySpec(spec.Intent.sample, F_ONLY, limit=7), with_sql("r", "SELECT recall_number, recalling_firm, classification, country FROM r WHERE status = 'F' ORDER BY id LIMIT 7")),
    "spec_raw_exposure": (spec.QuerySpec(spec.Intent.raw_firm_exposure, F_ONLY, exposure_metric=spec.ExposureMetric.recall_count), _board("total_recalls DESC, exposure_score DESC", "status = 'F'")),
    "spec_parent_exposure": (spec.QuerySpec(spec.Intent.parent_group_exposure), ORACLE["parent_exposure"]),
    "spec_explain_node": (spec.QuerySpec(spec.Intent.explain_taxonomy_node, taxonomy_node_id="large"), ORACLE["explain_node"]),
}
for _name, (_q, _sql) in SPECS.items():
    query(_sql, _name)(lambda s, d, q=_q: _spec(s, d, q))


@query(with_sql("r", "SELECT count(*) AS n FROM r WHERE classification = 'Class II' AND report_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"))
def routed_question(s: SparkSession, d: str) -> DataFrame:
    return _spec(s, d, routers.route("How many class II recalls in 1996?", [("large", "large goods")]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
