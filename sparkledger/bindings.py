"""The driver tables as the data model of the operators: orders as records, parts as labels, customers as firms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkledger.plans.catalog import Catalog, Kind
from sparkledger.plans.spec import Tables

ORDERS = Catalog(
    columns={
        "recall_number": Kind.ID, "recalling_firm": Kind.DIMENSION, "country": Kind.DIMENSION, "state": Kind.DIMENSION,
        "status": Kind.DIMENSION, "classification": Kind.DIMENSION, "segment": Kind.DIMENSION,
        "recall_initiation_date": Kind.DATE, "report_date": Kind.DATE,
    },
    indexed=("status", "classification", "state", "segment"),
    sample_columns=("recall_number", "recalling_firm", "classification", "country"),
)
#: Priorities as classes; the lowest has none.
CLASS_OF = {"1-URGENT": "Class I", "2-HIGH": "Class II", "3-MEDIUM": "Class III", "4-NOT SPECIFIED": "Not Yet Classified"}
GROUPS = {"size_class": ("small", "medium", "large"), "market_class": ("economy", "standard", "promo")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer, nation and region; Spark prunes the joins whose columns aren't used."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    classification = F.when(F.lit(False), "")
    for k, v in CLASS_OF.items():
        classification = classification.when(F.col("o_orderpriority") == k, v)
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    day = F.col("o_orderdate").cast("date")
    return rows.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("recall_number"), F.col("c_name").alias("recalling_firm"), F.col("n_name").alias("country"), F.col("r_name").alias("state"),
        F.col("o_orderstatus").alias("status"), classification.alias("classification"), F.col("c_mktsegment").alias("segment"), day.alias("recall_initiation_date"), day.alias("report_date"), F.col("o_totalprice").alias("amount"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order has the types of its parts as labels, each once."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = li.select("l_orderkey", "l_partkey", "l_quantity").join(p.select("p_partkey", "p_type"), li.l_partkey == F.col("p_partkey"))
    grouped = rows.groupBy(F.col("l_orderkey").alias("record_id"), F.lower("p_type").alias("node_id")).agg((F.max("l_quantity") / 50).cast("decimal(5,4)").alias("confidence"))
    return grouped.select("record_id", F.lit("v1").alias("version"), "node_id", "confidence", F.lit("rules").alias("labeler"))


def taxonomy(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    rows = [("v1", g, None, g.replace("_", " "), 0) for g in GROUPS]
    rows += [("v1", c, g, f"{c} goods", 1) for g, cs in GROUPS.items() for c in cs]
    return spark.createDataFrame(rows, "version string, node_id string, parent_id string, label string, level int").withColumn("definition", F.concat(F.lit("About "), "label"))


def firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical_name"), F.lower("c_name").alias("normalized_name"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers, but for one in fifty; record_count is the number of orders."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    n = o.groupBy("o_custkey").agg(F.count(F.lit(1)).cast("int").alias("record_count"))
    rows = c.where("c_custkey % 50 <> 49").join(n, c.c_custkey == n.o_custkey, "left")
    return rows.select(F.col("c_name").alias("raw_firm"), F.lower("c_name").alias("normalized_raw_firm"), F.col("c_custkey").alias("firm_id"), F.coalesce("record_count", F.lit(0)).alias("record_count"))


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return r.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("canonical_name"), F.lower("r_name").alias("normalized_name"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to regions, in a state by the last digit of their key: 0-5 backed, 6 open, 7 unknown, 8 by a model, 9 none."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    digit = F.col("c_custkey") % 10
    rows = c.where(digit != 9).join(n, c.c_nationkey == n.n_nationkey)
    return rows.select(
        F.col("c_custkey").alias("firm_id"), F.col("n_regionkey").cast("long").alias("parent_group_id"),
        F.when(digit == 7, "unknown").when(digit == 8, "inferred").otherwise("external").alias("provenance_tier"),
        F.when(digit == 7, "unknown").when(digit == 8, "llm").otherwise("external").alias("source"),
        F.concat(F.lit("list-"), (F.col("c_custkey") % 3).cast("string")).alias("source_name"), F.col("c_custkey").cast("string").alias("source_id"), F.lit("2001-01-01").cast("date").alias("as_of_date"),
        F.when(digit == 6, "needs_review").otherwise("confirmed").alias("review_status"), F.lit(True).alias("active"), F.when(digit == 7, 0.0).otherwise(0.9).cast("decimal(5,4)").alias("confidence"),
    )


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(records(spark, sf_dir), labels(spark, sf_dir), taxonomy(spark), aliases(spark, sf_dir), firms(spark, sf_dir), edges(spark, sf_dir), parents(spark, sf_dir))


# the same bindings in SQL
_TREE = ", ".join(f"('v1', '{g}', NULL, '{g.replace('_', ' ')}', 0)" for g in GROUPS) + ", " + ", ".join(f"('v1', '{c}', '{g}', '{c} goods', 1)" for g, cs in GROUPS.items() for c in cs)
_CLASSES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASS_OF.items())
SQL = {
    "r": f"""r AS (SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS recall_number, c_name AS recalling_firm, n_name AS country, r_name AS state, o_orderstatus AS status,
        CASE o_orderpriority {_CLASSES} END AS classification, c_mktsegment AS segment, CAST(o_orderdate AS DATE) AS recall_initiation_date, CAST(o_orderdate AS DATE) AS report_date, o_totalprice AS amount
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "l": """l AS (SELECT l_orderkey AS record_id, 'v1' AS version, lower(p_type) AS node_id, CAST(max(l_quantity) / 50 AS DECIMAL(5,4)) AS confidence, 'rules' AS labeler
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)""",
    "t": f"t AS (SELECT *, 'About ' || label AS definition FROM (VALUES {_TREE}) v(version, node_id, parent_id, label, level))",
    "f": "f AS (SELECT c_custkey AS id, c_name AS canonical_name, lower(c_name) AS normalized_name FROM customer)",
    "a": """a AS (SELECT c_name AS raw_firm, lower(c_name) AS normalized_raw_firm, c_custkey AS firm_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS record_count
        FROM customer WHERE c_custkey % 50 <> 49)""",
    "p": "p AS (SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS canonical_name FROM region)",
    "e": """e AS (SELECT c_custkey AS firm_id, CAST(n_regionkey AS BIGINT) AS parent_group_id, CASE c_custkey % 10 WHEN 7 THEN 'unknown' WHEN 8 THEN 'inferred' ELSE 'external' END AS provenance_tier,
        CASE c_custkey % 10 WHEN 7 THEN 'unknown' WHEN 8 THEN 'llm' ELSE 'external' END AS source, 'list-' || CAST(c_custkey % 3 AS VARCHAR) AS source_name, CAST(c_custkey AS VARCHAR) AS source_id, DATE '2001-01-01' AS as_of_date,
        CASE c_custkey % 10 WHEN 6 THEN 'needs_review' ELSE 'confirmed' END AS review_status, true AS active, CAST(CASE c_custkey % 10 WHEN 7 THEN 0 ELSE 0.9 END AS DECIMAL(5,4)) AS confidence
        FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 <> 9)""",
    "m": """m AS (SELECT r.*, f.id AS firm_id, f.canonical_name AS firm_name, p.id AS parent_group_id, p.canonical_name AS parent_group_name, e.provenance_tier, e.source, e.source_name, e.as_of_date
        FROM r JOIN a ON a.raw_firm = r.recalling_firm JOIN f ON f.id = a.firm_id JOIN e ON e.firm_id = f.id AND e.active AND e.review_status = 'confirmed' AND e.provenance_tier <> 'unknown' AND e.source <> 'llm' JOIN p ON p.id = e.parent_group_id)""",
}


def with_sql(names: str, body: str) -> str:
    """A statement over the named bindings; a body that begins with a comma adds common tables of its own."""
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names) + ("" if body.startswith(",") else " ") + body
