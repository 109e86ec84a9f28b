"""Taxonomies and labels: trees, coverage, rule and model labelling, residuals, mined prefixes and vector clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkledger.functions.text import extract_prefix, normalize_text, slugify, text_hash

NODE = "version string, node_id string, parent_id string, label string, definition string, examples array<string>, level int, status string"
LABEL = "record_id string, version string, node_id string, level int, confidence decimal(5,4), evidence string, source_text_hash string, labeler string, model string"
CACHE = "key string, text_hash string, node_id string, confidence double, written_at string"
MAX_DEPTH = 20

#: A short tree of our own with the roots of the frozen one, which is in `recall_reasons`.
ROOTS = ("quality_and_potency", "manufacturing_controls", "labeling_and_packaging", "regulatory_status", "storage_distribution", "other")
CHILDREN = {
    "quality_and_potency": ("sterility", "microbial", "particulate", "potency", "dissolution", "impurities", "stability", "cross_contamination", "appearance", "content_uniformity"),
    "manufacturing_controls": ("cgmp_deviation", "process_control", "equipment"),
    "labeling_and_packaging": ("label_error", "label_mixup", "container_defect"),
    "regulatory_status": ("unapproved_product",),
    "storage_distribution": ("temperature_excursion",),
}


@dataclass(frozen=True)
class Rule:
    """A label, its confidence and the patterns over normalised text of which any one suffices."""

    node_id: str
    confidence: float
    patterns: tuple[str, ...]


#: One rule a child node, in words of our own.
RULES = (
    Rule("sterility", 0.95, (r"\b(lack|loss) of (assurance of )?sterility\b", r"\bnon-?steril", r"\bsterility\b")),
    Rule("microbial", 0.92, (r"\bmicrobial\b", r"\bbacteri", r"\b(mold|fungal|yeast)\b")),
    Rule("particulate", 0.92, (r"\bparticulate", r"\bforeign (matter|material|object)", r"\b(glass|metal) (particle|fragment)")),
    Rule("potency", 0.93, (r"\b(sub|super) ?-?potent", r"\bpotency\b")),
    Rule("dissolution", 0.95, (r"\bdissolution\b",)),
    Rule("impurities", 0.92, (r"\bimpurit", r"\bdegrad", r"\bnitrosamine")),
    Rule("stability", 0.88, (r"\bstability\b", r"\bshelf life\b", r"\bexpir")),
    Rule("cross_contamination", 0.93, (r"\bcross[- ]contaminat",)),
    Rule("appearance", 0.85, (r"\bdiscolou?r", r"\b(odd|unusual|off) (odor|smell|taste|color)", r"\bprecipitat")),
    Rule("content_uniformity", 0.93, (r"\bcontent uniformity\b", r"\bblend uniformity\b")),
    Rule("cgmp_deviation", 0.95, (r"\bc?gmp\b", r"\bgood manufacturing practice")),
    Rule("process_control", 0.85, (r"\b(in-)?process control", r"\bvalidation (fail|lack)", r"\black of (process )?control")),
    Rule("equipment", 0.80, (r"\bequipment\b", r"\bmachine (fail|malfunction)")),
    Rule("label_error", 0.93, (r"\bmis-?label", r"\b(incorrect|wrong|missing) label", r"\blabel(l?ing)?: ")),
    Rule("label_mixup", 0.94, (r"\blabel mix-?up\b", r"\bproduct mix-?up\b", r"\bwrong (bottle|vial|carton)")),
    Rule("container_defect", 0.88, (r"\b(container|closure|seal|cap|vial) (defect|leak|crack|integrity)", r"\bleak(ing|age)?\b")),
    Rule("unapproved_product", 0.95, (r"\bunapproved\b", r"\bwithout an approved\b", r"\bundeclared\b")),
    Rule("temperature_excursion", 0.93, (r"\btemperature (excursion|abuse)", r"\bstored (above|below|outside)", r"\bcold chain\b")),
)


def first_taxonomy(spark: SparkSession, version: str = "v1") -> DataFrame:
    """The short tree of 24 nodes: 6 roots and 18 children."""
    title = lambda x: x.replace("_", " ").capitalize()
    rows = [(version, r, None, title(r), f"Reports about {r.replace('_', ' ')}.", [], 0, "active") for r in ROOTS]
    rows += [(version, c, r, title(c), f"Reports about {c.replace('_', ' ')}.", [], 1, "active") for r, cs in CHILDREN.items() for c in cs]
    return spark.createDataFrame(rows, NODE)


def problems(taxonomy: DataFrame) -> DataFrame:
    """(version, node_id, problem) of every broken rule."""
    by = lambda *c: Window.partitionBy(*c)
    own = taxonomy.withColumns({"_n": F.count(F.lit(1)).over(by("version", "node_id")), "_l": F.count(F.lit(1)).over(by("version", "label"))})
    up = taxonomy.select(F.col("version").alias("_v"), F.col("node_id").alias("_p"), F.col("level").alias("_plevel")).distinct()
    rows = own.join(up, (F.col("version") == F.col("_v")) & (F.col("parent_id") == F.col("_p")), "left")
    root = F.col("parent_id").isNull()
    tests = (
        ("several nodes with this id", F.col("_n") > 1),
        ("several nodes with this label", F.col("_l") > 1),
        ("roots are of level 0", root & (F.col("level") != 0)),
        ("unknown parent", ~root & F.col("_p").isNull()),
        ("not one level below its parent", ~root & (F.col("level") != F.col("_plevel") + 1)),
        ("its own parent", F.col("parent_id") == F.col("node_id")),
    )
    found = F.filter(F.array(*[F.when(t, F.lit(name)) for name, t in tests]), lambda x: x.isNotNull())
    return rows.select("version", "node_id", F.explode(found).alias("problem")).distinct()


def subtree(taxonomy: DataFrame, node_id: str, version: str = "v1") -> DataFrame:
    """(node_id, depth) of a node and all below it; a cycle ends at MAX_DEPTH."""
    spark = taxonomy.sparkSession
    sql = """
        WITH RECURSIVE walk(node_id, depth) AS (
            SELECT node_id, 0 FROM {tree} WHERE version = :version AND node_id = :node
            UNION ALL
            SELECT t.node_id, w.depth + 1 FROM {tree} t JOIN walk w ON t.parent_id = w.node_id WHERE t.version = :version AND w.depth < :deepest
        ) SELECT node_id, min(depth) AS depth FROM walk GROUP BY node_id
    """
    return spark.sql(sql, args={"version": version, "node": node_id, "deepest": MAX_DEPTH}, tree=taxonomy)


def coverage(records: DataFrame, labels: DataFrame, key: str, version: str = "v1", labeler: str | None = None) -> DataFrame:
    """One row: records, labelled ones, label rows, unlabelled ones and the share labelled (four places, half to even)."""
    rows = labels.where(F.col("version") == version)
    rows = rows.where(F.col("labeler") == labeler) if labeler else rows
    total = records.agg(F.count(F.lit(1)).alias("total_records"))
    marks = rows.agg(F.count(F.lit(1)).alias("label_rows"), F.countDistinct("record_id").alias("labelled_records"))
    out = total.crossJoin(marks)  # one row by one row
    share = F.coalesce(F.try_divide(F.col("labelled_records"), F.col("total_records")), F.lit(0.0))
    return out.withColumn("unlabelled_records", F.greatest(F.col("total_records") - F.col("labelled_records"), F.lit(0))).withColumn("coverage", F.bround(share, 4))


def node_counts(labels: DataFrame, taxonomy: DataFrame, version: str = "v1") -> DataFrame:
    """(node_id, label, records, label_rows) of every node, those without labels too."""
    n = labels.where(F.col("version") == version).groupBy("node_id").agg(F.countDistinct("record_id").alias("records"), F.count(F.lit(1)).alias("label_rows"))
    nodes = taxonomy.where(F.col("version") == version).select("node_id", "label")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.join(n, "node_id", "left").select("node_id", "label", zero("records"), zero("label_rows"))


def with_subtree(records: DataFrame, labels: DataFrame, taxonomy: DataFrame, key: str, node_id: str, version: str = "v1", min_confidence: float = 0.0, labeler: str | None = None) -> DataFrame:
    """Records that have a label of the node or one below it, each once."""
    rows = labels.where((F.col("version") == version) & (F.col("confidence") >= min_confidence))
    rows = rows.where(F.col("labeler") == labeler) if labeler else rows
    have = rows.join(F.broadcast(subtree(taxonomy, node_id, version)), "node_id", "left_semi").select(F.col("record_id").alias(key))
    return records.join(have, key, "left_semi")


def rule_matches(text: Column, rules: Iterable[Rule] = RULES) -> Column:
    """All rules that a text satisfies, as structs ordered by node."""
    norm = normalize_text(text)
    parts = []
    for r in sorted(rules, key=lambda r: r.node_id):
        test = norm.rlike("|".join(f"(?:{p})" for p in r.patterns))
        parts.append(F.when(test, F.struct(F.lit(r.node_id).alias("node_id"), F.lit(r.confidence).alias("confidence"))))
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def distinct_texts(records: DataFrame, text: str, key: str) -> DataFrame:
    """(text_hash, text, records, first_id): each normalised text once, however many records have it."""
    rows = records.where(F.col(text).isNotNull() & (F.btrim(text) != ""))
    return rows.groupBy(text_hash(F.col(text)).alias("text_hash")).agg(F.min(text).alias("text"), F.count(F.lit(1)).alias("records"), F.min(key).alias("first_id"))


def text_dates(records: DataFrame, text: str, date: str) -> DataFrame:
    """(text, text_hash, records, first_date, last_date): each text as it is written once, blank ones left out."""
    rows = records.where(F.col(text).isNotNull() & (F.btrim(text) != ""))
    out = rows.groupBy(F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("records"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    return out.select("text", text_hash(F.col("text")).alias("text_hash"), "records", "first_date", "last_date")


def text_members(records: DataFrame, text: str, key: str, part_rows: int = 10_000) -> DataFrame:
    """(text, text_hash, records, part, parts, record_ids): each text with the ids that have it, in order within a part.

    A text of more than part_rows records is spread over as many parts by a hash of the id, so that no list and no task
    grows with the commonest text. Null ids are counted and not listed.
    """
    rows = records.where(F.col(text).isNotNull() & (F.btrim(text) != "")).select(F.col(text).alias("text"), F.col(key).alias("_id"))
    sizes = rows.groupBy("text").agg(F.count(F.lit(1)).alias("records"))
    sizes = sizes.withColumn("parts", F.ceil(F.col("records") / part_rows).cast("int"))
    placed = rows.join(sizes, "text").withColumn("part", F.pmod(F.xxhash64("_id"), F.col("parts")).cast("int"))
    out = placed.groupBy("text", "records", "part", "parts").agg(F.array_sort(F.collect_list("_id")).alias("record_ids"))
    return out.select("text", text_hash(F.col("text")).alias("text_hash"), "records", "part", "parts", "record_ids")


def rule_labels(records: DataFrame, text: str, key: str, rules: Iterable[Rule] = RULES, other: bool = False, taxonomy: DataFrame | None = None, version: str = "v1", labeler: str = "rules") -> DataFrame:
    """Label rows of all records: distinct texts are labelled once and joined back on their hash.

    With `other` texts that no rule takes get that node at confidence 0. Levels come from the taxonomy if given.
    """
    texts = distinct_texts(records, text, key)
    found = rule_matches(F.col("text"), rules)
    if other:
        none = F.array(F.struct(F.lit("other").alias("node_id"), F.lit(0.0).alias("confidence")))
        found = F.when(F.size(found) == 0, none).otherwise(found)
    marks = texts.select("text_hash", F.explode(found).alias("m"))
    rows = records.select(F.col(key).cast("string").alias("record_id"), text_hash(F.col(text)).alias("text_hash")).join(marks, "text_hash")
    out = rows.select("record_id", F.lit(version).alias("version"), F.col("m.node_id").alias("node_id"), F.col("m.confidence").cast("decimal(5,4)").alias("confidence"), F.col("text_hash").alias("source_text_hash"), F.lit(labeler).alias("labeler"))
    if taxonomy is None:
        return out
    return out.join(F.broadcast(taxonomy.where(F.col("version") == version).select("node_id", "level")), "node_id", "left")


def replaced(labels: DataFrame, new: DataFrame, labeler: str, version: str = "v1") -> DataFrame:
    """The label table with everything of one labeler replaced."""
    return labels.where(~((F.col("labeler") == labeler) & (F.col("version") == version))).unionByName(new, allowMissingColumns=True)


def unmatched(records: DataFrame, text: str, key: str, rules: Iterable[Rule] = RULES, n: int = 25) -> DataFrame:
    """The commonest texts that no rule takes."""
    return distinct_texts(records, text, key).where(F.size(rule_matches(F.col("text"), rules)) == 0).orderBy(F.col("records").desc(), "text").limit(n)


def guarded(answers: DataFrame, taxonomy: DataFrame, version: str = "v1") -> DataFrame:
    """Answers (text_hash, node_id, confidence) within the closed set of nodes; texts left with none get other at 0."""
    nodes = taxonomy.where(F.col("version") == version).select("node_id").distinct()
    known = answers.join(F.broadcast(nodes), "node_id", "left_semi").select("text_hash", "node_id", F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)).alias("confidence"))
    lost = answers.select("text_hash").distinct().join(known, "text_hash", "left_anti")
    return known.union(lost.select("text_hash", F.lit("other"), F.lit(0.0)))


def model_labels(texts: DataFrame, label: Callable[[str], list[tuple[str, float]]], cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, misses): a client's labels of the texts that the cache (text_hash, node_id, confidence) doesn't have.

    `label` is called in each partition; texts it fails on are left out and stay misses of the next run.
    """
    misses = texts if cache is None else texts.join(cache.select("text_hash").distinct(), "text_hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for h, t in zip(b["text_hash"], b["text"], strict=True):
                try:
                    rows += [(h, n, float(c)) for n, c in label(t)]
                except Exception:  # noqa: BLE001, S112  a client may fail in any way
                    continue
            yield pd.DataFrame(rows, columns=["text_hash", "node_id", "confidence"])

    new = misses.select("text_hash", "text").mapInPandas(run, "text_hash string, node_id string, confidence double")
    return (new if cache is None else cache.select("text_hash", "node_id", "confidence").union(new)), misses


def cache_key(version: Column, digest: str, model: str, text_hash_col: Column, other_node: str = "other") -> Column:
    """SHA-256 (hex) of all that a cached answer depends on."""
    return F.sha2(F.concat_ws("|", version, F.lit(digest), F.lit(model), text_hash_col, F.lit(other_node)), 256)


def read_label_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, text_hash, node_id, confidence): the newest answers kept for each key; a cache not yet written is empty."""
    try:
        rows = spark.read.schema(CACHE).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    if not rows.where("key IS NULL").isEmpty():
        raise ValueError(f"a line of the cache {path} has no key")
    last = rows.groupBy("key").agg(F.max("written_at").alias("written_at"))
    return rows.join(last, ["key", "written_at"], "left_semi").select("key", "text_hash", "node_id", "confidence")


def append_label_cache(answers: DataFrame, path: str, key: Column) -> None:
    """Appends answers (text_hash, node_id, confidence) as JSON lines, all of one call with one time.

    A later run then asks for the texts alone whose key isn't there.
    """
    now = datetime.now(UTC).isoformat(timespec="microseconds")
    rows = answers.select(key.alias("key"), "text_hash", "node_id", F.col("confidence").cast("double").alias("confidence"), F.lit(now).alias("written_at"))
    rows.write.mode("append").json(path)


def residual(records: DataFrame, labels: DataFrame, key: str, labeler: str, version: str = "v1", min_confidence: float = 0.70) -> DataFrame:
    """Records without a label of the labeler, or with a weak one or `other`.

    Labels are first reduced to one row a record, so one join answers both questions.
    """
    rows = labels.where((F.col("version") == version) & (F.col("labeler") == labeler))
    weak = (F.col("confidence") < min_confidence) | (F.col("node_id") == "other")
    state = rows.groupBy(F.col("record_id").alias(key)).agg(F.max(weak.cast("int")).alias("_weak"))
    return records.join(state, key, "left").where("_weak IS NULL OR _weak = 1").drop("_weak")


def growth(residuals: DataFrame, text: str, date: str, as_of: Column, days: int = 180) -> DataFrame:
    """(text, records, recent) of residual texts, recent ones within `days` of a given day."""
    return residuals.where(F.col(text).isNotNull()).groupBy(text).agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col(date) >= F.date_sub(as_of, days)).alias("recent"))


def mine_prefixes(texts: DataFrame, text: str, weight: str, min_count: int = 1, limit: int = 50, examples: int = 5) -> DataFrame:
    """(prefix, texts, records, examples): leading phrases of distinct texts, most texts first, then by prefix."""
    rows = texts.select(F.col(text).alias("text"), F.col(weight).alias("w"), extract_prefix(F.col(text)).alias("prefix")).where("prefix IS NOT NULL")
    counts = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("texts"), F.sum("w").cast("long").alias("records")).where(F.col("texts") >= min_count)
    top = counts.orderBy(F.col("texts").desc(), "prefix").limit(limit)
    shown = rows.join(F.broadcast(top.select("prefix")), "prefix", "left_semi").withColumn("_rn", F.row_number().over(Window.partitionBy("prefix").orderBy("text"))).where(F.col("_rn") <= examples)
    return top.join(shown.groupBy("prefix").agg(F.array_sort(F.collect_list("text")).alias("examples")), "prefix")


def cluster_key(member_hashes: Column, kind: str = "prefix") -> Column:
    """16 hex digits of the first 50 member hashes in order."""
    joined = F.array_join(F.slice(F.array_sort(member_hashes), 1, 50), "|")
    return F.substring(F.sha2(F.concat(F.lit(f"{kind}:"), joined), 256), 1, 16)


def prefix_clusters(texts: DataFrame, text: str, weight: str, min_size: int = 10, limit: int = 24) -> DataFrame:
    """(cluster_key, prefix, texts, records, coherence): groups by leading phrase where there are no vectors.

    The key is made of the 50 smallest member hashes, found by a ranked window.
    """
    mined = mine_prefixes(texts, text, weight, min_size, limit).drop("examples")
    rows = texts.select(text_hash(F.col(text)).alias("h"), extract_prefix(F.col(text)).alias("prefix")).join(F.broadcast(mined.select("prefix")), "prefix", "left_semi")
    first = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("prefix").orderBy("h"))).where("_rn <= 50")
    keys = first.groupBy("prefix").agg(cluster_key(F.collect_list("h")).alias("cluster_key"))
    return mined.join(keys, "prefix").withColumn("coherence", F.lit(1.0))


def candidate_nodes(clusters: DataFrame, taxonomy: DataFrame, parent_id: str = "other", version: str = "v1", limit: int = 20) -> DataFrame:
    """Proposed nodes of clusters, those left out whose id the taxonomy has."""
    rows = clusters.withColumn("node_id", slugify(F.col("prefix"))).where("node_id <> ''")
    new = rows.join(F.broadcast(taxonomy.where(F.col("version") == version).select("node_id")), "node_id", "left_anti")
    out = new.select(F.lit(version).alias("taxonomy_version"), "cluster_key", F.col("node_id").alias("candidate_node_id"), F.lit(parent_id).alias("parent_id"), F.initcap("prefix").alias("proposed_label"), F.col("records").alias("size"), "coherence", F.lit("proposed").alias("status"))
    return out.orderBy(F.col("size").desc(), "candidate_node_id").limit(limit)


def vector_clusters(vectors: DataFrame, key: str, vector: str, min_size: int = 25, max_clusters: int = 24, seed: int = 13) -> DataFrame:
    """(cluster, size, coherence, members): k-means over unit vectors, small clusters dropped, largest first.

    k is the number of vectors over the least size, within 2 and max_clusters. coherence is the mean cosine to the
    centre, within 0 and 1, at four places; members are the first ten keys.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    norm = F.sqrt(F.aggregate(F.transform(F.col(vector).cast("array<double>"), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    rows = vectors.where(F.col(vector).isNotNull()).withColumn("_n", norm).where("_n > 0")
    unit = rows.select(F.col(key).alias("key"), F.transform(F.col(vector).cast("array<double>"), lambda x: x / F.col("_n")).alias("v"))
    n = unit.count()
    if n < 2:
        return unit.select(F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("coherence"), F.array().cast("array<string>").alias("members")).where(F.lit(False))
    model = KMeans(k=min(max_clusters, max(2, n // max(1, min_size))), seed=seed, distanceMeasure="cosine", featuresCol="f", predictionCol="cluster").fit(unit.withColumn("f", array_to_vector("v")))
    centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, c array<double>")
    marked = model.transform(unit.withColumn("f", array_to_vector("v"))).select("key", vector_to_array("f").alias("v"), "cluster")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot(F.col("v"), F.col("c")) / F.sqrt(dot(F.col("c"), F.col("c")))
    scored = marked.join(F.broadcast(centres), "cluster").withColumn("cosine", cosine)
    first = scored.withColumn("_rn", F.row_number().over(Window.partitionBy("cluster").orderBy("key"))).where("_rn <= 10").groupBy("cluster").agg(F.array_sort(F.collect_list(F.col("key").cast("string"))).alias("members"))
    sizes = scored.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg("cosine"))), 4).alias("coherence")).where(F.col("size") >= min_size)
    return sizes.join(first, "cluster").orderBy(F.col("size").desc(), "cluster")


def labelled_nodes(labels: DataFrame, taxonomy: DataFrame, version: str = "v1") -> DataFrame:
    """Nodes that any record is labelled with."""
    return taxonomy.where(F.col("version") == version).join(labels.where(F.col("version") == version).select("node_id"), "node_id", "left_semi")


def drafted(prefixes: DataFrame, themes: list[tuple[str, str]], version: str = "draft", other: str = "other") -> DataFrame:
    """A tree drafted from mined prefixes: each under the first theme (root, pattern) that it satisfies, else under `other`."""
    root = F.when(F.lit(False), F.lit(""))
    for node, pattern in themes:
        root = root.when(F.col("prefix").rlike(pattern), F.lit(node))
    child = prefixes.select(slugify(F.col("prefix")).alias("node_id"), root.otherwise(F.lit(other)).alias("parent_id"), F.initcap("prefix").alias("label"), F.lit(1).alias("level")).where("node_id <> ''")
    child = child.groupBy("node_id").agg(F.min("parent_id").alias("parent_id"), F.min("label").alias("label"), F.min("level").alias("level"))
    roots = child.select(F.col("parent_id").alias("node_id")).distinct().select("node_id", F.lit(None).cast("string").alias("parent_id"), F.initcap(F.regexp_replace("node_id", "_", " ")).alias("label"), F.lit(0).alias("level"))
    return roots.unionByName(child).select(F.lit(version).alias("version"), "node_id", "parent_id", "label", "level", F.lit("draft").alias("status"))


def match_terms(texts: DataFrame, text: str, key: str, terms: list[tuple[str, str]]) -> DataFrame:
    """(key, node_id): the node of the first term, in the order given, that a text holds; texts without any are left out."""
    norm, node = normalize_text(F.col(text)), F.when(F.lit(False), F.lit(""))
    for term, node_id in terms:
        node = node.when(norm.contains(term.lower()), F.lit(node_id))
    return texts.select(key, node.alias("node_id")).where("node_id IS NOT NULL")


def ordered_terms(taxonomy: DataFrame, version: str = "v1") -> list[tuple[str, str]]:
    """(term, node_id) of a tree (its size is a driver's): children before roots, long terms before short ones."""
    rows = taxonomy.where(F.col("version") == version).select("node_id", "label", "level").collect()
    return [(r.label, r.node_id) for r in sorted(rows, key=lambda r: (-r.level, -len(r.label), r.label))]
