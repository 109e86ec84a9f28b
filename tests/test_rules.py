"""Hand-computed cases of the rules, on small fixtures."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sparkledger.functions import names as N
from sparkledger.functions import stats, text
from sparkledger.operators import aggregates as A
from sparkledger.operators import entities, evaluation, fulltext, parents, recall_reasons, retrieval, semantic
from sparkledger.operators import taxonomy as T
from sparkledger.plans import filters, gate, routers, spec
from sparkledger.plans.catalog import RECALLS, schema_context, with_comments
from sparkledger.plans.filters import Filter
from sparkledger.sources import ingest
from sparkledger.streaming import updates

RECORDS = [
    # id, number, firm, class, reason, product, status, day
    (1, "D-0001-2024", "Acme Inc", "Class I", "Lack of sterility", "Eye drops 5%", "Ongoing", date(2024, 1, 5)),
    (2, "D-0002-2024", "Acme Inc", "Class II", "CGMP deviations: none", "Tablets a_b", "Ongoing", date(2024, 1, 9)),
    (3, "D-0003-2024", "Beta Ltd", "Class I", "lack of  STERILITY", None, "Terminated", None),
    (4, "D-0004-2024", "Beta Ltd", "Class II", None, "back\\slash", "Terminated", date(2023, 12, 31)),
    (5, "D-0005-2024", None, None, "label mix-up", "x", "Ongoing", date(2024, 2, 1)),
    (6, "D-0006-2024", "   ", "Odd", " ", "x", None, date(2024, 2, 2)),
    (7, "D-0007-2024", "Gamma", "Class III", "other", "x", "Ongoing", date(2024, 2, 2)),
]
COLS = "id long, recall_number string, recalling_firm string, classification string, reason_for_recall string, product_description string, status string, recall_initiation_date date"


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(RECORDS, COLS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, "v1", "sterility", 0.9, "rules"), (1, "v1", "sterility", 0.8, "model"), (2, "v1", "cgmp_deviation", 0.6, "rules"), (3, "v1", "sterility", 0.9, "rules"), (7, "v1", "other", 0.0, "rules")]
    return spark.createDataFrame(rows, "record_id long, version string, node_id string, confidence double, labeler string")


@pytest.fixture(scope="module")
def tree(spark):
    return T.first_taxonomy(spark)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (Filter("status", "eq", "Ongoing"), [1, 2, 5, 7]),
        (Filter("classification", "ne", "Class I"), [2, 4, 6, 7]),
        (Filter("status", "in", []), []),
        (Filter("recall_initiation_date", "between", (date(2024, 1, 5), date(2024, 2, 1))), [1, 2, 5]),
        (Filter("product_description", "ilike", "5%"), [1]),
        (Filter("product_description", "ilike", "A_B"), [2]),
        (Filter("product_description", "ilike", "back\\s"), []),
        (Filter("reason_for_recall", "ilike", "steril"), [1, 3]),
    ],
)
def test_filters(records, f, want):
    assert ids(filters.apply(records, [f], RECALLS)) == want


@pytest.mark.parametrize(
    "bad",
    [{"nope": "x"}, {"status": {"ilike": "x"}}, {"status": ["x"] * 26}, {"status": "x" * 201}, {"status": 5}, {"report_date": {"gte": "soon"}}, {"report_date": {"op": "between", "value": ["2024-01-01"]}}, ["status"]],
)
def test_bad_requests(bad):
    with pytest.raises(ValueError):
        filters.coerce_filters(bad, RECALLS)


def test_request_forms():
    got = filters.coerce_filters({"status": "a", "state": ["b", "c"], "city": None, "country": "", "report_date": {"gte": "2024-01-01", "lte": "2024/01/31"}}, RECALLS)
    assert [(f.column, f.op) for f in got] == [("status", "eq"), ("state", "in"), ("report_date", "gte"), ("report_date", "lte")]
    assert got[3].value == date(2024, 1, 31)


def test_counts_and_evidence(records, labels, tree):
    rows = {r.classification: (r.n, r.evidence) for r in A.count_by(records, RECALLS, "classification", evidence_n=2).collect()}
    assert rows["Class I"] == (2, ["D-0001-2024", "D-0003-2024"]) and rows[None] == (1, ["D-0005-2024"])
    got = {r.node_id: (r.n, r.evidence) for r in A.count_by_taxonomy(records, labels, tree, RECALLS, evidence_n=3).collect()}
    assert got["sterility"] == (2, ["D-0001-2024", "D-0003-2024"])
    assert A.count_total(records, RECALLS, [], labels, "sterility").first().n == 2
    with pytest.raises(ValueError):
        A.count_by(records, RECALLS, "nope")
    with pytest.raises(ValueError):
        A.trend(records, RECALLS, [], "decade")


def test_trend(records):
    got = [(r.period, r.n) for r in A.trend(records, RECALLS, [], "month").collect()]
    assert got == [(date(2023, 12, 1), 1), (date(2024, 1, 1), 2), (date(2024, 2, 1), 3)]


def test_leaderboard(records, labels, tree):
    board = A.exposure_leaderboard(records, labels, tree, RECALLS, evidence_n=1).orderBy("rank").collect()
    assert [(r["rank"], r.recalling_firm, r.exposure_score, r.total_recalls) for r in board] == [(1, "Acme Inc", 5, 2), (2, "Beta Ltd", 5, 2), (3, "Gamma", 1, 1)]
    assert board[0].evidence == ["D-0001-2024"] and board[0].top_reason_node_id == "cgmp_deviation"
    assert A.class_breakdown(records, RECALLS).first().unclassified_recalls == 2


def test_detail(records):
    raw = records.withColumn("raw", F.lit('{"city": "Oslo"}'))
    row = A.record_detail(raw, RECALLS, "D-0001-2024").first()
    assert row.city == "Oslo" and row.recalling_firm == "Acme Inc"
    assert A.record_detail(raw, RECALLS, "' OR 1=1").isEmpty() and A.record_detail(raw, RECALLS, "D-9999-2024").isEmpty()


def test_spec(records, labels, tree):
    t = spec.Tables(records, labels, tree)
    run = lambda q: spec.execute(spec.refine(q), t, RECALLS)
    assert spec.payload(run(spec.QuerySpec(spec.Intent.count_total)))["value"] == 7
    for bad in (
        spec.QuerySpec(spec.Intent.sample), spec.QuerySpec(spec.Intent.count_by), spec.QuerySpec(spec.Intent.trend, taxonomy_node_id="sterility"),
        spec.QuerySpec(spec.Intent.explain_taxonomy_node, taxonomy_node_id="potency"), spec.QuerySpec(spec.Intent.trend, semantic_query="x"),
        spec.QuerySpec(spec.Intent.count_total, (spec.FilterSpec("nope", spec.Op.eq, ("x",)),)),
    ):
        with pytest.raises(ValueError):
            run(bad)
    gone = run(spec.QuerySpec(spec.Intent.parent_group_exposure))
    assert gone.metadata["available"] is False and len(gone.metadata["missing_tables"]) == 4
    tries = []

    def make(q, error):
        tries.append(error)
        return spec.QuerySpec(spec.Intent.count_by, group_by="status" if error else None)

    assert spec.answer("q", make, run).kind == "distribution" and tries[0] is None and "column" in tries[1]


def test_refine():
    q = spec.QuerySpec(spec.Intent.count_total, semantic_query=" glass ", semantic_aliases=("Glass", "shards", "SHARDS ", ""), limit=500)
    assert (spec.refine(q).semantic_aliases, spec.refine(q).limit) == (("shards",), 100)
    assert spec.refine(q, lists_records=True).intent is spec.Intent.sample
    assert spec.refine(spec.QuerySpec(spec.Intent.raw_firm_exposure, semantic_query="x")).exposure_metric is spec.ExposureMetric.severity_weighted
    assert spec.refine(spec.QuerySpec(spec.Intent.count_by_taxonomy, semantic_query="x")).semantic_query is None


@pytest.mark.parametrize(
    ("q", "intent", "columns"),
    [
        ("How many Class I recalls in 2023?", spec.Intent.count_total, ["classification", "report_date"]),
        ("Top 5 companies with the most recalls in California", spec.Intent.raw_firm_exposure, ["state"]),
        ("Which parent companies have the highest severity exposure?", spec.Intent.parent_group_exposure, []),
        ("What is sterility?", spec.Intent.explain_taxonomy_node, []),
        ("How many ongoing class II recalls in Canada?", spec.Intent.count_total, ["classification", "status", "country"]),
        ("How many Class I aspirin recalls?", None, None),
        ("How many Class I recalls since March?", None, None),
        ("How many Class I recalls not ongoing?", None, None),
        ("How many class I recalls in California and Canada?", None, None),
        ("Which firms had the most Class I recalls?", None, None),
        ("How many class I recalls in 2020 and 2021?", None, None),
    ],
)
def test_routers(q, intent, columns):
    got = routers.route(q, [("sterility", "Sterility")])
    assert (got.intent if got else None) is intent
    if got:
        assert [f.column for f in got.filters] == columns


def test_limits():
    assert [routers.limit_of(q) for q in ("top 7", "前十", "top five", "Top 500", "x")] == [7, 10, 5, 100, 20]


def test_numbers():
    assert stats.stratified_indexes(10, 4) == [0, 3, 6, 9] and stats.stratified_indexes(6, 4) == [0, 2, 3, 5] and stats.stratified_indexes(10, 5) == [0, 2, 4, 7, 9]
    assert stats.wilson(8, 10, 100) == (49, 94) and stats.wilson(0, 10, 100) == (0, 28) and stats.wilson(10, 10, 100) == (72, 100) and stats.wilson(0, 0, 5) == (0, 0)


def test_allocation(spark):
    g = spark.createDataFrame([("x", 5), ("y", 3), ("z", 2)], "v string, n long")
    assert {r.v: r.allocated for r in stats.allocate(g, "v", "n", 7).collect()} == {"x": 4, "y": 2, "z": 1}


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_text(spark):
    assert one(spark, text.normalize_text, "  A\n b ") == "a b"
    assert one(spark, text.extract_prefix, "CGMP Deviations: x; y") == "cgmp deviations" and one(spark, text.extract_prefix, "no separator") is None
    assert one(spark, text.slugify, "3 Big--Things!") == "n_3_big_things"
    assert one(spark, lambda c: text.clip(c, 5), "abcdefgh") == "abcd…"
    assert one(spark, text.compact_date, "20230230") is None and one(spark, text.compact_date, "2023011") is None and one(spark, text.compact_date, "20230131") == date(2023, 1, 31)
    assert one(spark, text.ingest_date, "2023-01-31T00:00") == date(2023, 1, 31) and one(spark, text.ingest_date, "x") is None
    pair = spark.createDataFrame([("word", "two words")], "a string, b string")
    assert round(pair.select(N.similarity(F.col("a"), F.col("b"))).first()[0], 6) == 0.363636
    assert one(spark, lambda c: text.trigram_similarity(c, F.lit("words")), "word") == pytest.approx(4 / 7)
    assert N.word_similarity_of("word", "two words") == pytest.approx(0.8)


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Acme Pharmaceuticals, Inc.", "acme pharma"), ("Foo Pvt. Ltd.", "foo pvt ltd"), ("Bar Limited", "bar ltd"), ("Baz U.S.A. L.L.C.", "baz us"), ("The Qux Corp", "qux"), ("Inc.", ""), ("Müller GmbH", "muller gmbh"), ("ACME LABORATORIES & CO", "acme labs &")],
)
def test_names(spark, raw, want):
    assert one(spark, lambda c: N.normalize_name(N.ascii_fold(c)), raw) == want


def test_pairs(spark):
    pairs = [("Acme Inc", "Acme, LLC", "same"), ("Acme Inc", "Acme Ltd", "different"), ("Acme GmbH", "Acme Ltd", "different"), ("Blue Sky Labs", "Sky Blue Labs", "same"), ("Zenith", "Orchid", "different"), ("Acme", "Acme?", "uncertain")]
    out = entities.decide(entities.pair_table(spark, pairs))
    got = {(r.l_raw, r.r_raw): r.decision for r in out.collect()}
    assert got[pairs[0][:2]] == "accepted" and got[pairs[1][:2]] == "rejected" and got[pairs[2][:2]] == "rejected" and got[pairs[3][:2]] == "accepted" and got[pairs[4][:2]] == "rejected"
    c = entities.calibration(out).first()
    assert (c.tp, c.fp, c.fn, c.tn, c.f1) == (2, 0, 0, 3, 1.0)


def test_resolution(spark):
    raw = ["Acme Inc", "ACME, Inc.", "Acme Incorporated", "Acme Ltd", "Beta Labs", "Beta Laboratories", "Inc."]
    rec = spark.createDataFrame([(r,) for r in raw] + [("Acme Inc",)], "firm string")
    names = entities.load_names(rec, "firm")
    decided = entities.decide(entities.candidate_pairs(names))
    rows = entities.clusters(names, decided).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.cluster, set()).add(r.raw)
    assert {frozenset(g) for g in groups.values()} == {frozenset(raw[:3]), frozenset(raw[3:4]), frozenset(raw[4:6])}
    assert {r.canonical for r in rows if r.raw in raw[:3]} == {"Acme Inc"}
    assert [r.input_value for r in entities.log_rows(names, decided).where("status = 'skipped'").collect()] == ["Inc."]
    firms = spark.createDataFrame([], "id long, canonical_name string, normalized_name string, confidence decimal(5,4)")
    empty = spark.createDataFrame([], "raw_firm string, firm_id long, normalized_raw_firm string, record_count int, confidence decimal(5,4)")
    clustered = entities.clusters(names, decided)
    assert entities.merged_firms(clustered, firms).count() == 3
    merged = entities.merged_aliases(clustered, empty)
    assert merged.count() == 6 and merged.select("firm_id").distinct().count() == 3


def edge(firm, parent, tier="external", source="external", status="confirmed", active=True, day="2024-01-01", conf=0.5):
    return (firm, parent, tier, source, "n", "s", date.fromisoformat(day), status, active, conf)


EDGE = "firm_id long, parent_group_id long, provenance_tier string, source string, source_name string, source_id string, as_of_date date, review_status string, active boolean, confidence double"


def test_edges(spark, records):
    old = spark.createDataFrame([edge(1, 1), edge(2, 1), edge(3, 1, status="needs_review"), edge(4, 2, status="superseded", active=False)], EDGE)
    new = spark.createDataFrame([edge(1, 1, conf=0.9), edge(2, 2), edge(4, 2)], EDGE)
    got = {(r.firm_id, r.parent_group_id): (r.review_status, r.active, r.confidence) for r in parents.write_edges(old, new).collect()}
    assert got[1, 1] == ("confirmed", True, 0.9) and got[2, 1][:2] == ("superseded", False) and got[2, 2][:2] == ("confirmed", True)
    assert got[3, 1][:2] == ("needs_review", True) and got[4, 2][:2] == ("confirmed", True)
    bad = spark.createDataFrame([edge(1, 1), edge(1, 2), edge(2, 1, "unknown", "external"), edge(3, 1, source="llm")], EDGE)
    assert {r.firm_id for r in parents.edge_problems(bad).collect()} == {1, 2, 3} and parents.edge_problems(old).isEmpty()


def test_mapping_states(spark, records):
    aliases = spark.createDataFrame([("Acme Inc", 1, 2), ("Beta Ltd", 2, 2), ("Gamma", 3, 1)], "raw_firm string, firm_id long, record_count int")
    rows = spark.createDataFrame([edge(1, 1), edge(2, 1, "unknown", "unknown"), edge(3, 1, source="llm")], EDGE)
    got = parents.mapping_status(records, aliases, rows, RECALLS)
    assert {(r.id, r.mapping_status) for r in got.collect()} == {(1, "mapped"), (2, "mapped"), (3, "unknown_parent_edge"), (4, "unknown_parent_edge"), (7, "llm_only_parent_edge")}
    c = parents.coverage(got, "recalling_firm").first()
    assert (c.mapped_recalls, c.excluded_recalls, c.excluded_raw_firms) == (2, 3, 2)


def test_seeds(spark, tmp_path):
    one_seed = '{"parent_group": "P", "firm_names": ["Acme", "Nobody"], "provenance_tier": "external", "source": "external", "source_name": "n", "source_id": "7", "as_of_date": "20240102", "confidence": 0.9}'
    for i, body in enumerate((f"[{one_seed}]", '{"edges": [' + one_seed + "]}", one_seed + "\n")):
        path = tmp_path / f"{i}.json"
        path.write_text(body)
        seeds = ingest.read_seeds(spark, str(path))
        assert seeds.count() == 2 and seeds.where(parents.seed_problem().isNotNull()).isEmpty()
        firms = spark.createDataFrame([(1, "Acme", "acme")], "id long, canonical_name string, normalized_name string")
        aliases = spark.createDataFrame([("ACME Inc", 1, "acme")], "raw_firm string, firm_id long, normalized_raw_firm string")
        out = parents.resolve_seeds(seeds.withColumn("normalized_firm_name", F.lower("firm_name")), firms, aliases)
        assert {(r.firm_name, r.outcome) for r in out.collect()} == {("Acme", "resolved"), ("Nobody", "unresolved")}


def test_taxonomy(spark, tree, records, labels):
    assert tree.count() == 24 and T.problems(tree).isEmpty() and len(T.RULES) == 18
    bad = spark.createDataFrame([("v1", "a", None, "A", "", [], 1, "active"), ("v1", "b", "zzz", "A", "", [], 1, "active")], T.NODE)
    assert {(r.node_id, r.problem) for r in T.problems(bad).collect()} >= {("a", "roots are of level 0"), ("b", "unknown parent"), ("a", "several nodes with this label")}
    assert {r.node_id for r in T.subtree(tree, "labeling_and_packaging").collect()} == {"labeling_and_packaging", "label_error", "label_mixup", "container_defect"}
    c = T.coverage(records, labels, "id").first()
    assert (c.total_records, c.labelled_records, c.unlabelled_records, c.coverage) == (7, 4, 3, 0.5714)
    assert ids(T.residual(records, labels, "id", "rules")) == [2, 4, 5, 6, 7]
    marks = {(r.record_id, r.node_id) for r in T.rule_labels(records, "reason_for_recall", "id").collect()}
    assert marks == {("1", "sterility"), ("3", "sterility"), ("2", "cgmp_deviation"), ("5", "label_mixup")}
    assert T.distinct_texts(records, "reason_for_recall", "id").where("records = 2").count() == 1


def test_model_labels(spark, tree):
    texts = spark.createDataFrame([("h1", "a"), ("h2", "b"), ("h3", "c")], "text_hash string, text string")
    cache = spark.createDataFrame([("h1", "potency", 0.5)], "text_hash string, node_id string, confidence double")

    def client(t):
        if t == "c":
            raise RuntimeError("down")
        return [("nonsense", 0.9)]

    answers, misses = T.model_labels(texts, client, cache)
    assert {r.text_hash for r in misses.collect()} == {"h2", "h3"}
    assert {(r.text_hash, r.node_id) for r in T.guarded(answers, tree).collect()} == {("h1", "potency"), ("h2", "other")}


def test_fusion(spark):
    v = spark.createDataFrame([("a", "f", 0.1, 1), ("b", "f", 0.2, 2)], "source_id string, field string, dist double, rank int")
    t = spark.createDataFrame([("b", "f", 3.0, 0.2, 1), ("c", "f", 2.0, 1.0, 2)], "source_id string, field string, score double, dist double, rank int")
    got = [(r.source_id, round(r.score, 9)) for r in retrieval.fuse(v, t, 10).collect()]
    assert got == [("b", round(1 / 62 + 1 / 61, 9)), ("a", round(1 / 61, 9)), ("c", round(1 / 62, 9))]
    x = spark.createDataFrame([("x", "f", 3.0, 1.0, 1), ("y", "f", 2.0, 1.0, 2)], t.schema)
    chained = retrieval.chained([x, x.where("source_id = 'x'")])
    assert sorted((r.source_id, r["rank"]) for r in chained.collect()) == [("x", 1), ("x", 3), ("y", 2)]


def test_full_text(spark):
    assert [fulltext.stem(w) for w in ("recalls", "sterility", "running", "happily", "national", "agreed", "skies", "controlled")] == ["recal", "steril", "run", "happili", "nation", "agre", "sky", "control"]
    assert fulltext.broad_queries("Glass in the vials", ["shards"]) == ["glass in the vials", "shards", "glass OR vials"]
    docs = spark.createDataFrame([("1", "f", "the glass vial was broken"), ("2", "f", "glass here and much later a vial"), ("3", "f", "nothing")], "source_id string, field string, text string")
    post = fulltext.positions(docs, ["source_id", "field"], "text")
    got = {r.source_id: r["rank"] for r in fulltext.search(post, ["source_id", "field"], "vials glass", "source_id string, field string").collect()}
    assert set(got) == {"1", "2"} and got["1"] > got["2"]
    assert {r.source_id for r in fulltext.search(post, ["source_id", "field"], "glass-vial", "source_id string, field string").collect()} == {"1"}
    assert fulltext.search(post, ["source_id", "field"], "the", "source_id string, field string").isEmpty()


def test_search_modes(spark):
    docs = spark.createDataFrame([("1", "f", "glass vial", [1.0, 0.0]), ("2", "f", "other words", [0.0, 1.0])], "source_id string, field string, text string, embedding array<float>")
    post = fulltext.positions(docs, ["source_id", "field"], "text")
    both = retrieval.search(docs, post, "glass", 5, lambda q: [0.0, 1.0])
    assert both.mode == "hybrid" and both.hits.count() == 2

    def down(q):
        raise retrieval.provider_error("timeout", "slow")

    alone = retrieval.search(docs, post, "glass", 5, down)
    assert alone.mode == "fts_only" and [r.source_id for r in alone.hits.collect()] == ["1"] and "timeout" in alone.fallback_reason

    def refused(q):
        raise retrieval.provider_error("authentication")

    with pytest.raises(retrieval.ProviderError):
        retrieval.search(docs, post, "glass", 5, refused)
    assert retrieval.search(docs, post, "glass", 0, down).hits.isEmpty()


def test_semantic(spark):
    hits = spark.createDataFrame([(str(i), "f", "broken glass" if i % 2 else "fine", 0.9 if i else 0.1, i + 1) for i in range(10)], "source_id string, field string, content string, retrieval_score double, rank int")
    judged, n = semantic.validated(hits, semantic.lexical_judge("glass"), limits=semantic.Limits(validated=4))
    row = semantic.estimate(judged, n).first()
    assert n == 9 and row.validated_count == 4 and row.estimated_count == round(row.verified_count / 4 * 9)
    with pytest.raises(ValueError):
        semantic.validated(hits, lambda s: semantic.lexical_judge("glass")(s).limit(1))


def test_evaluation(spark):
    returned = spark.createDataFrame([("q", "a", 1), ("q", "x", 2), ("q", "b", 3), ("q", "a", 4)], "case_id string, id string, rank int")
    expected = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "z")], "case_id string, id string")
    got = {r.case_id: r for r in evaluation.retrieval_metrics(returned, expected).collect()}
    assert got["q"].recall_at_k == 1.0 and got["q"].mrr_at_k == 1.0 and got["q"].ndcg_at_k == pytest.approx(0.919721, abs=1e-6) and got["r"].ndcg_at_k == 0.0
    a = spark.range(10).withColumn("x", F.lit(None).cast("string"))
    same = evaluation.fingerprint(a.repartition(3), "id").first()
    assert same == evaluation.fingerprint(a, "id").first() and same.digest != evaluation.fingerprint(a.union(a.limit(1)), "id").first().digest


def test_paged_source(spark, tmp_path):
    import json

    (tmp_path / "p.json").write_text(json.dumps({"results": [{"recall_number": f"D-{i}", "report_date": f"202401{i:02d}"} for i in range(1, 29)]}))
    spark.dataSource.register(ingest.PagedSource)
    rows = spark.read.format("paged_records").option("folder", str(tmp_path)).option("since", "2024-01-05").option("until", "2024-01-20").option("days", "7").load()
    raw = ingest.as_raw(rows, "drug")
    assert raw.count() == 16 and rows.rdd.getNumPartitions() == 3
    assert ingest.parsed(raw).where("recall_number = 'D-7'").first().report_date == date(2024, 1, 7)


def test_paging_rules():
    calls, waits = [], []

    def get(search, skip, limit):
        calls.append(skip)
        if len(calls) < 3:
            raise ingest.HttpError(429, 7 if len(calls) == 1 else None)
        return [{}] * (1000 if skip == 0 else 3)

    assert len(list(ingest.pages(get, None, waits.append))) == 1003 and waits == [7, 2.0] and calls == [0, 0, 0, 1000]
    with pytest.raises(ValueError):
        ingest.fetch_page(get, None, 26_000)

    def gone(*a):
        raise ingest.HttpError(404)

    assert ingest.fetch_page(gone, None, 0) == []
    assert ingest.build_search("a:1", "d", date(2024, 1, 1), date(2024, 2, 1)) == "(a:1) AND d:[20240101 TO 20240201]"


def test_upsert_and_stream(spark, tmp_path):
    from sparkledger.streaming import updates

    schema = "id string, v int, fetched_at timestamp"
    a = spark.createDataFrame([("x", 1)], "id string, v int").withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    b = spark.createDataFrame([("x", 2), ("y", 3)], "id string, v int").withColumn("fetched_at", F.lit("2024-01-02").cast("timestamp"))
    assert {(r.id, r.v) for r in ingest.upsert(a, b).collect()} == {("x", 2), ("y", 3)} == {(r.id, r.v) for r in ingest.upsert(b, a).collect()}
    for i, part in enumerate((a, b)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        updates.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert updates.current(spark, str(tmp_path / "out")).count() == i + 1
    assert updates.windowed_counts(b, "fetched_at", "id").count() == 2


def test_schema_context(records):
    noted = with_comments(records, {"status": "state of the recall"})
    assert ("status", "dimension", "state of the recall") in schema_context(noted, RECALLS)


def test_plans_stay_pushed_down(spark):
    """Filters and columns reach the scan, and counts are combined before the shuffle."""
    from sparkledger import bindings as B

    plan = A.count_total(B.records(spark, "/root/testdata/sf0.001"), B.ORDERS, [Filter("status", "eq", "F")])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan and "partial_count" in plan


def test_gate():
    assert gate.decide("  ", None).reason == "empty_question" and gate.closing(gate.decide("", None))["kind"] == "clarification"
    inside = gate.decide("How many?", lambda q: {"route": "in_domain", "message": "ignored"})
    assert (inside.reason, inside.message, gate.closing(inside)) == ("llm_in_domain", "", None)
    out = gate.closing(gate.decide("weather", lambda q: {"route": "out_of_domain", "reason": "weather", "suggestions": [" a ", "", "b", "c", "d"]}))
    assert (out["kind"], out["suggestions"], out["message"]) == ("message", ["a", "b", "c"], gate.MESSAGES["out_of_domain"])
    assert gate.decide("hi", lambda q: {"route": "chitchat_meta", "message": "Hello."}).message == "Hello."
    with pytest.raises(ValueError, match="unknown route"):
        gate.decide("x", lambda q: {"route": "elsewhere"})
    with pytest.raises(RuntimeError):
        gate.decide("x", lambda q: (_ for _ in ()).throw(RuntimeError("down")))


def test_response_metadata():
    of = evaluation.response_metadata
    assert of(None, "abc", "m", "p") == {"data_kind": None, "summary_chars": 3, "provider": "p", "model": "m"}
    assert of({"kind": "distribution", "groups": [1, 2]}, "")["result_count"] == 2
    got = of({"kind": "semantic_count", "evidence_items": [1], "estimated_count": 7, "verified_count": None, "degraded": True, "retrieval_mode": "fts_only"})
    assert got == {"data_kind": "semantic_count", "summary_chars": 0, "result_count": 1, "estimated_count": 7, "retrieval_mode": "fts_only", "degraded": True}
    many = of({"kind": "multi_section", "sections": [{"id": "a", "items": [1, 2]}, {"id": "b", "rows": [1]}, {"id": "c"}]})
    assert (many["section_count"], many["result_count"], [s["result_count"] for s in many["sections"]]) == (3, 3, [2, 1, 0])
    assert of({"kind": "message", "suggestions": [], "route": "out_of_domain", "reason": "r"})["route"] == "out_of_domain"


def test_search_request():
    raw = [{"column": "status", "op": "eq", "values": ["x"]}]
    assert evaluation.search_request("q", "both", 5, [" a", "", "a"], raw) == {"query": "q", "field": "both", "k": 5, "aliases": ["a"], "filters": {"items": raw}}
    assert evaluation.search_request("q", "both", 5, [], raw, rejected=True)["filters"] == {"items": [], "valid": False, "omitted_raw": True}
    assert evaluation.provider_status(llm=("a", "b", True), embedding=(None, None, False))["embedding_configured"] is False


def test_traces(spark, tmp_path):
    path = str(tmp_path / "log")
    ids = evaluation.trace(spark, path, [{"question": "a", "ms": 1}, {"question": "b", "ms": None}], "question string, ms long")
    ids += evaluation.trace(spark, path, [{"question": "c", "ms": 3}], "question string, ms long")
    assert {r.trace_id: r.question for r in spark.read.json(path).collect()} == dict(zip(ids, "abc", strict=True))


def test_label_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert T.read_label_cache(spark, path).isEmpty()
    key = T.cache_key(F.lit("v1"), "digest", "model", F.col("text_hash"))
    make = lambda rows: spark.createDataFrame(rows, "text_hash string, node_id string, confidence double")
    T.append_label_cache(make([("h1", "a", 0.5), ("h1", "b", 0.4), ("h2", "a", 0.9)]), path, key)
    T.append_label_cache(make([("h2", "c", 0.1)]), path, key)
    cache = T.read_label_cache(spark, path)
    assert sorted((r.text_hash, r.node_id) for r in cache.collect()) == [("h1", "a"), ("h1", "b"), ("h2", "c")]
    texts = make([("h1", "", 0.0), ("h3", "", 0.0)]).withColumn("text", F.lit("t"))
    answers, misses = T.model_labels(texts, lambda t: [("z", 1.0)], cache.where("text_hash = 'h1'"))
    assert [r.text_hash for r in misses.collect()] == ["h3"] and answers.count() == 3


def test_frozen_reasons(spark, records):
    tree = recall_reasons.frozen(spark)
    assert (tree.count(), tree.where("level = 0").count(), T.problems(tree).isEmpty()) == (24, 6, True)
    assert len(recall_reasons.RULES) == 18 and recall_reasons.unknown_nodes(tree) == []
    assert recall_reasons.unknown_nodes(tree.where("node_id NOT IN ('other', 'labeling_error')")) == ["labeling_error", "other"]
    got = {(r.record_id, r.node_id, float(r.confidence)) for r in recall_reasons.labels(records, "reason_for_recall", "id").collect()}
    assert got == {("1", "other", 0.0), ("3", "other", 0.0), ("2", "cgmp_deviation", 0.92), ("5", "other", 0.0), ("7", "other", 0.0)}


def test_text_groups(spark, records):
    dates = {r.text: (r.records, r.first_date, r.last_date) for r in T.text_dates(records, "reason_for_recall", "recall_initiation_date").collect()}
    assert dates["lack of  STERILITY"] == (1, None, None) and " " not in dates and len(dates) == 5
    rows = spark.createDataFrame([("hot", i) for i in range(1000)] + [("cold", 7), ("cold", None), (None, 1), (" ", 2)], "t string, id long")
    lists = T.text_members(rows, "t", "id", part_rows=100).collect()
    hot = [r for r in lists if r.text == "hot"]
    assert sorted(i for r in hot for i in r.record_ids) == list(range(1000)) and max(len(r.record_ids) for r in hot) < 200
    assert all(r.record_ids == sorted(r.record_ids) and (r.records, r.parts) == (1000, 10) for r in hot)
    assert [(r.records, r.record_ids) for r in lists if r.text == "cold"] == [(2, [7])]


def test_exposure_section(spark):
    rows = spark.createDataFrame([(1, "P", 5, 9, ["D-1"])], "parent_group_id long, parent_group_name string, total_recalls long, exposure_score long, evidence array<string>")
    a = spec.Answer("raw_firm_exposure", rows, {"available": True})
    data = spec.exposure_section(a, spec.ExposureMetric.recall_count)
    (item,) = data["sections"][0]["items"]
    assert (item["value"], item["count"], item["evidence"], item["metadata"]["primary_metric"]) == ("P", 5, ["D-1"], "recall_count")
    assert spec.exposure_section(a)["sections"][0]["items"][0]["count"] == 9
    assert evaluation.response_metadata(data)["result_count"] == 1
    assert spec.exposure_section(spec.Answer("raw_firm_exposure", None, {"available": False}))["sections"][0]["items"] == []


def test_upserted_parts(spark, tmp_path):
    """A batch rewrites the parts it touches, and versions that no manifest needs go."""
    schema, out = "id long, v long, fetched_at timestamp", str(tmp_path / "out")
    want = {}
    for i in range(4):
        keys = range(50) if i == 0 else [i, 100 + i]
        rows = [(k, i, datetime(2024, 1, 1 + i)) for k in keys] + [(0, 99, datetime(2023, 1, 1))]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        updates.upsert_stream(stream, out, str(tmp_path / "check"), parts=16).awaitTermination()
        want |= dict.fromkeys(keys, i)
        table = updates.current(spark, out)
        assert {r.id: r.v for r in table.collect()} == want and table.columns == ["id", "v", "fetched_at"]
    manifests = sorted(p.name for p in (tmp_path / "out").glob("m*"))
    assert manifests == ["m000000000002", "m000000000003"]
    first = [p for p in (tmp_path / "out" / "v000000000000").glob("_part=*")]
    assert 0 < len(first) < 16 and {r.v for r in updates.current(spark, out, 3).collect()} == {0, 1, 2}


def test_stored_embeddings(spark, tmp_path):
    """Each commit is kept: a run that breaks off is taken up again, and changed texts are embedded anew."""
    path, asked = str(tmp_path / "index"), spark.sparkContext.accumulator(0)
    make = lambda rows: spark.createDataFrame([("s", str(i), "f", t) for i, t in rows], "source string, source_id string, field string, content string")

    def embed(texts):
        asked.add(len(texts))
        if any(t == "bad" for t in texts):
            raise RuntimeError("provider down")
        return [[float(len(t))] for t in texts]

    rows = [(i, "t" * (i + 1)) for i in range(40)]
    texts = make([*rows, (40, "bad"), (41, " ")])
    with pytest.raises(Exception, match="provider down"):
        ingest.store_pending(texts, path, embed, per_commit=4)
    done = ingest.stored_index(spark, path).count()
    assert 0 < done < 40
    assert ingest.store_pending(make(rows), path, embed, per_commit=10) == 40 - done
    assert ingest.store_pending(make(rows), path, embed) == 0
    assert ingest.store_pending(make([(0, "changed"), *rows[1:]]), path, embed) == 1
    index = {r.source_id: list(r.embedding) for r in ingest.stored_index(spark, path).collect()}
    assert len(index) == 40 and index["0"] == [7.0] and index["5"] == [6.0]


def test_live_pages(spark):
    """Pages over HTTP: not found is empty, a busy source is asked again."""
    import http.server
    import json
    import threading
    import urllib.parse

    seen = []

    class Source(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            seen.append(q)
            month = q["search"].split("[")[1][4:6]
            state = 429 if len(seen) == 1 else 404 if month == "02" else 200
            self.send_response(state)
            self.send_header("Retry-After", "0")
            self.end_headers()
            if state == 200:
                self.wfile.write(json.dumps({"results": [{"recall_number": f"D-{i}"} for i in range(int(q["skip"]), min(1500, int(q["skip"]) + int(q["limit"])))]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Source)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(ingest.PagedSource)
        rows = spark.read.format("paged_records").option("url", f"http://127.0.0.1:{server.server_port}/x.json").option("api_key", "k").option("since", "2024-01-01").option("until", "2024-02-10").load()
        assert rows.count() == 1500
    finally:
        server.shutdown()
    assert all(q["api_key"] == "k" and q["search"].startswith("report_date:[2024") for q in seen) and {q["skip"] for q in seen} == {"0", "1000"}
    with pytest.raises(Exception, match="either url or folder"):
        spark.read.format("paged_records").option("since", "2024-01-01").option("until", "2024-02-10").load().count()
