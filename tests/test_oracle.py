"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import numpy as np
import pytest

from sparkledger import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    if name not in queries.ORACLE:
        return
    got = duck.execute(queries.ORACLE[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    assert rows == sorted(([plain(r[names.index(c)]) for c in cols] for r in got.fetchall()), key=repr)


def test_connected_links(spark):
    """Every link of lineitem takes part, against union-find."""
    links = {(r.l_partkey, r.l_suppkey + 100_000_000_000) for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()}
    parent = {n: n for e in links for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert {r.node: r.root for r in queries.QUERIES["connected_links"](spark, SF).collect()} == {n: find(n) for n in parent}


@pytest.mark.parametrize("name", ["vector_topk", "vector_topk_filtered"])
def test_vector_topk_ties(spark, tmp_path, name):
    """More than 20 distances that look equal at five places, among them such as differ in their last bits only."""
    rng = np.random.default_rng(5)
    way = rng.normal(size=64)
    vectors = [way * (1 + i / 97) for i in range(300)] + [way + 1e-4 * rng.normal(size=64) for _ in range(100)] + [rng.normal(size=64) for _ in range(50)]
    for case, vectors in (("one way", vectors), ("near", [way] + [way + 0.02 * rng.normal(size=64) for _ in range(2000)])):
        path = str(tmp_path / case.replace(" ", "_"))
        spark.createDataFrame([(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
        spark.createDataFrame([(i, "en") for i in range(len(vectors))], "doc_id long, lang string").coalesce(1).write.parquet(f"{path}/documents.parquet")
        con = duckdb.connect()
        for t in ("embeddings", "documents"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
        want = [tuple(map(str, r)) for r in con.execute(queries.ORACLE[name]).fetchall()]
        got = [tuple(map(str, r)) for r in queries.QUERIES[name](spark, path).select("source_id", "dist", "rank").collect()]
        assert sorted(got) == sorted(want) and len(got) == 20
