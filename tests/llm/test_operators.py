"""Operators against brute force, exact round trips and held-out accuracy, with the awkward rows that each must bear."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from sparkledger.llm import brown, hilbert, imatch, lengths, mixing, packing, similar, simhash, topk, toxicity, warc  # noqa: E402
from sparkledger.llm.base import connected_components, crc_bucket  # noqa: E402
from sparkledger.llm.tokens import encoder  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, id string, part string, sequence_id string"
LONG = " ".join(f"word{i % 900} and" for i in range(9000))
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog again"), (2, "the quick brown fox jumps over the lazy dog again"), (3, None), (4, ""), (5, "  \n\t "), (6, LONG), (7, LONG + " end"),
    (8, "Élan vital — naïve café 日本語 <|endoftext|> x"), (9, "one"), (None, "a row without an id"), (None, "a row without an id"), (2, "the quick brown fox jumps over the lazy dog again"),
    (11, "you utter idiot and worthless clown"), (12, "\x00\x0b odd \x1f controls\r\nhere"), (13, "THE QUICK brown fox jumps over the lazy dog again"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if k % 3 else "en", None if k % 4 else "s", None if t is None else len(t), "clash", "clash", "clash", "clash") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- tokens, lengths, packing --------------------------------------------------------------------------------------------


def test_token_ids():
    e = encoder(PATH)
    assert e.fast is not None
    for t in [t for _, t in TEXTS if t] + ["a  b\n c", " \n x", "it's we'll ²½", "a" * 5000, "<|endoftext|>"]:
        assert e.ids(t).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
    assert len(e.ids(None)) == len(e.ids("")) == 0


def test_lengths(spark, docs, empty):
    e = encoder(PATH)
    want = Counter(len(e.tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in TEXTS)
    hist = lengths.histogram(docs, PATH)
    assert {r.length: r.documents for r in hist.collect()} == want
    every = sorted(want.elements())
    for r in lengths.suffix_sums(hist).collect():
        assert r.truncated_total == sum(min(x, r.length) for x in every) and r.documents_over == sum(x > r.length for x in every)
        assert r.tokens_over == sum(x for x in every if x > r.length) and r.tokens_within + r.tokens_over == sum(every) and r.lost_tokens == sum(every) - r.truncated_total
    for r in lengths.at_limits(hist, [0, 7, 5000, 10**6]).collect():
        assert r.truncated_total == sum(min(x, r.context_limit) for x in every) and r.documents_within == sum(x <= r.context_limit for x in every)
    assert {r.share: r.length for r in lengths.quantiles(hist, [0.5, 1.0]).collect()} == {0.5: every[math.ceil(len(every) / 2) - 1], 1.0: every[-1]}
    assert lengths.suffix_sums(lengths.histogram(empty, PATH)).count() == 0 and lengths.at_limits(lengths.histogram(empty, PATH), [5]).first().truncated_total == 0


def checked_packing(rows, texts, capacity):
    """Pieces cover their documents, sequences are gapless and no longer than allowed; their number."""
    tok = encoder(PATH).tokenizer
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    want = defaultdict(Counter)
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(itertools.pairwise(cuts)):
            want[i][p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert {i: Counter((r.piece, r.start, r.length, r.ids_crc32) for r in rs) for i, rs in by_doc.items()} == want
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(docs, empty, capacity):
    rows = packing.pack_documents(docs, PATH, capacity).collect()
    checked_packing(rows, TEXTS, capacity)
    assert packing.pack_documents(empty, PATH, capacity).count() == 0


def test_packing_levels(spark):
    """Small chunks force several levels; the number of sequences stays near the bound."""
    rng = np.random.default_rng(3)
    rows = [(int(i), 0, 0, int(n), 7) for i, n in enumerate(rng.integers(1, 100, 3000))]
    items = spark.createDataFrame(rows, "id long, piece int, start long, length long, ids_crc32 long").repartition(5)
    got = packing.pack(items, 100, slack=1, chunk=200).collect()
    assert sorted((r.id, r.length) for r in got) == sorted((r[0], r[3]) for r in rows)
    fills = Counter()
    for r in got:
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 100 and len(fills) <= 1.03 * math.ceil(sum(r[3] for r in rows) / 100)
    same = spark.createDataFrame([(i, 0, 0, 60, 7) for i in range(900)], items.schema)  # none fits with another
    assert packing.pack(same, 100, chunk=100).select("sequence_id").distinct().count() == 900


def test_best_fit():
    sizes = np.array([50, 50, 60, 40, 100, 1])
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(6)) and len(bins) == 4 and all(sizes[b].sum() <= 100 for b in bins)


# -- SimHash -------------------------------------------------------------------------------------------------------------


def plain_simhash(text):
    toks = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not toks:
        return 0
    grams = [" ".join(toks[i : i + 4]) for i in range(max(1, len(toks) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(spark, docs, empty):
    rows = simhash.components(docs).collect()
    assert len(rows) == len(TEXTS)
    want = Counter((i, plain_simhash(t)) for i, t in TEXTS)
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in rows) == want
    fps = sorted({f for _, f in want})
    comp = plain_components([(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4], fps)
    least = {}
    for (i, f), _ in want.items():
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    for r in rows:
        assert r.component_id == least.get(comp[r.fp & (1 << 64) - 1])
    assert simhash.components(empty).count() == 0
    kept = simhash.one_per_component(docs).collect()
    assert len(kept) == len(set(comp.values())) and set(kept[0].asDict()) == set(docs.columns)
    assert sorted(r.doc_id for r in kept if r.doc_id) == sorted(least.values())
    assert simhash.one_per_component(empty).count() == 0


@pytest.mark.parametrize(("distance", "run_limit"), [(4, 2000), (4, 40), (2, 40), (0, 2000)])
def test_links(spark, distance, run_limit):
    """Random, chained and densely packed fingerprints: components as all pairs give them."""
    rng = np.random.default_rng(distance)
    base = [int(x) for x in rng.integers(0, 1 << 63, 150)]
    fps = set(base)
    for x, most in [(b, 6) for b in base[:40] for _ in range(6)] + [(base[-1], 4)] * 250:
        for bit in rng.choice(64, rng.integers(1, most + 1), replace=False):
            x ^= 1 << int(bit)
        fps.add(x)
    fps = sorted(fps)
    want = plain_components([(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= distance], fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    got = connected_components(simhash.links(df, distance, run_limit)).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.root].add(r.node & (1 << 64) - 1)
    true = defaultdict(set)
    for n, root in want.items():
        true[root].add(n)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in true.values() if len(g) > 1}


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 8), (9, 9), (20, 10), (10, 15), (None, 3), (3, 1)] + [(100, 100 + i) for i in range(1, 60)] + [(200 + i, 201 + i) for i in range(40)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None]
    assert got == plain_components(real, {n for e in real for n in e})
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_similar(texts, least=0.8):
    """Pairs of places whose sets of five-word runs reach the similarity."""
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in (brown.words(t) for t in texts)]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s or [None]:
            holders[g].append(i)
    met = {p for h in holders.values() for p in itertools.combinations(h, 2)}
    return [(a, b) for a, b in met if sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least]


def test_similar(spark, docs, empty):
    """Near copies between similarity 0.7 and 1, a large group of them included, against all pairs."""
    rng = np.random.default_rng(8)
    base = [[f"w{x}" for x in rng.integers(0, 5000, n)] for n in (120, 300, 700, 150)]
    rows = list(TEXTS)
    for k, copies, changed in ((0, 40, 2), (1, 40, 6), (2, 40, 16), (3, 250, 1)):
        for _ in range(copies):
            t = list(base[k])
            for at in rng.choice(len(t), changed, replace=False):
                t[at] = f"x{rng.integers(0, 10**6)}"
            rows.append((100 + len(rows), " ".join(t)))
    near = plain_similar([t for _, t in rows])
    comp = plain_components(near, range(len(rows)))
    bits = [plain_simhash(t) for _, t in rows]
    assert sum((bits[a] ^ bits[b]).bit_count() > 4 for a, b in near) > 100  # what four bits alone would miss
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[comp[k]] = min(i, least.get(comp[k], i))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter((r.doc_id, r.component_id) for r in similar.components(df).collect()) == Counter((i, least.get(comp[k])) for k, (i, _) in enumerate(rows))
    kept = simhash.one_per_component(df, words=5, least=0.8).collect()
    assert len(kept) == len(set(comp.values())) and sorted(r.doc_id for r in kept if r.doc_id) == sorted(least.values())
    assert simhash.one_per_component(empty, words=5, least=0.8).count() == 0 and simhash.one_per_component(docs, words=5, least=0.8).columns == docs.columns


@pytest.mark.parametrize("block", [4096, 16])
def test_similar_links(spark, block):
    """One band that all texts share, leads that few are similar to: components as all pairs give them, whatever the blocks."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(90):
        t = list(base)
        for at in rng.choice(120, 1 + k % 9, replace=False):
            t[at] = f"x{rng.integers(0, 6)}{at // 20}"
        texts.append(" ".join(t))
    texts = sorted(set(texts))
    near = plain_similar(texts)
    want = plain_components(near, range(len(texts)))
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, t string")
    found = similar.links(nodes, nodes.select(F.lit(1).cast("long").alias("k"), "node"), 0.8, 5, block)
    assert {tuple(sorted((r.a, r.b))) for r in found.collect()} <= {tuple(sorted(p)) for p in near}
    got = {r.node: r.root for r in connected_components(found).collect()}
    assert {i: got.get(i, i) for i in want} == want and len(set(want.values())) > 5


def test_similar_links_from_fingerprints(spark):
    """Pairs that the byte-position index gives link if they reach the similarity, without a band in common."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join([*base, "more"]), " ".join(rng.permutation(base)), "a b c d e f", "g h i j k l"]
    fps = [plain_simhash(" ".join(base)) ^ (1 << k) - 1 for k in (0, 4, 1, 0, 63)]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, t string")
    found = similar.links(nodes, nodes.select(F.col("node").alias("k"), "node"), 0.8, 5, fps=spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "node long, fp long"))
    assert {tuple(sorted((r.a, r.b))) for r in found.collect()} == {(0, 1)}


def test_similar_rest_stays_small(spark):
    """Many pairs of a band that reach the similarity and not its lead: the worker hands on links that join them, not the pairs."""
    base = [[f"{c}{i}" for i in range(300)] for c in "ab"]
    texts = [" ".join(base[0])] + [" ".join([*base[1], f"end{i}"]) for i in range(120)]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, t string")
    found = similar.links(nodes, nodes.select(F.lit(1).cast("long").alias("k"), "node"), 0.8, 5)
    got = {r.node: r.root for r in connected_components(found).collect()}
    assert found.count() == 119 and got == {i: 1 for i in range(1, 121)}


def test_similar_bound():
    """The bound never rules out a pair that reaches the similarity, also where maps are full."""
    rng = np.random.default_rng(10)
    for size in (40, 3000):
        lead = rng.integers(0, 1 << 63, size, np.uint64)
        pool = rng.integers(0, 1 << 63, size // 2, np.uint64)
        sets = [np.unique(np.concatenate((rng.choice(lead, int(size * rng.uniform(0.6, 1)), replace=False), rng.choice(pool, int(size * rng.uniform(0, 0.3)), replace=False)))) for _ in range(60)]
        lead = np.unique(lead)
        batch = pa.RecordBatch.from_pydict({"a": [0] * 60, "b": range(60), "sa": [lead.view(np.int64)] * 60, "sb": [s.view(np.int64) for s in sets]})
        got = next(similar._measured(iter([batch])))
        nb, n = (np.array(got.column(c), np.int64) for c in ("nb", "n"))
        lacks, adds = (np.frombuffer(b"".join(got.column(c).to_pylist()), np.uint64).reshape(60, -1) for c in ("lacks", "adds"))
        assert n.tolist() == [len(set(s.tolist()) & set(lead.tolist())) for s in sets]
        kept = 0
        for i in range(60):
            others = np.arange(i + 1, 60)
            may = set(similar._may_reach(i, others, len(lead), nb, n, lacks, adds, 0.8).tolist())
            kept += len(may)
            for j in others.tolist():
                x, y = set(sets[i].tolist()), set(sets[j].tolist())
                assert j in may or len(x & y) / len(x | y) < 0.8
        assert size > 40 or kept < 1000


def test_pipeline_near_duplicates(spark):
    """The stage leaves one document of each component of five-word similarity 0.8 or more."""
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    comp = plain_components([tuple(sorted((rows[a].doc_id, rows[b].doc_id))) for a, b in plain_similar([r.text for r in rows])], [r.doc_id for r in rows])
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect()) == sorted(set(comp.values()))


# -- WARC ----------------------------------------------------------------------------------------------------------------


def test_warc(spark):
    trick = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n"
    pages = [(1, "u", None), (2, None, ""), (3, "u\r\nX: y", trick), (4, "u", trick), (5, "u", "WARC/1.1\r\n"), (6, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc" * 400), (7, "u", "é" * 40000), (8, "u", "\r\n\r\n"), (9, "v", "é" * 40000)]
    pages += [(10 + i, "w", f"page {i}\r\nWARC/1.1\r\n{'z' * (i * 37 % 500)}") for i in range(200)]
    pages += [(500 + i, "same", "copy") for i in range(300)] + [(None, "n", "no id"), (3000, "w", "dup"), (3000, "w", "dup")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("value", F.lit("clash")).withColumn("file", F.lit("clash")).repartition(4)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 30_000)
    try:
        rows, placed = warc.round_trip(df, offsets=False).collect(), warc.round_trip(df).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert Counter(r.record_id for r in rows) == Counter(p[0] for p in pages) and all(r.intact for r in rows)
    assert Counter((r.record_id, r.type, bytes(r.payload)) for r in placed) == Counter((r.record_id, r.type, bytes(r.payload)) for r in rows)
    assert len({(r.file, r.offset) for r in placed}) == len(pages) and 0 in {r.offset for r in placed}
    first = {}
    for i, _, h in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(h or "", i)
    text = {i: h or "" for i, _, h in pages}
    for r in rows:
        body = text[r.record_id].encode()
        assert r.digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        if r.record_id is None or first[text[r.record_id]] == r.record_id:
            assert r.type == "response" and r.refers_to is None and bytes(r.payload) == body
        else:
            assert r.type == "revisit" and r.refers_to == first[text[r.record_id]] and not r.payload
    assert warc.round_trip(df.where("false")).count() == 0


@pytest.mark.parametrize("offsets", [False, True])
def test_warc_other_splits(spark, offsets):
    """Byte ranges that change between building and reading change no row; equal segments, records or not, are told apart."""
    inner = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc"
    pages = [(i, "w", f"page {i} {'z' * (i * 91 % 3000)}" + (inner * (i % 4) if i % 5 == 0 else "")) for i in range(400)] + [(None, "n", "no id"), (None, "n", "no id"), (7000, "w", "dup"), (7000, "w", "dup")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    size, key = spark.conf.get("spark.sql.files.maxPartitionBytes"), "spark.sql.files.maxPartitionBytes"
    try:
        spark.conf.set(key, 20_000)
        found = warc.round_trip(df, offsets=offsets)
        spark.conf.set(key, 7_000)
        rows = found.collect()
        spark.conf.set(key, 50_000)
        again = found.select("*").collect()
    finally:
        spark.conf.set(key, size)
    want = Counter((i, h) for i, _, h in pages)
    for got in (rows, again):
        assert Counter((r.record_id, bytes(r.payload).decode()) for r in got) == want and all(r.intact for r in got)
    if offsets:
        assert len({(r.file, r.offset) for r in rows}) == len(pages)


def test_warc_min_bytes(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.record_id: (r.type, r.refers_to) for r in warc.round_trip(df, min_bytes=5).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


# -- I-Match -------------------------------------------------------------------------------------------------------------


def test_imatch(spark, docs, empty):
    rows = imatch.compare_edited(docs).collect()
    assert len(rows) == len(TEXTS)
    lex = {r.term.encode(): imatch.lexicons_of(r.term.encode()) for r in imatch.lexicon(docs).collect()}
    lex = {t: i for t, i in lex.items() if i}
    df = Counter(w for _, t in TEXTS for w in imatch.terms(t))
    assert {r.term: r.documents for r in imatch.lexicon(docs).collect()} == {w.decode(): n for w, n in df.items() if 2 <= n <= imatch.MAX_SHARE * len(TEXTS)}
    by_text = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(r.fingerprint, set()).add(r.n_chars)
    ordered = sorted((x for x in TEXTS if x[0] not in (None, 2)), key=lambda x: -x[0])
    for (i, t), (j, n) in itertools.pairwise(ordered):
        if 2 in (i - 1, j) or j + 1 == 2 or (i > 2 > j):
            continue
        t, n = t or "", n or ""
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        r = next(r for r in rows if r.doc_id == i)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.fingerprint == imatch.fingerprint(t, lex) and r.edited_fingerprint == imatch.fingerprint(edited, lex)
    assert imatch.compare_edited(empty).count() == 0 and imatch.compare_edited(docs.where("doc_id = 9")).count() == 1
    fps = imatch.fingerprints(docs).collect()
    same = defaultdict(set)
    for r in fps:
        same[r.text].add(r.fingerprint)
    assert all(len(s) == 1 for s in same.values())


def test_imatch_null_ids(spark):
    """Rows with null ids lie in many parts, and follow each other by descending hash all the same."""
    rows = [(None, f"null {i} some words of text {i * 7}") for i in range(300)] + [(i, f"text {i} of words") for i in range(40)] + [(None, "same")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = imatch.neighbours(df).collect()
    own = [r for r in placed if not r.extra]
    assert len(own) == len(rows) and len({r.part for r in own if r.id is None}) > 8
    in_order = sorted(own, key=lambda r: (r.id is None, -(r.id or 0), -r.h))
    assert [(r.id, r.h) for r in sorted(own, key=lambda r: (r.part, r.id is None, -(r.id or 0), -r.h))] == [(r.id, r.h) for r in in_order]
    want = Counter()
    for a, b in zip(in_order, [*in_order[1:], in_order[0]], strict=True):
        cut = len(a.t) // 3
        want[hashlib.sha256((a.t[: len(a.t) - cut] + b.t[:cut]).encode()).hexdigest()] += 1
    assert Counter(r.edited_sha256 for r in imatch.compare_edited(df).collect()) == want


def test_likeness():
    a = "0011" * imatch.SUBSETS
    assert imatch.likeness(a, a) == 1.0 and imatch.likeness(a, "1100" * imatch.SUBSETS) == 0.0 and imatch.likeness("=x", "=y") == 0.0 and imatch.likeness("=x", "=x") == 1.0


# -- Hilbert shards ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("dims", [2, 3])
def test_curve(dims):
    table = hilbert.curve_table(dims)
    cells = {v: i for i, v in enumerate(table)}
    assert sorted(table) == list(range(len(table)))
    for k in range(len(table) - 1):
        a, b = ([cells[k + d] >> 4 * i & 15 for i in range(dims)] for d in (0, 1))
        assert sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1


def test_shards(spark, docs, empty):
    big = spark.range(1000).selectExpr("id AS doc_id", "'same text' AS text", "'en' AS lang", "IF(id % 3 = 0, 'hot', concat('s', id % 7)) AS source")
    for df, n in ((docs, len(TEXTS)), (big, 1000)):
        rows = hilbert.shard_documents(df).collect()
        sizes = Counter(r.shard for r in rows)
        assert len(rows) == n and max(sizes.values()) - min(sizes[s] for s in range(8)) <= 1
        for s in sizes:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
        order = sorted(rows, key=lambda r: (r.shard, r.slot))
        assert [r.curve for r in order] == sorted(r.curve for r in rows)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in hilbert.shard_documents(docs).collect()) == want
    assert hilbert.shard_documents(empty).count() == 0


def test_shard_levels(spark):
    """Strings are told apart by all of their characters, and by rows once there are many of them."""
    near = spark.createDataFrame([(f"https://{c}.org",) for c in "zab"] + [(None,)], "source string")
    bounds = hilbert.text_bounds(near, "source")
    assert bounds == [("", 0), ("https://a.org", 4), ("https://b.org", 8), ("https://z.org", 12)]
    assert {r.source: r.l for r in near.select("source", hilbert.text_level(F.col("source"), bounds).alias("l")).collect()} == {None: 0, "https://a.org": 4, "https://b.org": 8, "https://z.org": 12}
    rows = [f"https://site/{i:04d}é" for i in range(300)] + ["https://site/0100é"] * 700
    many = spark.createDataFrame([(v,) for v in rows], "source string").repartition(3)
    bounds, ordered = hilbert.text_bounds(many, "source"), sorted(rows, key=str.encode)
    for r in many.select("source", hilbert.text_level(F.col("source"), bounds).alias("l")).distinct().collect():
        assert r.l == ordered.index(r.source) * 16 // 1000
    assert hilbert.text_bounds(many.where("false"), "source") == []


def test_shard_files_can_be_skipped(spark, tmp_path):
    """Of the files cut along the curve, a query on any dimension needs far fewer than of files in order of arrival."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', CAST(pow(2, xxhash64(id, 1) % 1000 / 100.0) AS INT)) AS text", "element_at(array('de','en','fr','it'), CAST(1 + pmod(xxhash64(id, 2), 4) AS INT)) AS lang", "concat('https://site', lpad(CAST(pmod(xxhash64(id, 3), 90) AS STRING), 2, '0'), '.org') AS source")
    placed = hilbert.shard_documents(docs).join(docs.select("doc_id", "lang", "source"), "doc_id")
    hilbert.write_shards(placed, f"{tmp_path}/hilbert", 8)
    placed.repartition(64, F.xxhash64("doc_id")).write.parquet(f"{tmp_path}/plain")

    def needed(where):
        of = lambda path: spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(*[f(c).alias(f"{n}_{c}") for c in ("lang", "source", "size") for n, f in (("low", F.min), ("high", F.max))])
        return [of(f"{tmp_path}/{kind}").agg(F.sum(F.expr(where).cast("int")) / F.count(F.lit(1))).first()[0] for kind in ("hilbert", "plain")]

    for where in ("low_lang <= 'en' AND high_lang >= 'en'", "low_source <= 'https://site40.org' AND high_source >= 'https://site40.org'", "low_size <= 20 AND high_size >= 16"):
        cut, plain = needed(where)
        print(where, cut, plain)
        assert plain > 0.95 and cut < 0.6, (where, cut)


def test_shard_hot_ids_and_clashes(spark):
    """Rows without an id, or with one id, fill no piece by themselves; names of the operator's columns may be taken."""
    df = spark.range(9000).selectExpr("IF(id % 3 = 0, NULL, IF(id % 3 = 1, 7, id)) AS doc_id", "'t' AS text", "'en' AS lang", "'s' AS source", "id AS place", "'x' AS cell", "'y' AS by", "'z' AS curve", "'w' AS piece")
    rows = hilbert.shard_documents(df).collect()
    assert Counter(r.shard for r in rows) == {s: 1125 for s in range(8)} and {(r.shard, r.slot) for r in rows} == {(s, i) for s in range(8) for i in range(1125)}
    out = hilbert.shard(df, {"a": F.lit(3)}, F.md5(F.col("doc_id").cast("string")), 4, "doc_id")
    assert {"place", "cell", "by", "piece", "shard", "slot", "curve"} <= set(out.columns) and out.where("cell = 'x' AND by = 'y' AND piece = 'w'").select("place").distinct().count() == 9000


# -- toxicity ------------------------------------------------------------------------------------------------------------


def test_toxicity_accuracy(spark):
    """Held-out accuracy on labelled documents; the held-out part is never learnt from."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = crc_bucket(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, labels.where(~held))
    rows = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(held).collect()
    pos, neg = (np.array([r.score for r in rows if r.toxic == y]) for y in (1, 0))
    auc = (pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()
    assert auc > 0.98 and (pos >= 0.3).mean() > 0.85 and (neg >= 0.3).mean() < 0.02


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 0), (11, 1), (11, 0), (None, 1), (9, None), (13, 0), (777, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows) and {type(r.score) for r in rows} == {float}
    none = toxicity.fit(empty, labels.where("false"))
    assert toxicity.score(empty, none).count() == 0 and all(r.score < 0.01 for r in toxicity.score(docs, none).collect())


def plain_features(text):
    """Buckets of the distinct character n-grams, hashed one by one."""
    t, m, out = (text or "").lower(), (1 << 32) - 1, set()
    for n in toxicity.SIZES:
        for i in range(len(t) - n + 1):
            h = ord(t[i]) * 2654435761 & m
            for c in t[i + 1 : i + n]:
                h = ((h ^ h >> 15) * 2246822519 + ord(c) * 3266489917) & m
            out.add(((h ^ h >> 13) * 668265263 & m) >> 32 - toxicity.BITS)
    return out


def test_toxicity_features(monkeypatch):
    texts = [t for _, t in TEXTS] + ["abc", "def", "ABCDEF", "ab"]
    want = [plain_features(t) for t in texts]
    for span in (1 << 20, 997):  # the long texts whole, and by spans
        monkeypatch.setattr(toxicity, "SPAN", span)
        got = [f.tolist() for f in toxicity.features(iter(texts), np.ones(1 << toxicity.BITS, bool))]
        assert [set(f) for f in got] == want and all(len(f) == len(set(f)) for f in got)


def test_toxicity_against_plain_regression(spark):
    """Scores are those of a logistic regression over all n-grams, solved by Newton steps in the space of the documents."""
    rng = np.random.default_rng(12)
    bad, good = ["idiot", "clown", "worthless", "rubbish"], ["river", "meadow", "market", "letter", "window"]
    rows = [(i, " ".join(rng.choice(bad if rng.random() < (0.6 if i % 3 == 0 else 0.05) else good) for _ in range(8)), int(i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    got = {r.doc_id: r.score for r in toxicity.score(df, toxicity.fit(df, df.select("doc_id", "toxic"), steps=200)).collect()}
    y = np.array([r[2] for r in rows], float)
    held = [plain_features(t) for _, t, _ in rows]
    cols = {f: k for k, f in enumerate(sorted(set().union(*held)))}
    x = np.zeros((len(rows), len(cols)))
    for i, fs in enumerate(held):
        x[i, [cols[f] for f in fs]] = 1
    n1, n0 = x[y == 1].sum(0) + 0.5, x[y == 0].sum(0) + 0.5
    ratio = np.log(n1 / (y.sum() + 1)) - np.log(n0 / ((1 - y).sum() + 1))
    x *= np.sign(ratio) * np.maximum(0, abs(ratio) - 2 * np.sqrt(1 / n1 + 1 / n0))
    design, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(len(cols) + 1)
    ridge = np.append(np.full(len(cols), 1e-3), 0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ w))
        hess = design.T @ (design * (p * (1 - p) / len(y))[:, None]) + np.diag(ridge + 1e-12)
        w -= np.linalg.solve(hess, design.T @ (p - y) / len(y) + ridge * w)
    want = 1 / (1 + np.exp(-design @ w))
    assert all(abs(got[i] - want[i]) < 0.01 for i, _, _ in rows) and np.ptp(want) > 0.5


# -- Brown model ---------------------------------------------------------------------------------------------------------


def test_brown(spark, docs, empty):
    train = docs.where(crc_bucket(F.col("doc_id"), 7) != 2)
    ids = [(i, t) for i, t in TEXTS if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    model, counts = brown.fit(train, classes=6, own_words=20, groups=4, head_words=100)
    c = Counter(w for _, t in ids for w in [*brown.words(t), b""])
    n, v = sum(c.values()), len(c)
    assert (model.train_tokens, model.distinct) == (n, v)
    rows = brown.score(docs, model, counts).collect()
    assert len(rows) == len(TEXTS) and all(np.isfinite(r.score) and r.train_tokens == n for r in rows)
    want = Counter()
    for i, t in TEXTS:
        toks = [*brown.words(t), b""]
        want[i, len(toks), sum(c[w] > 0 for w in toks), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks), 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    # probabilities add up to one: over classes after any class, and over words and the unknown within a class
    assert np.allclose((10**model.log_step).sum(1), 1)
    own = defaultdict(float)
    for w, k in c.items():
        if w:
            item = model.items([w])[1][0]
            own[model.of[item]] += (k + 1) / 10 ** model.log_size[model.of[item]]
    for k, p in own.items():
        assert p + 1 / 10 ** model.log_size[k] == pytest.approx(1)
    no_model, no_counts = brown.fit(empty)
    assert brown.score(empty, no_model, no_counts).count() == 0 and {r.n_known for r in brown.score(docs, no_model, no_counts).collect()} == {0}


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(1)
    hidden = rng.integers(0, 4, 60)
    rates = rng.dirichlet(np.ones(4) * 0.2, 4)
    pairs = np.array([[rng.poisson(40 * rates[hidden[i], hidden[j]]) for j in range(60)] for i in range(60)], float)

    def likelihood(of):
        k = of.max() + 1
        g = np.zeros((k, k))
        np.add.at(g, (of[:, None].repeat(60, 1), of[None].repeat(60, 0)), pairs)
        f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
        return f(g) - f(g.sum(0)) - f(g.sum(1))

    start = np.concatenate(([0], 1 + np.arange(59) % 4))
    assert likelihood(brown.exchange(pairs, 5)) > likelihood(start)


def test_brown_beats_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = crc_bucket(F.col("doc_id"), 7) == 2
    model, counts = brown.fit(docs.where(~held))
    r = brown.score(docs.where(held), model, counts).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert r.s > r.b and brown.perplexity(r.s, r.n) < brown.perplexity(r.b, r.n)


def test_brown_assigns_further_words(spark):
    """Words beyond the exchange items go by their own neighbours, whatever their endings; exchange runs until none moves."""
    rng = np.random.default_rng(6)
    left, right = ([f"{side}{i}{'xyz'[i % 3]}" for i in range(60)] for side in "lr")
    rows = [(i, " ".join(w for _ in range(20) for w in (rng.choice(left), rng.choice(right)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fine, counts = brown.fit(docs, classes=3, own_words=20, groups=1, min_count=20)
    of = lambda w: int(fine.of[fine.items([w.encode()])[1][0]])
    assert {of(w) for w in left} != {of(w) for w in right} and len({of(w) for w in left}) == len({of(w) for w in right}) == 1
    coarse, _ = brown.fit(docs, classes=3, own_words=20, groups=1, min_count=1 << 60)
    total = lambda m: brown.score(docs, m, counts).agg(F.sum("score")).first()[0]
    assert total(fine) > total(coarse) and np.allclose((10**fine.log_step).sum(1), 1)


def test_brown_exchanges_every_word(spark, monkeypatch):
    """Rare words, and those beyond the head, are exchanged as well, whatever their endings; scores use their classes."""
    monkeypatch.setattr(brown, "DENSE", 15)
    monkeypatch.setattr(brown, "BUCKET", 3000)
    rng = np.random.default_rng(8)
    left, right = ([f"{side}{i}{'xyz'[i % 3]}" for i in range(400)] for side in "lr")
    rows = [(i, " ".join(w for _ in range(20) for w in (rng.choice(left), rng.choice(right)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model, counts = brown.fit(docs, classes=3, own_words=10, groups=1, head_words=30)
    c = Counter(w for _, t in rows for w in t.encode().split())
    assert len(model.head) <= 30 and max(c.values()) < 40
    of = dict(zip(c, model.of[model.items(list(c))[1]].tolist(), strict=True))
    sides = [{of[w.encode()] for w in side if w.encode() in of} for side in (left, right)]
    assert len(sides[0]) == len(sides[1]) == 1 and sides[0] != sides[1]
    asked = [*rows[:20], (1000, "never met"), (1001, "l1y never r1y r2z met"), (1002, None)]
    got = {r.doc_id: r.score for r in brown.score(spark.createDataFrame(asked, "doc_id long, text string"), model, counts).collect()}
    for i, t in asked:
        toks = [b"", *brown.words(t), b""]
        path = model.of[model.items(toks)[1]]
        want = sum(math.log10(c[w] + 1) for w in toks if w) + model.log_step[path[:-1], path[1:]].sum() - model.log_size[path[1:]].sum()
        assert got[i] == pytest.approx(want)


# -- top-k ---------------------------------------------------------------------------------------------------------------


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(40, rows[40][1])] * 3  # a very common vector, and a repeated row
    rows += [(None, rows[1][1]), (2000, None), (2020, []), (2021, []), (2040, [float("nan")] * 8), (2060, [None] * 8), (2100, [0.5] * 3), (2101, [0.5] * 3)]
    # finite components of any size take part: within a long, beyond a double's exact integers, beyond a long
    rows += [(3000, [1.0, 2.0]), (3001, [2500000.0, 1.0]), (3002, [0.5, 0.5]), (3020, [3e12, 1.0]), (3021, [-3e12, 5.0]), (3040, [1e300, -1e300]), (3041, [1e300, 1.0]), (3042, [2e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("v", F.lit("clash")).repartition(3)
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("id") % 20 == 0, k=20, candidates=128, queries=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ok = [(i, tuple(int(Fraction(x) * 64 // 1) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in {(i, v) for i, v in ok if i % 20 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:20]
        assert got[q] == [(n, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for n, (s, i) in enumerate(best, 1)], q
    assert set(got) == {i for i, _ in ok if i % 20 == 0} and topk.top_k(df.where("false"), F.col("id") % 20 == 0).count() == 0


def test_stops_on_proof():
    rng = np.random.default_rng(2)
    rows = rng.integers(-60, 60, (3000, 16))
    index = topk.Index(rows)
    queries = rng.integers(-60, 60, (40, 16))
    found = index.candidates(queries, 20, np.full(40, -np.inf))
    for q, at in zip(queries, found, strict=True):
        score = rows @ q
        assert set(np.flatnonzero(score >= np.sort(score)[-20])) <= set(at.tolist())
    assert any(len(at) < len(rows) for at in found) and len(index.segments) == 4
    # a floor that no row reaches skips the block, one that some reach keeps them all
    assert all(len(at) == 0 for at in index.candidates(queries, 20, np.full(40, 1e9)))
    bars = np.array([np.sort(rows @ q)[-5] for q in queries], float)
    for q, at, bar in zip(queries, index.candidates(queries, 20, bars), bars, strict=True):
        assert set(np.flatnonzero(rows @ q >= bar)) <= set(at.tolist())
    # postings hold only candidates that have a part of their size
    few = rows.copy()
    few[5, 3] = 4000
    segments = topk.Index(few).segments
    assert [(d, at.tolist()) for d, at, _ in segments[0][2]] == [(3, [5])] and not len(segments[0][0])


# -- mixing --------------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found, report = mixing.rates(docs, mixing.labelled_domains(labels), {"high": 0.3, "low": 0.4, "toxic": 0.3}, epochs=1.0)
    rows = found.toPandas()
    k = len(report["domains"])
    assert (rows["rate"] >= 0).all() and np.allclose(rows[[f"p{i}" for i in range(k)]].sum(axis=1), 1)
    mass = rows["rate"] * rows["tokens"] * rows["copies"]
    assert np.allclose([(mass * rows[f"p{i}"]).sum() for i in range(k)], report["target"], rtol=1e-3)
    truth = labels.toPandas().merge(rows, left_on="doc_id", right_on="id")
    said = truth[[f"p{i}" for i in range(k)]].to_numpy().argmax(1)
    want = [report["domains"].index("toxic" if t else "high" if q else "low") for q, t in zip(truth["quality"], truth["toxic"], strict=True)]
    assert (said == want).mean() > 0.85


def test_mixing_is_native(spark, docs):
    labelled = spark.createDataFrame([(1, "a"), (6, "b"), (9, "a"), (None, "b")], "id long, domain string")
    found, _ = mixing.rates(docs, labelled, {"a": 0.5, "b": 0.5})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "MapIn"))


def test_mixing_least_squares(spark):
    """Against a plain projected gradient on the same members, targets in and out of reach."""
    rng = np.random.default_rng(4)
    p, n = rng.dirichlet([0.5, 0.5, 0.5], 200), rng.integers(1, 50, 200).astype(float)
    df = spark.createDataFrame([(1, float(t), *map(float, row)) for t, row in zip(n, p, strict=True)], "copies long, tokens double, p0 double, p1 double, p2 double")
    have = (n[:, None] * p).sum(0)
    for weights, epochs, least in (([0.6, 0.3, 0.1], 1.0, 0.0), ([1.0, 0.0, 0.0], 0.5, 0.0), ([0.2, 0.2, 0.6], 1.2, 1.0)):
        target = np.array(weights) / sum(weights) * have.sum() * epochs
        r = np.ones(200)
        for _ in range(20000):
            r = np.maximum(least, r - p @ (((r * n) @ p - target) / have))
        best = (((r * n) @ p - target) ** 2 / have).sum()
        got, report = mixing.solve(df, 3, weights, epochs, least)
        rows = got.collect()
        rate, reached = np.array([x.rate for x in rows]), sum(x.rate * x.tokens * np.array([x.p0, x.p1, x.p2]) for x in rows)
        assert (rate >= least - 1e-12).all() and np.allclose(reached, report["expected"])
        assert ((reached - target) ** 2 / have).sum() <= best + (1e-3 if epochs == 1.0 else 0.05) * ((have * max(1.0, least) - target) ** 2 / have).sum()


def test_mixing_rows(spark, docs, empty):
    labelled = spark.createDataFrame([(1, "a"), (6, "b"), (9, "a"), (None, "b")], "id long, domain string")
    found, _ = mixing.rates(docs, labelled, {"a": 0.5, "b": 0.5})
    assert found.agg(F.sum("copies")).first()[0] == len(TEXTS)
    out = mixing.mix(docs, labelled, {"a": 0.5, "b": 0.5}, 1.3, 1.0)
    have = Counter((r.doc_id, r.text) for r in out.collect())
    assert out.columns == docs.columns and all(have[x] >= n for x, n in Counter(TEXTS).items())
    half = mixing.mix(docs, labelled, {"a": 0.5, "b": 0.5}, 0.3)
    assert Counter((r.doc_id, r.text) for r in half.collect()) == Counter((r.doc_id, r.text) for r in half.collect())
    assert mixing.mix(empty, labelled, {"a": 1.0}).count() == 0 and mixing.mix(docs, labelled.where("false"), {}).count() == len(TEXTS)


def test_names_that_clash(spark):
    """Columns that have names which the operators use inside, and a text of several MB, come through as they were."""
    import corpus_pipeline as P

    names = ["_id", "_tag", "_times", "_copy", "_i", "_t", "_toxicity", "toxicity", "id", "tag", "row", "key", "t", "i", "times", "copy", "rate", "curve_", "fp", "component_id", "n", "k", "word"]
    texts = ["a b c d e f g", "a b c d e f g", "one two three four five six", None, "", "long " * 700_000, "you idiot"]
    rows = [(i, t, "en", "s", 0, *[f"{c}{i}" for c in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)).repartition(2)
    whole = lambda df: {tuple(r) for r in df.select(docs.columns).collect()}
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    assert whole(simhash.one_per_component(docs)) == {r for r in map(tuple, rows) if r[0] not in (1, 4)}
    assert whole(simhash.one_per_component(docs, words=5, least=0.8)) == {r for r in map(tuple, rows) if r[0] not in (1, 4)}
    out = mixing.mix(docs, mixing.labelled_domains(labels), {"high": 0.5, "low": 0.3, "toxic": 0.2}, None, 1.0)
    assert whole(out) == set(map(tuple, rows)) and out.columns == docs.columns
    kept = toxicity.score(docs, toxicity.fit(docs, labels), name="toxicity_")
    assert whole(kept) == set(map(tuple, rows))
    assert {c for c in hilbert.shard_documents(docs).columns} == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve"}
    assert set(P.STAGES[0][1].__code__.co_names) >= {"fresh"}


def test_pipeline_of_nothing(spark, empty, tmp_path):
    """Every stage takes an empty table, and rows of nulls."""
    import corpus_pipeline as P

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    bare = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs, n in ((empty, 0), (bare, 2)):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= n
        assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == n


def test_pipeline_mixture(spark, caplog):
    """The stage reaches its weights, in the rows that come out, and says what it reached; no document goes."""
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    with caplog.at_level("INFO", logger="corpus_pipeline"):
        out = P.mix(spark, docs, sf).groupBy("doc_id").count().collect()
    assert [r.levelname for r in caplog.records if r.name == "corpus_pipeline"] == ["INFO"]
    found, report = mixing.rates(docs, mixing.labelled_domains(labels), P.MIXTURE, P.EPOCHS, P.LEAST)
    assert all(abs(aim - got) <= P.OFF and aim == pytest.approx(P.MIXTURE[d]) for d, (aim, got) in mixing.shares(report).items())
    times, members = {r.doc_id: r["count"] for r in out}, found.toPandas()
    assert times.keys() == set(members["id"]) and min(times.values()) >= 1
    mass = members["tokens"] * members["id"].map(times)
    for i, d in enumerate(report["domains"]):
        assert (mass * members[f"p{i}"]).sum() / mass.sum() == pytest.approx(P.MIXTURE[d], abs=0.02)


# -- pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    """Each stage against a plain version of its decision, on whole small tables."""
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    at = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, at, sf)
        assert out.columns == docs.columns
        rows = out.collect()
        kept[name] = rows
        at = spark.createDataFrame(rows, docs.schema)
    ids = lambda rows: {r.doc_id for r in rows}
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet").where(crc_bucket(F.col("doc_id"), 4) != 2))
    assert ids(kept["toxicity"]) == {r.doc_id for r in toxicity.score(docs.select("doc_id", "text"), model).collect() if r.score < P.TOXIC}
    fps = {r.doc_id: plain_simhash(r.text) for r in kept["toxicity"]}
    comp = plain_components([(a, b) for a, b in itertools.combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 4], fps)
    assert ids(kept["near_duplicates"]) == set(comp.values()) and len(kept["near_duplicates"]) == len(set(comp.values()))
    assert ids(kept["mixing"]) == ids(kept["near_duplicates"]) and len(kept["mixing"]) >= len(kept["near_duplicates"])
    n = checked_packing(P.STAGES[-1][1](spark, at, sf).collect(), [(r.doc_id, r.text) for r in kept["mixing"]], 2048)
    assert n > 0 and ids(P.run(spark, sf).collect()) == ids(kept["mixing"])
