"""Near-duplicates by the Jaccard similarity of word shingles: SimHash and MinHash candidates, each checked exactly.

A text is the set of its runs of `words` words. Candidates come first from SimHash: the byte-position index, its tally
and the count of differing bits of simhash.links(). Fingerprints are not guaranteed to find pairs far below 1, so
BANDS bands of ROWS minima give the rest: a pair of similarity s has a common band with probability
1 - (1 - s**ROWS)**BANDS: 0.9996 at 0.8, and more above. Of all candidates only those whose whole sets reach the
similarity link. What counts are components, so the members of a band are first compared with one of them each, its
lead, which is linear. Then every pair of a band that is not yet in one component is, by what each of them lacks of the
lead and adds to it: short maps of these rule most pairs out, the others are compared exactly, within the worker, which
hands on no more links than join the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkledger.llm import simhash
from sparkledger.llm.base import broadcast_if_small, connected_components, materialise, small_batches
from sparkledger.llm.simhash import _LOWER

BANDS, ROWS = 20, 5
#: Shingles whose minima are taken at once.
_CHUNK = 1024
#: Bits of the maps of what a member lacks and adds, and members of a band, and bytes, that one task compares with as many others.
MAP_BITS, BLOCK, BLOCK_BYTES = 512, 4096, 32 << 20
_RNG = np.random.default_rng(42)
_TIMES, _PLUS = (_RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Distinct hashes of a whole text's runs of `words` words; a shorter text is one run, no words give none."""
    toks = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not toks:
        return np.empty(0, np.uint64)
    joined = b" ".join(toks)
    n = max(1, len(toks) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, toks), np.int64, len(toks)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e]) for s, e in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n))


def bands(found: np.ndarray) -> list[int]:
    """A signed 64-bit hash of each band of a set's minima; all empty sets share theirs."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), _CHUNK):
        least = np.minimum(least, (found[at : at + _CHUNK] * _TIMES + _PLUS).min(1))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[i].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64).tolist()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, its first member, another one) for each other one, of entries sorted by band and member."""
    last_k, first = None, 0
    for batch in batches:
        k, x = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        new = np.concatenate(([last_k is None or k[0] != last_k], k[1:] != k[:-1]))
        at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        lead = np.where(at < 0, first, x[np.maximum(at, 0)])
        ok = lead != x
        yield pa.RecordBatch.from_arrays([pa.array(k[ok]), pa.array(lead[ok]), pa.array(x[ok])], ["k", "a", "b"])
        last_k, first = k[-1], lead[-1]


def _map(found: np.ndarray) -> bytes:
    """Which of MAP_BITS bits the hashes of a set fall on."""
    out = np.zeros(MAP_BITS, bool)
    out[(found * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(MAP_BITS)] = True
    return np.packbits(out).tobytes()


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, n, lacks, adds): sizes of two sets and of what they share, maps of what b lacks of a and adds to it."""
    for batch in batches:
        na, nb, n, lacks, adds = [], [], [], [], []
        for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
            x, y = (v.values.to_numpy().view(np.uint64) for v in (x, y))
            less, more = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
            na.append(len(x))
            nb.append(len(y))
            n.append(len(x) - len(less))
            lacks.append(_map(less))
            adds.append(_map(more))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(c, pa.int32()) for c in (na, nb, n)), pa.array(lacks, pa.binary()), pa.array(adds, pa.binary())], ["a", "b", "na", "nb", "n", "lacks", "adds"])


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, less, more): the hashes that b lacks of a, and those it adds to it."""
    for batch in batches:
        less, more = [], []
        for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
            x, y = (v.values.to_numpy() for v in (x, y))
            less.append(np.setdiff1d(x, y, assume_unique=True))
            more.append(np.setdiff1d(y, x, assume_unique=True))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(less, pa.list_(pa.int64())), pa.array(more, pa.list_(pa.int64()))], ["a", "b", "less", "more"])


def _may_reach(i: int, others: np.ndarray, na: int, nb: np.ndarray, n: np.ndarray, lacks: np.ndarray, adds: np.ndarray, least: float) -> np.ndarray:
    """Which others may be similar to member i of a band: an upper bound of what they share, from what both differ in from the lead.

    Of the lead they share at most what neither lacks; of what i adds, at most what doesn't fall on bits that the other
    leaves empty, and the other way round. Equal bits never make a bound too low.
    """
    union = np.bitwise_count(lacks[i] | lacks[others]).sum(1)
    union = np.maximum(union, np.maximum(na - n[i], na - n[others]))
    own = nb[i] - n[i] - np.bitwise_count(adds[i] & ~adds[others]).sum(1).astype(np.int64)
    their = nb[others] - n[others] - np.bitwise_count(adds[others] & ~adds[i]).sum(1).astype(np.int64)
    shared = na - union + np.minimum(own, their)
    return others[shared >= least * (nb[i] + nb[others] - shared) - 1e-9]


def _apart(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links of this similarity that join a band's members in different components, as all such pairs would.

    Rows come sorted by band and pair of blocks; a task holds the two blocks of one pair at most.
    """

    def pairs(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        col = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        x, nb, n, block = col("b"), col("nb").astype(np.int64), col("n").astype(np.int64), col("block")
        lacks, adds = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint64).reshape(len(x), -1) for c in ("lacks", "adds"))
        less, more = ([v.values.to_numpy() for v in table.column(c)] for c in ("less", "more"))
        na, low, high = int(col("na")[0]), int(col("lo")[0]), int(col("hi")[0])
        part = np.unique(col("root"), return_inverse=True)[1]
        both = lambda u, v: len(np.intersect1d(u, v, assume_unique=True))
        a, b = [], []
        for i in np.flatnonzero(block == low).tolist():
            after = np.arange(i + 1, len(x)) if low == high else np.flatnonzero(block == high)
            for j in _may_reach(i, after[part[after] != part[i]], na, nb, n, lacks, adds, least).tolist():
                if part[i] == part[j]:
                    continue
                shared = na - len(less[i]) - len(less[j]) + both(less[i], less[j]) + both(more[i], more[j])
                union = nb[i] + nb[j] - shared
                if union == 0 or shared / union >= least:
                    a.append(x[i])
                    b.append(x[j])
                    part[part == part[j]] = part[i]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        k, lo, hi = (batch.column(c).to_numpy() for c in ("k", "lo", "hi"))
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1).tolist(), len(k)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if (key := (k[s], lo[s], hi[s])) != last and held:
                yield from pairs(pa.concat_batches(held))
                held = []
            last = key
            held.append(batch.slice(s, e - s))
    if held:
        yield from pairs(pa.concat_batches(held))


def near_fingerprints(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of nodes (node, fp) whose components are those of all fingerprints at most four bits apart."""
    heads = materialise(fps.groupBy("fp").agg(F.min("node").alias("head")), "similar-heads")
    of = lambda end: heads.select(F.col("fp").alias(end), F.col("head").alias(f"of_{end}"))
    apart = simhash.links(heads).join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("x"), F.col("of_b").alias("y"))
    equal = fps.join(heads, "fp").where("node <> head").select(F.col("head").alias("x"), F.col("node").alias("y"))
    return apart.union(equal).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def links(texts: DataFrame, entries: DataFrame, least: float, words: int, block: int = BLOCK, fps: DataFrame | None = None) -> DataFrame:
    """(a, b): pairs of at least this similarity whose components are those of all such pairs that share a band.

    `texts` has (node, t), a node as often as its text occurs, `entries` has (k, node), each band of each node once.
    With `fps` (node, fp) pairs of near fingerprints are candidates too.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), words).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))], ["node", "s"])

    def with_sets(pairs: DataFrame) -> DataFrame:
        of = lambda end, s: sets.select(F.col("node").alias(end), F.col("s").alias(s))
        return pairs.join(of("a", "sa"), "a").join(of("b", "sb"), "b").select("a", "b", "sa", "sb")

    def near(rows: DataFrame) -> DataFrame:
        union = F.col("na") + F.col("nb") - F.col("n")
        return rows.where((union == 0) | (F.col("n") / F.greatest(union, F.lit(1)) >= F.lit(least))).select("a", "b")

    stars = materialise(entries.repartition(parts, "k").sortWithinPartitions("k", "node").mapInArrow(_stars, "k long, a long, b long"), "similar-stars")
    pairs = stars.select("a", "b") if fps is None else stars.select("a", "b").union(near_fingerprints(fps))
    pairs = materialise(pairs.distinct(), "similar-pairs")
    ends = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "similar-ends")
    once = texts.join(broadcast_if_small(ends, 16), "node", "left_semi").groupBy("node").agg(F.first("t").alias("t"))
    sets = materialise(once.mapInArrow(hashed, "node long, s array<long>"), "similar-sets")
    known = materialise(with_sets(pairs).mapInArrow(_measured, "a long, b long, na int, nb int, n int, lacks binary, adds binary"), "similar-known-pairs")
    roots = materialise(connected_components(near(known)), "similar-roots")
    members = materialise(stars.join(roots, F.col("b") == F.col("node"), "left").select("k", "a", "b", F.coalesce("root", "b").alias("root")), "similar-members")
    members = members.join(known, ["a", "b"])
    size = F.sum(8 * (F.col("na") + F.col("nb") - 2 * F.col("n")))
    mixed = members.groupBy("k").agg(F.count(F.lit(1)).alias("n"), size.alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    mixed = materialise(mixed.select("k", F.ceil(F.greatest(F.col("n") / block, F.col("size") / BLOCK_BYTES, F.lit(1.0))).cast("int").alias("blocks")), "similar-mixed")
    members = materialise(members.join(mixed, "k"), "similar-mixed-members")
    differing = materialise(with_sets(members.select("a", "b").distinct()).mapInArrow(_differing, "a long, b long, less array<long>, more array<long>"), "similar-differing")
    mine = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("block", other).alias("lo"), F.greatest("block", other).alias("hi"))))
    apart = members.join(differing, ["a", "b"]).withColumn("block", mine).select("*", pair.alias("p"))
    apart = apart.select("k", "p.lo", "p.hi", "block", "b", "root", "na", "nb", "n", "lacks", "adds", "less", "more")
    apart = apart.repartition(parts, "k", "lo", "hi").sortWithinPartitions("k", "lo", "hi", "b")
    return near(known).union(materialise(apart.mapInArrow(lambda it: _apart(it, least), "a long, b long"), "similar-rest"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """(id_col, component_id), a row a row of `docs`: the smallest id reachable over pairs of at least this similarity.

    Copies share a component, however many they are, and so do all texts without a word. Null ids as in simhash.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text, F.length(text)).alias("node"), text.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([bands(shingles(t.as_py(), words)) for t in b.column(2)], pa.list_(pa.int64())), pa.array(np.fromiter((simhash.simhash(t.as_py(), words) for t in b.column(2)), np.uint64, b.num_rows).view(np.int64))], ["id", "node", "bands", "fp"])

    rows = materialise(texts.mapInArrow(run, f"id {kind}, node long, bands array<long>, fp long"), "similar")
    nodes = materialise(rows.groupBy("node").agg(F.min("id").alias("least"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "similar-nodes")
    entries = nodes.select(F.explode("bands").alias("k"), "node")
    roots = materialise(connected_components(links(texts.select("node", "t"), entries, least, words, fps=nodes.select("node", "fp"))), "similar-text-roots")
    smallest = nodes.join(roots, "node").groupBy("root").agg(F.min("least").alias("component"))
    linked = roots.join(smallest, "root").select("node", "component")
    # on storage for the same reason as in simhash
    known = materialise(nodes.join(linked, "node", "left").select("node", F.coalesce("component", "least").alias("component_id")), "similar-known")
    return rows.select("id", "node").join(known, "node").select(F.col("id").alias(id_col), "component_id")
