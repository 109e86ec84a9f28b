"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most `distance` <= 4 bits differ in
at most that many bytes, so at least 8 - distance positional bytes agree: the guaranteed minimum number of matches.
The index lists fingerprints under every choice of WIDTH (position, byte) entries, which is the byte-position index
intersected that many lists at a time; of pairs that meet in a list the positional bytes they share are tallied, those
that reach the minimum are retained (in the first list that they share, so each pair once) and verified by counting
differing bits. Lists are chosen three entries deep, four when fingerprints are so many that lists would grow long.

No list is expanded into all its pairs beyond `run_limit` entries. Members of longer lists take an exact linear way:
two fingerprints at most four bits apart have a common neighbour at most two bits from each, so every member is
written under itself and its one- and two-bit neighbours (2,081 rows), and consecutive members under one neighbour are
linked. Lists that a sample shows to be long aren't gathered at all, their members take that way from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkledger.llm.base import broadcast_if_small, connected_components, materialise, small_batches

#: Entries that a list intersects, and distinct fingerprints up to which three will do.
WIDTHS, FEW = (3, 4), 1 << 24
#: One in so many fingerprints shows which lists are long.
SAMPLED = 64
#: Fingerprints under one index entry that are still compared pair by pair (with no more than a spanning set emitted).
RUN_LIMIT = 2000
#: Up to here all verified pairs of an index entry are emitted, beyond only links that span its components.
PAIR_LIMIT = 32
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BYTE = np.uint64(255)


def _choices(width: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """Every choice of `width` positions, and for each set of agreeing positions the first choice within it (-1: none)."""
    choices = list(combinations(range(8), width))
    order = {c: i for i, c in enumerate(choices)}
    first = np.full(256, -1, np.int64)
    for mask in range(256):
        on = tuple(i for i in range(8) if mask >> i & 1)
        if len(on) >= width:
            first[mask] = order[on[:width]]
    return choices, first


_CHOICES = {w: _choices(w) for w in WIDTHS}


def simhash(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The fingerprint of one whole text; no words (or a null text): 0."""
    toks = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not toks:
        return 0
    joined = b" ".join(toks)
    if len(toks) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, toks), np.int64, len(toks)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[: len(toks) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, len(toks) - words + 1)
    cols = hashes.view(np.uint8).reshape(-1, 8)
    tally = np.concatenate([np.bincount(cols[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(tally * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id_col, fp long): the SimHash of each whole text, one row a row of `docs`; other columns are not read.

    Null and empty texts have fingerprint 0, null ids and repeated rows are kept, an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, fp long")
    return out.select(F.col("id").alias(id_col), "fp")


def _compare(x: np.ndarray, y: np.ndarray, choice: np.ndarray, distance: int, width: int) -> np.ndarray:
    """Which pairs reach the guaranteed tally, meet here first and, of these, differ in at most `distance` bits."""
    differ = x ^ y
    agree = np.packbits(differ.view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little")[:, 0]
    kept = np.flatnonzero((np.bitwise_count(agree) >= 8 - distance) & (_CHOICES[width][1][agree] == choice))
    return kept[np.bitwise_count(differ[kept]) <= distance]


def _spanning(x: np.ndarray, choice: int, distance: int, width: int) -> tuple[list[int], list[int]]:
    """Links that join the members of one list into the components that its verified pairs form."""
    parent = np.arange(len(x))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a, b = [], []
    for i in range(len(x) - 1):
        rest = x[i + 1 :]
        for j in _compare(np.full(len(rest), x[i]), rest, np.full(len(rest), choice), distance, width).tolist():
            p, q = find(i), find(i + 1 + j)
            if p != q:
                parent[max(p, q)] = min(p, q)
                a.append(i)
                b.append(i + 1 + j)
    return a, b


def _runs(batches: Iterator[pa.RecordBatch], run_limit: int, distance: int, width: int) -> Iterator[pa.RecordBatch]:
    """Links of entries sorted by key; of a run beyond run_limit the members, with b null, as they pass by."""
    held_k, held_x, passing = np.empty(0, np.int64), np.empty(0, np.uint64), None

    def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        a = a.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))], ["a", "b"])

    def links(k: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        sizes = np.diff(np.append(starts, len(k)))
        for s, n in zip(starts[sizes > PAIR_LIMIT].tolist(), sizes[sizes > PAIR_LIMIT].tolist(), strict=True):
            if n > run_limit:
                yield out(x[s : s + n], None)
                continue
            a, b = _spanning(x[s : s + n], int(k[s] >> 32), distance, width)
            if a:
                yield out(x[s : s + n][a], x[s : s + n][b])
        short = np.repeat((sizes <= PAIR_LIMIT) & (sizes > 1), sizes)
        k, x = k[short], x[short]
        for d in range(1, PAIR_LIMIT):
            same = np.flatnonzero(k[d:] == k[:-d]) if d < len(k) else np.empty(0, np.int64)
            if not len(same):
                break
            ok = same[_compare(x[same], x[same + d], k[same] >> 32, distance, width)]
            if len(ok):
                yield out(x[ok], x[ok + d])

    for batch in batches:
        k, x = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if passing is not None:
            n = int(np.searchsorted(k, passing, "right"))
            if n:
                yield out(x[:n], None)
            k, x = k[n:], x[n:]
            if not len(k):
                continue
            passing = None
        k, x = np.concatenate((held_k, k)), np.concatenate((held_x, x))
        cut = int(np.searchsorted(k, k[-1], "left")) if len(k) else 0
        if cut:
            yield from links(k[:cut], x[:cut])
        held_k, held_x = k[cut:], x[cut:]
        if len(held_k) > run_limit:
            yield out(held_x, None)
            passing, held_k, held_x = held_k[0], held_k[:0], held_x[:0]
    if len(held_k):
        yield from links(held_k, held_x)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between consecutive members of a run of equal neighbours, in sorted order."""
    last_k, last_x = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        k, x = np.concatenate((last_k, batch.column(0).to_numpy())), np.concatenate((last_x, batch.column(1).to_numpy()))
        at = np.flatnonzero((k[1:] == k[:-1]) & (x[1:] != x[:-1]))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(x[at]), pa.array(x[at + 1])], ["a", "b"])
        last_k, last_x = k[-1:], x[-1:]


def links(fps: DataFrame, distance: int = 4, run_limit: int = RUN_LIMIT, width: int | None = None) -> DataFrame:
    """(a, b) longs between distinct fingerprints `fp` whose connected components are those of all pairs at most `distance` bits apart.

    Short lists give every verified pair; long ones only links that keep the same components. Nulls are ignored.
    """
    if distance not in (0, 2, 4):
        raise ValueError("distance is 0, 2 or 4: four matching bytes are guaranteed, and common neighbours lie half-way")
    spark = fps.sparkSession
    fps = fps.select("fp").where("fp IS NOT NULL").distinct()
    width = width or WIDTHS[fps.count() > FEW]
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]

    def under(rows: DataFrame) -> DataFrame:
        entries = [reduce(lambda k, i: F.shiftleft(k, 8).bitwiseOR(byte[i]), c, F.lit(n).cast("long")) for n, c in enumerate(_CHOICES[width][0])]
        return rows.select(F.explode(F.array(*[e if width == 4 else F.shiftleft(F.shiftrightunsigned(e, 24), 32).bitwiseOR(e.bitwiseAND(F.lit((1 << 24) - 1))) for e in entries])).alias("k"), "fp")

    index, sampled = under(fps), under(fps.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0))
    hot = materialise(sampled.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(8, 4 * run_limit // SAMPLED)).select("k"), "simhash-hot")
    long = fps.where(F.lit(False))
    if not hot.isEmpty():
        hot = broadcast_if_small(hot, 16)
        long = index.join(hot, "k", "left_semi").select("fp")
        index = index.join(hot, "k", "left_anti")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda d: d.repartition(parts, "k").sortWithinPartitions("k", "fp")
    found = spread(index.select("k", "fp")).mapInArrow(lambda it: _runs(it, run_limit, distance, width), "a long, b long")
    found = materialise(found.union(long.select(F.col("fp").alias("a"), F.lit(None).cast("long").alias("b"))), "simhash-links")
    pairs = found.where("b IS NOT NULL")
    if found.where("b IS NULL").isEmpty():
        return pairs
    flips = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i, j in combinations(range(64), 2)]
    flips = F.lit(np.array([f for f in flips if f.bit_count() <= distance // 2], np.uint64).view(np.int64).tolist())
    dense = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    near = dense.select(F.explode(flips).alias("flip"), "fp").select(F.col("flip").bitwiseXOR(F.col("fp")).alias("k"), "fp")
    return pairs.union(spread(near).mapInArrow(_chained, "a long, b long").distinct())


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, run_limit: int = RUN_LIMIT) -> DataFrame:
    """(id_col, fp, component_id): the smallest id reachable over links of at most `distance` bits, itself included.

    One row a row of `docs`. Rows with a null id link like any other and get the smallest id that is not null, or null
    if their component has none. Copies share a fingerprint and so a component, however many they are.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, words), "simhash")
    fps = materialise(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    roots = materialise(connected_components(links(fps, distance, run_limit)), "simhash-roots")
    smallest = fps.join(roots, fps.fp == roots.node).groupBy("root").agg(F.min("least").alias("component"))
    linked = roots.join(smallest, "root").select(F.col("node").alias("fp"), "component")
    # on storage, so that the next join has an exchange of its own on either side, which adaptive execution can split
    known = materialise(fps.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "simhash-known")
    return rows.join(known, "fp").select(id_col, "fp", "component_id")


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, least: float | None = None) -> DataFrame:
    """The rows of `docs` without near-duplicates, all columns kept: of each component one row stays (see first_of_each()).

    With `least` texts link by the Jaccard similarity of their shingles: similar.components() checks the pairs that the
    index gives, and finds those besides that it can't give: at 0.8 about ten bits of 64 differ, which no match of whole
    bytes is guaranteed for.
    """
    if least is None:
        return first_of_each(docs, lambda rows: components(rows, "key", "text", words, distance), id_col, text_col)
    from sparkledger.llm import similar

    return first_of_each(docs, lambda rows: similar.components(rows, "key", "text", words, least), id_col, text_col)


def first_of_each(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, one of each component that `grouped` finds for rows (key, text).

    It is the row with the smallest id (null ids last), of several with that id the one with the smallest text hash,
    and of rows equal in both any one. The rows that go are joined by (id, text hash), broadcast only when few. Rows
    travel as one column, so the names of theirs don't matter.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tag = F.xxhash64(text, F.length(text))
    found = grouped(docs.select(F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), tag.alias("tag")).alias("key"), F.col(text_col).alias("text")))
    rows = materialise(found.groupBy("key", "component_id").agg(F.count(F.lit(1)).alias("n")), "simhash-rows")
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), tag.alias("tag"))
    back = lambda d: d.select(*[F.col(f"row.`{c}`") for c in docs.columns])
    key = lambda d: d.select(F.col("key.id").alias("i"), F.col("key.tag").alias("t"))
    same = F.expr("id <=> i AND tag = t")
    gone = materialise(key(rows.where("key <> component_id")), "simhash-gone")
    kept = carried.join(broadcast_if_small(gone, 24), same, "left_anti")
    twice = materialise(key(rows.where("key = component_id AND n > 1")), "simhash-twice")
    if twice.isEmpty():
        return back(kept)
    twice = broadcast_if_small(twice, 24)
    once = kept.join(twice, same, "left_semi").dropDuplicates(["id", "tag"])
    return back(kept.join(twice, same, "left_anti").union(once))
