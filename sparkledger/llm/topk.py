"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are quantised to integers; what a component exceeds the least one of its dimension by is its impact. The index
of a block of candidates serves each impact in parts of descending size (4096s, 1024s, ... 4s, 1s): a posting segment
holds, for one dimension and size, the candidates that have a part of that size, and none of the others. A query takes
the segments by descending size, over all dimensions, into its candidates' accumulators; what the unread, smaller
parts can still add or take is bounded by the query and the largest unread parts. It stops only on proof: once few
candidates can still reach the k-th best lower bound. Those are rescored exactly. Queries read a segment together.

A block's index is built once: its task reads the candidates first, then all queries in batches. A first round over
one block gives each query a score that its k-th best can't fall below; with that bound the other blocks skip a query
that none of their candidates can serve, and let go of candidates early. Every candidate is shuffled once, every query
once a block, and at most k rows a query leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkledger.llm.base import materialise, small_batches

#: Candidates of a block (its index is held by one task), and queries that read it together.
CANDIDATES, QUERIES = 8192, 512
#: Parts of an impact are as many times smaller from one size to the next.
FACTOR = 4
#: A query stops when at most this share of a block can still be among its best.
FEW = 1 / 8
#: A dimension whose parts of one size fewer candidates have than this share keeps a list of them, else a row for all.
SPARSE = 1 / 4
#: Integers up to which sums in doubles are exact, and the ends of what a long holds.
_EXACT, _LEAST, _MOST = 1 << 53, -(1 << 63), (1 << 63) - 1
_OUT = "query_id long, query_hash long, vec_id long, score long, beyond string"


def whole(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part: not null, all components present and finite, with an id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(~bad)


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): as 64-bit integers, or as Python's unbounded ones if any is too large for exact sums."""
    if not values.size or np.abs(values).max() * scale < _EXACT:
        return np.floor(values * scale).astype(np.int64)
    return np.array([[int(Fraction(x) * scale // 1) for x in row] for row in values.tolist()], object)


class Index:
    """Posting segments of one block, by descending size of the parts they hold."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        self.least = rows.min(0)
        left = rows - self.least
        self.highest = left.max(0)
        size = 1
        while size * FACTOR <= self.highest.max(initial=0):
            size *= FACTOR
        #: (dimensions with a row for all candidates, their parts, lists of the others, largest parts unread after it)
        self.segments: list[tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]] = []
        while size:
            parts = left - left % size
            share = (parts != 0).mean(0)
            full = np.flatnonzero(share >= SPARSE)
            lists = [(d, at := np.flatnonzero(parts[:, d]), parts[at, d].astype(float)) for d in np.flatnonzero((share > 0) & (share < SPARSE)).tolist()]
            left, size = left % size, size // FACTOR
            self.segments.append((full, np.ascontiguousarray(parts[:, full].T.astype(float)), lists, left.max(0).astype(float)))

    def candidates(self, queries: np.ndarray, k: int, floors: np.ndarray) -> list[np.ndarray]:
        """For each query the rows of the block that its k best (and all that tie with the last) are among, proven by bounds.

        Rows that score below the query's floor may be left out.
        """
        n = len(self.rows)
        found: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)
        q = queries.astype(float)
        most = np.abs(q) @ np.maximum(np.abs(self.least), self.highest).astype(float)
        blur = np.where(most < _EXACT, 0.0, 1e-9 * most)
        up, down = np.maximum(q, 0), np.maximum(-q, 0)
        floors = floors - q @ self.least.astype(float) - blur
        acc, active = np.zeros((len(queries), n)), np.flatnonzero(up @ self.highest.astype(float) + blur >= floors)
        acc = acc[active]
        for full, rows, lists, rest in self.segments:
            if not len(active):
                break
            if len(full):
                acc += q[np.ix_(active, full)] @ rows
            for d, at, parts in lists:
                acc[:, at] += q[active, d, None] * parts
            more, less = up[active] @ rest + blur[active], down[active] @ rest + blur[active]
            bar = np.maximum(np.partition(acc, n - k, axis=1)[:, n - k] - less, floors[active]) - more
            possible = acc >= bar[:, None]
            done = (possible.sum(1) <= max(8 * k, FEW * n)) | (not rest.any())
            for i in np.flatnonzero(done).tolist():
                found[active[i]] = np.flatnonzero(possible[i])
            acc, active = acc[~done], active[~done]
        return found


def _beyond(score: int) -> str | None:
    """Where a score that no long holds stands among others of its sign, as a text that orders like it."""
    if _LEAST < score < _MOST:
        return None
    digits = f"{len(str(abs(score))):05d}{abs(score)}"
    return digits if score > 0 else digits.translate(str.maketrans("0123456789", "9876543210")) + "~"


def _answer(block: tuple[np.ndarray, np.ndarray, Index | None], batch: pa.RecordBatch, k: int, scale: int) -> list[tuple]:
    """(query_id, query_hash, vec_id, score, beyond) of each query's k best in the block."""
    ids, rows, index = block
    qids, hashes, floors = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "h", "floor"))
    asked = quantised(_matrix(batch.column("v"), rows.shape[1]), scale)
    wide = index is None or asked.dtype == object or (rows.size and int(np.abs(rows).max()) * int(np.abs(asked).sum(1).max(initial=0)) >= 1 << 62)
    # rows with the query's own id take no part, so as many more may stand before the k-th
    own = np.unique(ids[np.isin(ids, qids)], return_counts=True)[1].max(initial=0)
    every = np.arange(len(ids))
    reach = min(len(ids), k + int(own))
    among = [every] * len(qids) if wide or len(ids) <= 4 * k else index.candidates(asked, reach, floors)
    out = []
    for qid, h, query, floor, at in zip(qids.tolist(), hashes.tolist(), asked, floors.tolist(), among, strict=True):
        at = at[ids[at] != qid]
        score = rows[at].astype(object) @ query.astype(object) if wide else rows[at] @ query
        if not len(query):
            score = np.zeros(len(at), np.int64)
        best = sorted(range(len(at)), key=lambda i: (-score[i], ids[at[i]]))[:k] if wide else np.lexsort((ids[at], -score))[:k]  # noqa: B023
        for i in best:
            s = int(score[i])
            if s >= floor:
                out.append((qid, h, int(ids[at[i]]), min(max(s, _LEAST), _MOST), _beyond(s)))
    return out


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dims)


def _blocks(batches: Iterator[pa.RecordBatch], k: int, scale: int, queries: int) -> Iterator[pa.RecordBatch]:
    """Answers of blocks whose rows come in order: its candidates (n copies each), then the queries put to it."""
    key, held, block = None, [], None

    def built() -> tuple[np.ndarray, np.ndarray, Index | None]:
        table = pa.concat_batches(held)
        ids = np.asarray(table.column("id").to_numpy())
        rows = quantised(_matrix(table.column("v"), key[0]), scale)
        return ids, rows, Index(rows) if rows.dtype != object and rows.size else None

    for batch in batches:
        dims, c, asks = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("dims", "c", "asks"))
        cuts = np.flatnonzero((dims[1:] != dims[:-1]) | (c[1:] != c[:-1]) | (asks[1:] != asks[:-1])) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(c)], strict=True):
            if s == e:
                continue
            if (int(dims[s]), int(c[s])) != key:
                key, held, block = (int(dims[s]), int(c[s])), [], None
            if not asks[s]:
                held.append(batch.slice(s, e - s))
                continue
            if not held:
                continue
            block = block or built()
            for at in range(s, e, queries):
                out = _answer(block, batch.slice(at, min(queries, e - at)), k, scale)
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:4]), pa.array(cols[4], pa.string())], ["query_id", "query_hash", "vec_id", "score", "beyond"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `is_query` marks its k best others by integer inner product.

    Components x become floor(scale * x). Ties go to the smaller id. Vectors that are null or hold null or non-finite
    components, and rows with a null id, take no part; only vectors of equal length meet, and empty ones score 0.
    Every finite component counts exactly, however large: blocks that need more than 64 bits are summed in unbounded
    integers, and a score that no long holds is ranked by its value and given as the nearest long. Rows with the
    query's id are its own. Repeated rows are each a candidate; a query row that is repeated is answered once, two
    queries that share an id but not the vector each for itself. `is_query` may use the id column, named id.
    """
    spark = vectors.sparkSession
    small_batches(spark, 10_000)
    # places are written down, so that a row's block stays the same however often its task runs
    rows = whole(vectors, id_col, vector_col).select("id", "v", F.monotonically_increasing_id().alias("place"), is_query.alias("asks"))
    rows = materialise(rows, "topk-rows")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = rows.count()
    blocks = max(1, -(-n // candidates), min(parts, n // 1024))
    dims = F.size("v").alias("dims")
    left = rows.select(dims, F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int").alias("c"), F.lit(False).alias("asks"), "id", F.lit(0).cast("long").alias("h"), F.lit(0.0).alias("floor"), "v")
    asked = rows.where("asks").select(dims, "id", F.xxhash64("v").alias("h"), "v").dropDuplicates(["id", "h"])

    def answered(cands: DataFrame, asking: DataFrame) -> DataFrame:
        both = cands.union(asking.select(*cands.columns)).repartition(max(1, min(parts, blocks)), "dims", "c").sortWithinPartitions("dims", "c", "asks")
        return both.mapInArrow(lambda it: _blocks(it, k, scale, queries), _OUT)

    best = Window.partitionBy("query_id", "query_hash").orderBy(F.col("score").desc(), F.col("beyond").desc_nulls_last(), "vec_id")
    put = asked.withColumn("asks", F.lit(True))
    if blocks == 1:
        found = answered(left, put.withColumn("c", F.lit(0)).withColumn("floor", F.lit(float("-inf"))))
    else:
        first = materialise(answered(left.where("c = 0"), put.withColumn("c", F.lit(0)).withColumn("floor", F.lit(float("-inf")))), "topk-first")
        bound = first.groupBy("query_id", "query_hash").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        floor = F.when(F.col("n") >= k, F.col("least").cast("double") * F.when(F.col("least") > 0, 1 - 1e-12).otherwise(1 + 1e-12)).otherwise(float("-inf"))
        known = put.join(bound, (F.col("id") == F.col("query_id")) & (F.col("h") == F.col("query_hash")), "left").withColumn("floor", floor)
        found = first.union(answered(left.where("c > 0"), known.withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(blocks - 1))))))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
