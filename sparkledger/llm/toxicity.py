"""Toxicity by a character n-gram linear classifier over naive Bayes log-count ratios.

Every distinct character n-gram of a text is a feature whose value is the log ratio of its rates among toxic and other
labelled texts; a logistic regression over these values gives the score. All n-grams are counted, hashed to 2**BITS
buckets, and a ratio counts by the end of its confidence interval that is nearer to zero, so that it is zero until
counts tell it from chance, however many n-grams there are. Labelled rows are a bounded, class-balanced sample; their
counts and every step of the fit run distributed, so that neither a task nor the driver holds the sample's features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sparkledger.llm.base import discard, materialise, small_batches

#: n-gram sizes, and bits of their hash.
SIZES, BITS = (3, 4, 5, 6), 20
#: Standard errors by which a log ratio is drawn towards zero.
SURE = 2.0
#: Labelled rows of either class that a classifier is fitted on at most.
PER_CLASS = 3000
#: Characters hashed at once.
SPAN = 1 << 20


@dataclass
class Model:
    """weight of each bucket's n-grams (regression weight times log ratio); intercept."""

    weight: np.ndarray
    intercept: float


def _grams(chars: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hashes) of the n-grams of a row of characters, a span at a time."""
    for s in range(0, len(chars), SPAN):
        part = chars[s : s + SPAN + max(SIZES) - 1]
        h = part * np.uint32(2654435761)
        for n in range(2, max(SIZES) + 1):
            if len(part) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(2246822519) + part[n - 1 :] * np.uint32(3266489917)
            if n in SIZES:
                yield n, ((h ^ (h >> np.uint32(13))) * np.uint32(668265263) >> np.uint32(32 - BITS))[:SPAN]


def features(texts: Iterator[str | None], wanted: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct wanted buckets of the n-grams of each lower-cased text; texts up to SPAN characters are hashed together."""
    last, places = np.zeros(1 << BITS, np.int32), np.arange(len(SIZES) * SPAN, dtype=np.int32)
    held: list[str] = []

    def together() -> Iterator[np.ndarray]:
        # n-grams that reach into the next text are hashed too and then left out
        by_size = dict(_grams(np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), "<u4")))
        s = 0
        for t in held:
            e = s + len(t)
            h = np.concatenate([np.empty(0, np.uint32), *(by_size[n][s : max(s, e - n + 1)] for n in SIZES if n in by_size)])
            h = h[wanted[h]]
            at = places[: len(h)]
            last[h] = at
            yield h[last[h] == at]
            s = e

    size = 0
    for text in texts:
        t = (text or "").lower()
        if held and size + len(t) > SPAN:
            yield from together()
            held, size = [], 0
        if len(t) > SPAN:
            seen = np.zeros(1 << BITS, bool)
            for _, h in _grams(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")):
                seen[h] = True
            yield np.flatnonzero(seen & wanted).astype(np.uint32)
            continue
        held.append(t)
        size += len(t)
    if held:
        yield from together()


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """(id, y, t) of at most `per_class` labelled texts a class, first by a hash of the id; and how many have each label.

    A document labelled more than once counts as 1 if any of its labels is. Null ids and labels take no part, other
    columns of either table are not read. Of rows that share an id one is taken.
    """
    marked = labels.where(F.col(label).isin(0, 1)).where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
    marked = materialise(marked, "toxicity-labels")
    n = {r.y: r.n for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("id"), F.col("id")
    picked = materialise(marked.where("y = 1").orderBy(*order).limit(per_class).union(marked.where("y = 0").orderBy(*order).limit(per_class)), "toxicity-picked")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).join(F.broadcast(picked), "id")
    return materialise(texts.groupBy("id", "y").agg(F.min("t").alias("t")), "toxicity-sample"), n


def _minimised(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], n: int, steps: int) -> np.ndarray:
    """A minimum of a smooth convex function of n variables, by limited-memory BFGS from zero."""
    w = np.zeros(n)
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, d, r in reversed(past):
            alphas.append(r * (s @ q))
            q -= alphas[-1] * d
        if past:
            s, d, _ = past[-1]
            q *= (s @ d) / (d @ d)
        for (s, d, r), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - r * (d @ q))
        t, slope = 1.0, -(grad @ q)
        if slope >= 0 or np.abs(grad).max() < 1e-6:
            break
        while t > 1e-6 and (new := loss(w - t * q))[0] > value + 1e-4 * t * slope:
            t /= 4
        if t <= 1e-6:
            break
        s, d = -t * q, new[1] - grad
        gained = value - new[0]
        w, value, grad = w + s, *new
        if s @ d > 1e-12:
            past = [*past[-9:], (s, d, 1 / (s @ d))]
        if gained < 1e-6 * abs(value):
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, ridge: float = 1e-3, steps: int = 40) -> Model:
    """A classifier of `label`, from at most `per_class` labelled documents of each class and all of their n-grams.

    Classes are weighed by how many rows of `labels` have them, so scores are probabilities at that rate. The weighted
    mean logistic loss plus a ridge is minimised in at most `steps` steps, each a sum over the sample by the workers.
    Without rows of both classes, or any n-gram that tells them apart, the score is the share of label 1 (0 without any)
    for every text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts, count = sample(docs, labels, label, id_col, text_col, per_class)
    share = count.get(1, 0) / max(1, sum(count.values()))
    used = {r.y: r.n for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    plain = Model(np.zeros(1 << BITS), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if len(used) < 2:
        return plain

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), np.int32)
        every = np.ones(1 << BITS, bool)
        for b in batches:
            for y, f in zip(b.column(0).to_pylist(), features((t.as_py() for t in b.column(1)), every), strict=True):
                n[y][f] += 1
        at = np.flatnonzero(n.sum(0))
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(n[0][part]), pa.array(n[1][part])], ["h", "n0", "n1"])

    # at most 2 ** BITS rows
    sums = texts.select("y", "t").mapInArrow(counted, "h int, n0 int, n1 int").groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    h, n0, n1 = (sums[c].to_numpy().astype(np.int64) for c in ("h", "n0", "n1"))
    ratio = np.log((n1 + 0.5) / (used[1] + 1)) - np.log((n0 + 0.5) / (used[0] + 1))
    ratio = np.sign(ratio) * np.maximum(0, np.abs(ratio) - SURE * np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5)))
    told = np.flatnonzero(ratio)
    bucket, ratio, n = h[told], ratio[told], len(told)
    if not n:
        return plain
    place = np.full(1 << BITS, -1, np.int32)
    place[bucket] = np.arange(n)
    places = spark.sparkContext.broadcast(place)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = places.value
        for b in batches:
            found = list(features((t.as_py() for t in b.column(1)), of >= 0))
            ends = np.concatenate(([0], np.cumsum([len(f) for f in found])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(of[np.concatenate(found)]))], ["y", "f"])

    rows = materialise(texts.select("y", "t").mapInArrow(present, "y int, f array<int>"), "toxicity-features")
    cost = {k: count[k] / used[k] for k in (0, 1)}
    whole = float(sum(count.values()))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast((w[:-1] * ratio, float(w[-1])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_place, bias = shared.value
            lost, slope, grad = 0.0, 0.0, np.zeros(n)
            for b in batches:
                y, at, sizes = b.column(0).to_numpy(), b.column(1).flatten().to_numpy(), np.diff(b.column(1).offsets.to_numpy())
                z = np.bincount(np.repeat(np.arange(len(y)), sizes), by_place[at], len(y)) + bias
                c = np.where(y == 1, cost[1], cost[0])
                g = c * (0.5 * (1 + np.tanh(z / 2)) - y)
                lost += float((c * (np.logaddexp(0, z) - y * z)).sum())
                slope += float(g.sum())
                grad += np.bincount(at, np.repeat(g, sizes), n)
            yield pa.RecordBatch.from_arrays([pa.array([lost]), pa.array([slope]), pa.array([grad], pa.list_(pa.float64()))], ["lost", "slope", "grad"])

        got = rows.mapInArrow(run, "lost double, slope double, grad array<double>").toArrow()
        shared.destroy()
        grad = np.zeros(n)
        for x in got["grad"].chunks:
            grad += x.flatten().to_numpy().reshape(-1, n).sum(0)
        grad = grad * ratio / whole + ridge * w[:-1]
        return float(sum(got["lost"].to_pylist()) / whole + ridge / 2 * (w[:-1] ** 2).sum()), np.append(grad, sum(got["slope"].to_pylist()) / whole)

    w = _minimised(loss, n + 1, steps)
    discard(rows)
    weight = np.zeros(1 << BITS)
    weight[bucket] = w[:-1] * ratio
    return Model(weight, float(w[-1]))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """`docs` with a column `name`, the probability of label 1 for the whole text; a null or empty text has the intercept's.

    Only the text is read for it. A column that has this name already is replaced; other columns pass through as they are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    keep = [f for f in docs.schema.fields if f.name != name]
    at = next(i for i, f in enumerate(keep) if f.name == text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            wanted = m.weight != 0
            z = np.array([m.weight[f].sum() for f in features((t.as_py() for t in b.column(at)), wanted)]) + m.intercept
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(0.5 * (1 + np.tanh(z / 2)), pa.float64())], [*b.schema.names, name])

    return docs.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(run, StructType([*keep, StructField(name, DoubleType())]))


def is_toxic(score: Column, threshold: float = 0.3) -> Column:
    """1 from the threshold on, else 0."""
    return F.when(score >= threshold, 1).otherwise(0)
