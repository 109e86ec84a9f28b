"""Brown class-based bigram language model.

Words belong to classes; P(word | previous word) = P(class | previous class) * P(word | class). Exchange clustering
assigns the classes of all training words: each moves to the class that most raises the likelihood of the class bigrams,
until a round of all words raises it by less than a thousandth. The `own_words` most frequent words and the end token are exchanged one
after another on the driver, at first with all other words in groups by word ending. Then every word takes part, however
rare: the most frequent others from their counts by class, the rest in buckets of the workers from their neighbours,
all at once by the class bigrams of the round. If that hardly raises the likelihood, half as many move at a time; a round
that lowers it is taken back.

Words beyond the `head_words` most frequent stay a distributed table. They get numbers in shuffled joins, and the
driver and each worker hold the classes of all words, one byte a distinct word and copy. Words that training lacks go by their endings.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count as forever
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkledger.llm.base import discard, materialise, small_batches

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words that a worker counts before it hands its counts on, and bytes up to which a word can be a head word.
FLUSH, HEAD_BYTES = 200_000, 64
#: The end token, which no word equals.
END = b""
#: Words from which whole documents are looked up together; a longer document is looked up alone.
STRETCH = 50_000
#: Tokens from which stretches are stored together, words whose counts by class the driver holds, and neighbours in a bucket of other words.
CHUNK, DENSE, BUCKET = 300_000, 30_000, 1_000_000
#: The least relative rise of the likelihood by a round of all words, below which half as many move at a time, at last one in LEAST.
RAISE, LEAST = 1e-3, 4


def words(text: str | None) -> list[bytes]:
    """Lower-case (A-Z only) words of a text: runs without ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def stretches(texts: pa.Array) -> Iterator[list[bytes]]:
    """The words of documents one after another, an end token before the first and after each of them."""
    out = [END]
    for t in texts:
        out += words(t.as_py())
        out.append(END)
        if len(out) > STRETCH:
            yield out
            out = [END]
    if len(out) > 1:
        yield out


def ending(word: bytes, groups: int) -> int:
    """The group of a word's last three bytes."""
    return zlib.crc32(word[-3:]) % groups


def word_counts(docs: DataFrame, text_col: str = "text", groups: int = 256) -> DataFrame:
    """(word, ending, c): occurrences of each word, and of the end token once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array([ending(w, groups) for w in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["word", "ending", "c"])
            seen.clear()
            return out

        for b in batches:
            for t in b.column(0):
                seen.update(words(t.as_py()))
                seen[END] += 1
                if len(seen) > FLUSH:
                    yield flush()
        if seen:
            yield flush()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, ending int, c long").groupBy("word", "ending").agg(F.sum("c").alias("c"))


def g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(grid: np.ndarray) -> float:
    """What the classes add to the log likelihood, from the counts of class bigrams."""
    return float(g(grid).sum() - g(grid.sum(1)).sum() - g(grid.sum(0)).sum())


def exchange(pairs: np.ndarray, classes: int, rounds: int | None = None, start: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
    """The class of each item, given how often item j follows item i. Item 0 keeps class 0 to itself; without `rounds` it runs until no round raises the likelihood.

    `start` is where to start if there are other items, whose classes stay: classes, counts of classes after and before
    each item, and class bigrams.
    """
    n = len(pairs)
    if start:
        of, to, by, grid = (x.copy() for x in start)
    else:
        of = np.concatenate(([0], 1 + np.arange(n - 1) % max(1, classes - 1)))
        to, by = np.zeros((n, classes)), np.zeros((n, classes))
        for c in range(classes):
            to[:, c], by[:, c] = pairs[:, of == c].sum(1), pairs[of == c].sum(0)
        grid = np.zeros((classes, classes))
        for c in range(classes):
            grid[c] = to[of == c].sum(0)

    reached = -np.inf
    for _ in forever() if rounds is None else range(rounds):
        moved = 0
        for w in range(1, n):
            a, own = of[w], pairs[w, w]
            right, left = to[w].copy(), by[w].copy()
            if not right.sum() and not left.sum():
                continue
            grid[a] -= right
            grid[:, a] -= left
            grid[a, a] += own
            right[a] -= own
            left[a] -= own
            r, c = grid.sum(1), grid.sum(0)
            new_r, new_c = grid + right, grid + left[:, None]
            gain = (g(new_r) - g(grid)).sum(1) + (g(new_c) - g(grid)).sum(0)
            d = np.diag(grid)
            gain += g(d + right + left + own) - g(d + right) - g(d + left) + g(d)
            gain -= g(r + right.sum() + own) - g(r) + g(c + left.sum() + own) - g(c)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-7:
                b = a
            right[b] += own
            left[b] += own
            grid[b] += right
            grid[:, b] += left
            grid[b, b] -= own
            if b != a:
                moved += 1
                of[w] = b
                to[:, a] -= pairs[:, w]
                to[:, b] += pairs[:, w]
                by[:, a] -= pairs[w]
                by[:, b] += pairs[w]
        # equal classes may swap items for ever, by the last digits of a gain of nothing
        before, reached = reached, likelihood(grid)
        if not moved or reached - before <= 1e-9 * abs(reached):
            break
    return of


@dataclass
class Model:
    """What the workers need: bounded by head_words, groups and classes."""

    groups: int
    train_tokens: int
    distinct: int
    head: dict[bytes, int] = field(default_factory=dict)
    head_log: np.ndarray = field(default_factory=lambda: np.zeros(0))
    item_of: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    #: Classes of the items: the end token, head words, unknown words by ending, and each class once.
    of: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    log_step: np.ndarray = field(default_factory=lambda: np.zeros((1, 1)))
    log_size: np.ndarray = field(default_factory=lambda: np.zeros(1))
    #: The word counts with classes; on the driver only.
    counts: DataFrame | None = field(default=None, repr=False)
    _further: dict[bytes, int] | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counts": None, "_further": None}

    def place(self, own: int) -> None:
        """Give the first `own` head words items of their own, all other words the item of their ending."""
        first, endings = 1 + own, [1 + own + g for g in range(self.groups)]
        of_head = [1 + i if i < own else first + ending(w, self.groups) for i, w in enumerate(self.head)]
        self.item_of = np.array(of_head + endings[::-1] + [0], np.int32)

    def codes(self, toks: list[bytes]) -> np.ndarray:
        """Of head words their index, of the end token -1, of any other word -2 less its ending: places in item_of."""
        out = np.fromiter(map(self.head.get, toks, repeat(-1)), np.int32, len(toks))
        rest = np.flatnonzero(out < 0)
        out[rest] = [-2 - ending(toks[i], self.groups) if toks[i] else -1 for i in rest.tolist()]
        return out

    def items(self, toks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Codes and items of words and end tokens; the end token, and it alone, is item 0. For the driver, as training words beyond the head are looked up in the table."""
        at = self.codes(toks)
        item = self.item_of[at]
        beyond = np.flatnonzero(at < -1).tolist()
        if beyond and self.counts is not None:
            known = self._beyond({toks[i] for i in beyond})
            for i in beyond:
                item[i] = known.get(toks[i], item[i])
        return at, item

    def _beyond(self, asked: set[bytes]) -> dict[bytes, int]:
        """Items of the training words among those asked for; a small table is read once."""
        rows = self.counts.select("word", "class")
        first = len(self.of) - len(self.log_size)
        if self.distinct > DENSE:
            rows = rows.where(F.col("word").isin([w.decode("utf-8", "surrogatepass") for w in asked]))
        elif self._further is not None:
            return self._further
        found = {r["word"].encode("utf-8", "surrogatepass"): first + r["class"] for r in rows.collect()}
        if self.distinct <= DENSE:
            self._further = found
        return found


def encoded(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(chunk, n, codes, others): the documents in chunks of n codes, compressed, each from end token to end token.

    A code is a head word's index, -1 for the end token, or -2 less the place of the word among the chunk's `others`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, parts, size, place = shared.value.head, [], 0, defaultdict(forever().__next__)

        def pack() -> pa.RecordBatch:
            seq = np.concatenate(parts)
            names = pa.array(list(place), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array([len(seq)], pa.int64()), pa.array([pa.compress(seq, codec="zstd", asbytes=True)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)], ["n", "codes", "others"])

        for b in batches:
            for toks in stretches(b.column(0)):
                out = np.fromiter(map(head.get, toks, repeat(-1)), np.int32, len(toks))
                rest = np.flatnonzero(out < 0)
                out[rest] = [-2 - place[toks[i]] if toks[i] else -1 for i in rest.tolist()]
                parts.append(out[1:] if parts else out)
                size += len(out)
                if size > CHUNK or len(place) > FLUSH:
                    yield pack()
                    parts, size, place = [], 0, defaultdict(forever().__next__)
        if parts:
            yield pack()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "n long, codes binary, others array<string>").withColumn("chunk", F.monotonically_increasing_id())


def unpacked(n: pa.Scalar, packed: pa.Scalar) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed.as_py(), 4 * n.as_py(), codec="zstd"), np.int32)


def item_pairs(chunks: DataFrame, model: Model, n_items: int) -> DataFrame:
    """(i, j, n): how often item j follows item i in the encoded documents."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = shared.value, np.zeros(n_items * n_items, np.int32)
        first = len(m.head)
        for b in batches:
            for n, packed, others in zip(*b.columns, strict=True):
                seq = unpacked(n, packed)
                near = [ending(w, m.groups) for w in others.values.cast(pa.binary()).to_pylist()]
                # head words, then the chunk's other words from the last, then the end token
                of = np.concatenate((m.item_of[:first], m.item_of[-2 - np.array(near[::-1], np.int64)], m.item_of[-1:])).astype(np.int64)
                item = of[seq]
                np.add.at(total, item[:-1] * n_items + item[1:], np.int32(1))
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part // n_items, pa.int32()), pa.array(part % n_items, pa.int32()), pa.array(total[part].astype(np.int64))], ["i", "j", "n"])

    return chunks.select("n", "codes", "others").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))


def numbered(chunks: DataFrame, ids: DataFrame, heads: int) -> DataFrame:
    """(n, codes): the chunks with the number of each word: 0 for the end token, head words from 1, then `ids` (word, id) for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, packed, found in zip(*b.columns, strict=True):
                seq = unpacked(n, packed)
                flat = found.values
                k, number = (flat.field(c).to_numpy() for c in (0, 1)) if flat is not None else (np.zeros(0, np.int32), np.zeros(0, np.int32))
                of = np.zeros(heads + len(k) + 1, np.int32)
                of[:heads] = np.arange(1, heads + 1)
                of[-2 - k] = number
                out.append(pa.compress(of[seq], codec="zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["n", "codes"])

    found = chunks.select("chunk", F.posexplode("others").alias("k", "word")).join(ids, "word").groupBy("chunk").agg(F.collect_list(F.struct("k", "id")).alias("found"))
    return chunks.join(found, "chunk", "left").select("n", "codes", "found").mapInArrow(run, "n long, codes binary")


def neighbours(seqs: DataFrame, edges: np.ndarray) -> DataFrame:
    """(bucket, n, links): of the words edges[bucket] <= w < edges[bucket + 1], all neighbours: w - edges[bucket] and, with the highest bit for those after it, the neighbour's number."""
    cuts = edges.astype(np.int64) << 32

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, packed in zip(*b.columns, strict=True):
                seq = unpacked(n, packed).astype(np.int64)
                left, right = seq[:-1], seq[1:]
                first, last = np.flatnonzero(left >= edges[0]), np.flatnonzero(right >= edges[0])
                keys = np.sort(np.concatenate((left[first] << 32 | 1 << 31 | right[first], right[last] << 32 | left[last])))
                at = np.searchsorted(keys, cuts)
                some = np.flatnonzero(np.diff(at)).tolist()
                out = [pa.compress(np.ascontiguousarray(np.stack((keys[at[k] : at[k + 1]] - cuts[k] >> 32, keys[at[k] : at[k + 1]] & 0xFFFFFFFF)).astype(np.uint32)), codec="zstd", asbytes=True) for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.diff(at)[some], pa.int64()), pa.array(out, pa.binary())], ["bucket", "n", "links"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def pack() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(parts))
            out = np.stack((keys >> 32, keys & 0xFFFFFFFF)).astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([pa.compress(out, codec="zstd", asbytes=True)], pa.binary())], ["bucket", "n", "links"])

        for b in batches:
            for bucket, n, packed in zip(*b.columns, strict=True):
                if parts and bucket.as_py() != now:
                    yield pack()
                    parts = []
                now, (w, other) = bucket.as_py(), unpacked_links(n, packed)
                parts.append(w.astype(np.int64) << 32 | other)
        if parts:
            yield pack()

    # not collected by an aggregation, which would hold a task's links in memory
    schema = "bucket int, n long, links binary"
    return seqs.mapInArrow(split, schema).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, schema)


def unpacked_links(n: pa.Scalar, packed: pa.Scalar) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed.as_py(), 8 * n.as_py(), codec="zstd"), np.uint32).reshape(2, -1)


def contexts(seqs: DataFrame, of: np.ndarray, dense: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the first `dense` words, how often each class stands before (column c) and after (classes + c) them; and how often class j follows class i."""
    shared, wide, rows = seqs.sparkSession.sparkContext.broadcast(of), 2 * classes, 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, grid, class_of = np.zeros(dense * wide, np.int32), np.zeros(classes * classes, np.int64), shared.value
        some = False
        for b in batches:
            for n, packed in zip(*b.columns, strict=True):
                some, seq = True, unpacked(n, packed)
                path = class_of[seq].astype(np.int64)
                grid += np.bincount(path[:-1] * classes + path[1:], minlength=classes * classes)
                base = seq.astype(np.int64) * wide
                here = seq < dense
                np.add.at(total, (base[1:] + path[:-1])[here[1:]], np.int32(1))
                np.add.at(total, (base[:-1] + path[1:] + classes)[here[:-1]], np.int32(1))
        if some:
            parts = [total[k : k + rows * wide] for k in range(0, len(total), rows * wide)]
            out = [pa.compress(p.astype(np.int64) if p is grid else p, codec="zstd", asbytes=True) for p in [*parts, grid]]
            yield pa.RecordBatch.from_arrays([pa.array([*range(len(parts)), -1], pa.int32()), pa.array(out, pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, found in zip(*b.columns, strict=True):
                k = part.as_py()
                size, kind = (classes * classes, np.int64) if k < 0 else (min(rows, dense - k * rows) * wide, np.int32)
                out = np.zeros(size, np.int64)
                for x in found.values:
                    out += np.frombuffer(pa.decompress(x.as_py(), size * np.dtype(kind).itemsize, codec="zstd"), kind)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pa.compress(out, codec="zstd", asbytes=True)], pa.binary())], ["part", "counts"])

    found = seqs.mapInArrow(run, "part int, counts binary").groupBy("part").agg(F.collect_list("counts").alias("counts")).mapInArrow(add, "part int, counts binary").toArrow()
    near, grid = np.zeros(dense * wide, np.int64), np.zeros(classes * classes, np.int64)
    for part, x in zip(found["part"].to_pylist(), found["counts"], strict=True):
        at = grid if part < 0 else near[part * rows * wide : (part + 1) * rows * wide]
        at[:] = np.frombuffer(pa.decompress(x.as_py(), 8 * len(at), codec="zstd"), np.int64)
    shared.unpersist()
    return near.reshape(dense, wide), grid.reshape(classes, classes).astype(float)


def better(near: np.ndarray, now: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The class, not the end's, that most raises the likelihood of the class bigrams `grid`, for words now in classes `now`.

    A word's neighbours before it are rows of the grid, those after it columns; class totals pay for its size. Half of
    what the word itself adds to its class is taken off, so that staying is worth what leaving would cost.
    """
    classes = len(grid)
    cells, size = np.concatenate((grid, grid.T)) + 0.5, (grid.sum(0) + 1, grid.sum(1) + 1)
    by, to = near[:, :classes].sum(1), near[:, classes:].sum(1)
    out = near @ np.log(cells) - np.outer(by, np.log(size[0])) - np.outer(to, np.log(size[1]))
    w, code = np.nonzero(near)
    n, cell = near[w, code], cells[code, now[w]]
    stay = np.bincount(w, n * np.log(1 - n / 2 / np.maximum(cell, n)), len(near)).astype(float)
    for part, total in ((by, size[0][now]), (to, size[1][now])):
        stay -= part * np.log(1 - part / 2 / np.maximum(total, np.maximum(part, 1)))
    at = np.arange(len(near))
    out[at, now] += stay
    out[:, 0] = -np.inf
    best = np.argmax(out, 1)
    return np.where((out[at, best] > out[at, now] + 1e-7) & (by + to > 0), best, now).astype(now.dtype)


def moved(links: DataFrame, of: np.ndarray, grid: np.ndarray, edges: np.ndarray, min_count: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket, and the classes that its words would move to; those with fewer than `min_count` occurrences stay."""
    shared, classes = links.sparkSession.sparkContext.broadcast(of), len(grid)
    wide, rows = 2 * classes, 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of = shared.value
        for b in batches:
            for bucket, n, packed in zip(*b.columns, strict=True):
                k = bucket.as_py()
                w, other = unpacked_links(n, packed)
                code = class_of[other & 0x7FFFFFFF] + (other >> 31).astype(np.int64) * classes
                now = class_of[edges[k] : edges[k + 1]]
                out, at = now.copy(), np.searchsorted(w, np.arange(0, len(now) + rows, rows))
                for i in range(len(at) - 1):
                    a, z, first = at[i], at[i + 1], i * rows
                    here = now[first : first + rows]
                    near = np.bincount((w[a:z].astype(np.int64) - first) * wide + code[a:z], minlength=len(here) * wide).reshape(-1, wide).astype(np.float32)
                    to = near[:, classes:].sum(1)
                    out[first : first + rows] = np.where(to >= min_count, better(near, here, grid32), here)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pa.compress(out, codec="zstd", asbytes=True)], pa.binary())], ["bucket", "classes"])

    grid32 = grid.astype(np.float32)
    found = links.mapInArrow(run, "bucket int, classes binary").toArrow()
    for k, x in zip(found["bucket"].to_pylist(), found["classes"], strict=True):
        yield k, np.frombuffer(pa.decompress(x.as_py(), int(edges[k + 1] - edges[k]) * of.dtype.itemsize, codec="zstd"), of.dtype)
    shared.unpersist()


def by_ending(ids: DataFrame, of_ending: np.ndarray, of: np.ndarray) -> None:
    """Put the class of their ending into `of` for the words of `ids` (id, ending), one byte a word at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            number, out = b.column(0).to_numpy(), of_ending[b.column(1).to_numpy()]
            cuts = np.flatnonzero(np.diff(number, prepend=number[:1] - 2) != 1).tolist()
            parts = [out[a:z].tobytes() for a, z in zip(cuts, [*cuts[1:], len(out)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(number[cuts], pa.int64()), pa.array(parts, pa.binary())], ["first", "classes"])

    found = ids.select("id", "ending").mapInArrow(run, "first long, classes binary").toArrow()
    for first, x in zip(found["first"].to_pylist(), found["classes"], strict=True):
        part = np.frombuffer(x.as_py(), of.dtype)
        of[first : first + len(part)] = part


def exchanged(seqs: DataFrame, links: DataFrame | None, of: np.ndarray, pairs: np.ndarray, frozen: np.ndarray, dense: int, edges: np.ndarray, classes: int, min_count: int, rounds: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all words and the class bigrams, from classes `of`, when no round raises the likelihood by RAISE any more (or after `rounds`). `pairs` are those of the first words, `frozen` marks words among the first `dense` that stay."""
    own = len(pairs)
    reached, kept, kept_grid, planned, share = -np.inf, of, None, of, 1
    for turn in forever():
        near, grid = contexts(seqs, of, dense, classes)
        now = likelihood(grid)
        if now - reached <= RAISE * abs(now):
            share *= 2
        if now > reached:
            reached, kept, kept_grid = now, of, grid
        if share > LEAST or turn == rounds:
            break
        if kept is of:
            planned = of.copy()
            start = of[:own].astype(np.int64), near[:own, classes:].astype(float), near[:own, :classes].astype(float), grid
            rest = better(near[own:].astype(float), of[own:dense], grid)
            planned[:own], planned[own:dense] = exchange(pairs, classes, 1, start), np.where(frozen[own:], of[own:dense], rest)
            if links is not None:
                for k, part in moved(links, of, grid, edges, min_count):
                    planned[edges[k] : edges[k + 1]] = part
            if (planned == of).all():
                break
        # one in `share` of the moves, drawn anew each time, once all of them together go too far
        of = planned.copy()
        for k in range(0, len(of) if share > 1 else 0, 1 << 20):
            part = np.arange(k, min(len(of), k + (1 << 20)), dtype=np.uint32)
            stay = (part * np.uint32(2654435761) + np.uint32(turn * 40503)) >> np.uint32(16) & np.uint32(share - 1) != 0
            of[k : k + len(part)][stay] = kept[k : k + len(part)][stay]
    return kept, kept_grid


def fit(docs: DataFrame, text_col: str = "text", classes: int = 48, own_words: int = 1000, groups: int = 256, head_words: int = 200_000, rounds: int | None = None, min_count: int = 1) -> tuple[Model, DataFrame]:
    """The model of all `docs`, and its word counts (word, ending, c, class) on shared storage.

    Counts and classes cover every document and every word; words with fewer than `min_count` occurrences would keep the
    class of their ending. An empty table gives a model that knows no word.
    """
    small_batches(docs.sparkSession)
    counts = materialise(word_counts(docs, text_col, groups).withColumn("m", F.monotonically_increasing_id()), "brown-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # at most 16 * head_words words can occur total / (16 * head_words) times; among them the least count that few enough reach
    short = counts.where((F.col("c") >= max(1, -(-total // (16 * head_words)))) & (F.octet_length("word") <= HEAD_BYTES) & (F.col("word") != ""))
    least, n = 1 << 62, 0
    for c, k in sorted(((r.c, r.n) for r in short.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        if (n := n + k) > head_words:
            break
        least = c
    head = short.where(F.col("c") >= least).select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    model = Model(groups, int(total), int(distinct))
    model.head = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(head["word"].to_pylist())}
    head_c = head["c"].to_numpy().astype(np.int64)
    model.head_log = np.log10(head_c + 1.0)
    heads, own = len(head_c), min(own_words, len(head_c))
    chunks = materialise(encoded(docs, model, text_col), "brown-codes")
    model.place(own)
    n_items = 1 + own + groups
    pairs = np.zeros((n_items, n_items))
    found = item_pairs(chunks, model, n_items).toArrow()
    pairs[found["i"].to_numpy(), found["j"].to_numpy()] = found["n"].to_numpy()
    kind = np.uint8 if classes <= 256 else np.int32
    start = exchange(pairs, classes, rounds).astype(kind)
    # numbers of all words: the end token, head words, and a gapless one for each row of the table
    of = np.zeros(1 + heads + distinct, kind)
    of[: 1 + heads] = np.concatenate((start[:1], start[model.item_of[:heads]]))
    starts, at = [], 1 + heads
    for p, k in sorted((r.p, r.n) for r in counts.groupBy(F.shiftright("m", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((int(p), at - (int(p) << 33)))
        at += k
    spark = docs.sparkSession
    offsets = spark.createDataFrame(starts, "p long, base long")
    ids = counts.join(F.broadcast(offsets), F.shiftright("m", 33) == F.col("p")).select("word", "ending", "c", (F.col("m") + F.col("base")).cast("int").alias("id"))
    by_ending(ids, start[1 + own :], of)
    seqs = materialise(numbered(chunks, ids.select("word", "id"), heads), "brown-sequences")
    discard(chunks)
    dense = 1 + min(heads, max(own, DENSE))
    frozen = np.concatenate(([True], head_c[: dense - 1] < min_count))
    # buckets of words with about as many neighbours each
    beyond = int(total - head_c.sum())
    load = np.concatenate((2 * head_c[dense - 1 :], [2 * beyond])).astype(float)
    whole = np.cumsum(load)
    n_buckets = max(1, int(-(-whole[-1] // BUCKET)))
    places = np.concatenate((np.arange(dense, 1 + heads + 1), [len(of)])).astype(float)
    edges = np.unique(np.concatenate(([dense], np.interp(np.arange(1, n_buckets) * whole[-1] / n_buckets, np.concatenate(([0.0], whole)), places).astype(np.int64), [len(of)])))
    links = None
    if len(of) > dense and total:
        links = materialise(neighbours(seqs, edges), "brown-neighbours")
    of, step = exchanged(seqs, links, of, pairs[: 1 + own, : 1 + own], frozen, dense, edges, classes, min_count, rounds)
    if links is not None:
        discard(links)
    discard(seqs)
    classed = materialise(with_classes(ids, model, of), "brown-classes")
    discard(counts)
    # class sizes: occurrences and distinct words
    size = np.ones(classes)
    unknown = np.zeros((groups, classes))
    for r in classed.where(F.col("word") != "").groupBy("ending", "class").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("c"), F.sum((F.col("c") == 1).cast("long")).alias("once")).collect():
        size[r["class"]] += r.v + r.c
        # unknown words are most like those that occur once
        unknown[r.ending, r["class"]] = r.once
    size[0] = 1  # the end class emits the end token alone
    some = unknown.sum(1) > 0
    unknown[~some] = unknown.sum(0)
    unknown[:, 0] = -1
    model.place(heads)
    model.of = np.concatenate((of[: 1 + heads], unknown.argmax(1), np.arange(classes))).astype(np.int64)
    model.counts = classed
    model.log_size = np.log10(size)
    seen = step.sum(0)
    floor = (seen + 1) / (seen.sum() + classes)
    follow, n = (step > 0).sum(1, keepdims=True), step.sum(1, keepdims=True)
    # Witten-Bell: as likely to leave the seen successors as new ones were met
    model.log_step = np.log10((step + np.maximum(follow, 1) * floor) / (n + np.maximum(follow, 1)))
    return model, classed


def with_classes(ids: DataFrame, model: Model, of: np.ndarray) -> DataFrame:
    """(word, ending, c, class) of `ids` (word, ending, c, id)."""
    sc = ids.sparkSession.sparkContext
    shared, class_of = sc.broadcast(model), sc.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, classes = shared.value.head, class_of.value
        for b in batches:
            at = np.fromiter(map(head.get, b.column(0).cast(pa.binary()).to_pylist(), repeat(-1)), np.int64, b.num_rows)
            at = np.where(at >= 0, at + 1, b.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(classes[at].astype(np.int32))], ["word", "ending", "c", "class"])

    return ids.mapInArrow(run, "word string, ending int, c long, class int")


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score), one row a row of `docs`.

    Scores are log10 probabilities of the whole text and its end token: base_score of the add-one unigram model over
    the same counts, score of the class bigram model, whose classes each keep one occurrence for all unknown words.
    Words beyond the head meet their counts and classes in a shuffled join.
    Null and empty texts are the end token alone; ids may be null or repeated; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    end_log = float(np.log10(1.0 + (counts.where(F.col("word") == "").agg(F.sum("c")).first()[0] or 0)))
    unit = float(np.log10(model.train_tokens + model.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            parts, tail, sides, outside = [], [], [], []
            for toks in stretches(b.column(2)):
                at = m.codes(toks)
                path, inside, out = m.of[m.item_of[at]], at >= 0, at < -1
                ends = np.flatnonzero(at == -1)
                logs = np.where(inside, m.head_log[np.maximum(at, 0)], 0.0) if len(m.head_log) else np.zeros(len(at))
                # steps from or to a word beyond the head wait for its class
                steps = np.where(out[:-1] | out[1:], 0.0, m.log_step[path[:-1], path[1:]]) - np.where(out[1:], 0.0, m.log_size[path[1:]])
                first = ends[:-1]
                parts.append((np.diff(ends), *(np.add.reduceat(x, first) for x in (inside.astype(np.int64), logs, steps))))
                outside.append(np.add.reduceat(out.astype(np.int64), first))
                here = np.flatnonzero(out)
                known = np.where(out, -1, path)
                sides.append(np.stack((path[here], known[here - 1], known[here + 1])))
                tail += [toks[i] for i in here.tolist()]
            n, known, head_sum, steps = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0)] * 4
            cuts = pa.array(np.concatenate(([0], np.cumsum(np.concatenate(outside)))) if outside else [0], pa.int32())
            side = [pa.array(x, pa.int32()) for x in (np.concatenate(sides, 1) if sides else np.zeros((3, 0)))]
            flat = pa.StructArray.from_arrays([pa.array(tail, pa.binary()).cast(pa.string()), *side], ["word", "miss", "left", "right"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(head_sum, pa.float64()), pa.array(steps, pa.float64()), pa.ListArray.from_arrays(cuts, flat)], ["uid", "id", "n", "known", "head", "steps", "tail"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    local = materialise(rows.mapInArrow(run, f"uid long, id {kind}, n long, known long, head double, steps double, tail array<struct<word:string,miss:int,left:int,right:int>>"), "brown-local")
    classes = len(model.log_size)
    table, size = F.lit(model.log_step.ravel()), F.lit(model.log_size)
    rare = counts.where(F.col("word") != "").select("word", "c", "class")
    step = lambda a, b: F.coalesce(F.get(table, F.when((a >= 0) & (b >= 0), a * classes + b)), F.lit(0.0))
    alone = local.select("uid", F.inline("tail")).join(rare, "word", "left")
    own = F.coalesce("class", "miss")
    alone = alone.select("uid", F.log10(F.coalesce("c", F.lit(0)) + 1).alias("logs"), F.col("c").isNotNull().cast("long").alias("met"), (step(F.col("left"), own) + step(own, F.col("right")) - F.get(size, own)).alias("steps"))
    # two words beyond the head one after the other: the second has no class to its left
    twos = F.filter(F.arrays_zip(F.slice("tail", 1, F.size("tail") - 1).alias("a"), F.slice("tail", 2, F.size("tail") - 1).alias("b")), lambda x: x["b"]["left"] < 0)
    both = local.where(F.size("tail") > 1).select("uid", F.explode(twos).alias("x")).select("uid", F.col("x.a.word").alias("word"), F.col("x.a.miss").alias("miss"), F.col("x.b.word").alias("next"), F.col("x.b.miss").alias("next_miss"))
    both = both.join(rare, "word", "left").select("uid", own.alias("first"), F.col("next").alias("word"), F.col("next_miss").alias("miss")).join(rare, "word", "left")
    both = both.select("uid", F.lit(0.0).alias("logs"), F.lit(0).cast("long").alias("met"), step(F.col("first"), own).alias("steps"))
    met = alone.union(both).groupBy("uid").agg(F.sum("logs").alias("logs"), F.sum("met").alias("met"), F.sum("steps").alias("further"))
    known_end = 1 if model.train_tokens else 0
    all_logs = F.col("head") + F.coalesce("logs", F.lit(0.0))
    return local.drop("tail").join(met, "uid", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("met", F.lit(0)) + F.lit(known_end)).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"), (all_logs + F.lit(end_log) - F.col("n") * F.lit(unit)).alias("base_score"),
        (all_logs + F.col("steps") + F.coalesce("further", F.lit(0.0))).alias("score"),
    )


def perplexity(log10_score: float, n_tokens: int) -> float:
    """Perplexity a token of a text with this log10 probability."""
    return 10.0 ** (-log10_score / n_tokens) if n_tokens else 1.0
