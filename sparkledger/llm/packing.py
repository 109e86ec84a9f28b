"""Best-fit packing by hierarchical residual packing.

Every partition packs its pieces best-fit, longest first, a bounded chunk at a time. Bins whose free room is at most
`slack` are closed; the others go on as items of the next level, where fewer and fewer groups pack them again, best
fit, until one group holds all that is left or a level no longer saves bins. No task ever holds more than a chunk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkledger.llm.base import materialise, small_batches
from sparkledger.llm.tokens import encoder

#: Items that one task packs at once, at every level.
CHUNK = 50_000
_MEMBER = "id {0}, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): every document's ids and `end_id`, cut only if longer than `capacity`.

    Of a cut document every piece but the first has `capacity` ids. A null or empty text is the end id alone.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer).ids
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                all_ids = np.append(ids(text.as_py()), np.uint32(end_id)).astype("<u4")
                at, k = 0, len(all_ids) % capacity or capacity
                while at < len(all_ids):
                    row.append(i)
                    piece.append(piece[-1] + 1 if at else 0)
                    start.append(at)
                    length.append(k)
                    crc.append(zlib.crc32(all_ids[at : at + k].tobytes()))
                    at, k = at + k, capacity
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, _MEMBER.format(kind))


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Indices of the items of each bin: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        if fit := rooms >> n:
            room = n + (fit & -fit).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        if left := room - n:
            with_room[left].append(at)
            rooms |= 1 << left
    return bins


def _packer(capacity: int, slack: int, chunk: int):
    """Packs (fill, members) rows into (fill, members, closed) bins, `chunk` at a time; open bins meet the next chunk."""

    def pack(table: pa.Table, last: bool) -> tuple[pa.Table, pa.Table]:
        table = table.combine_chunks()
        fills, members = table["fill"].to_numpy(), table["members"].combine_chunks()
        bins = best_fit(fills, capacity)
        order = np.fromiter((i for b in bins for i in b), np.int64)
        picked = members.take(pa.array(order))
        counts = np.diff(picked.offsets.to_numpy())
        firsts = np.cumsum([0, *map(len, bins)])
        ends = np.concatenate(([0], np.cumsum(counts)))[firsts]
        fill = np.add.reduceat(fills[order], firsts[:-1]) if len(bins) else np.empty(0, np.int64)
        out = pa.table({"fill": pa.array(fill, pa.int64()), "members": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), picked.flatten()), "closed": pa.array(fill >= capacity - slack)})
        closed = out["closed"].to_numpy()
        return (out, table[:0]) if last else (out.filter(pa.array(closed)), out.filter(pa.array(~closed)).select(["fill", "members"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows >= chunk:
                out, rest = pack(pa.concat_tables([h.cast(held[0].schema) for h in held]), False)
                if rest.num_rows > chunk // 2:  # what can't be filled here goes on to the next level
                    yield from pa.concat_tables([out, rest.append_column("closed", pa.array(np.zeros(rest.num_rows, bool)))]).to_batches(5000)
                    rest = rest[:0]
                else:
                    yield from out.to_batches(5000)
                held, rows = ([rest.cast(held[0].schema)], rest.num_rows) if rest.num_rows else ([], 0)
        if rows:
            yield from pack(pa.concat_tables([h.cast(held[0].schema) for h in held]), True)[0].to_batches(5000)

    return run


def pack(items: DataFrame, capacity: int = 2048, slack: int = 4, chunk: int = CHUNK) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for pieces as pieces() gives them (kept on disk).

    Pieces of `capacity` are sequences of their own. Sequences hold at most `capacity` ids, gapless from offset 0.
    Which piece meets which is decided by length alone, so ids may be null or repeated. No rows give no rows.
    """
    member = items.schema.simpleString()
    cols = items.columns
    full = items.where(F.col("length") == capacity).select("*", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    level = items.where(F.col("length") < capacity).select(F.col("length").alias("fill"), F.array(F.struct(*cols)).alias("members"))
    shape = f"fill long, members array<{member}>, closed boolean"
    done: DataFrame | None = None
    before = None
    while True:
        packed = materialise(level.mapInArrow(_packer(capacity, slack, chunk), shape), "packing")
        left = packed.where("NOT closed").count()
        groups = -(-left // chunk)
        last = left == 0 or before == 1 or (before is not None and left > 0.99 * before_left)
        part = packed if last else packed.where("closed")
        done = part if done is None else done.union(part)
        if last:
            break
        before, before_left = groups, left
        open_bins = packed.where("NOT closed").select("fill", "members")
        level = open_bins.coalesce(1) if groups == 1 else open_bins.repartition(groups, F.xxhash64("members"))
    flat = done.select((F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            counts = np.diff(lists.offsets.to_numpy())
            rows = lists.flatten()
            lengths = rows.field("length").to_numpy()
            ends = np.concatenate(([0], np.cumsum(lengths)))
            firsts = ends[np.concatenate(([0], np.cumsum(counts)))[:-1]]
            yield pa.RecordBatch.from_arrays([*(rows.field(c) for c in cols), pa.array(np.repeat(b.column(0).to_numpy(), counts)), pa.array(ends[:-1] - np.repeat(firsts, counts))], [*cols, "sequence_id", "offset"])

    return full.union(flat.mapInArrow(run, f"{member[7:-1]},sequence_id:bigint,offset:bigint"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", slack: int = 4) -> DataFrame:
    """Whole documents packed: (id_col, piece, start, length, ids_crc32, sequence_id, offset)."""
    cut = materialise(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    return pack(cut, capacity, slack).withColumnRenamed("id", id_col)
