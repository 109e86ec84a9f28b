"""Shards of even row counts along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to 2**BITS levels: numbers evenly between the least and the greatest, strings by their
order as whole values, a level each if there are few of them and else by how many rows come before. The levels are a
point of the curve's grid, and rows are ordered by its index there, so a run of the order covers few values of every
dimension and files cut from it can be skipped by any of them. Shards are the runs that put counts at most one apart.

No task sorts the whole order: rows are counted by grid cell (their number is fixed), large cells are cut further by
the hash that orders their rows, and ranks are taken within those pieces, on top of the counts before them. An id (or
null) that holds more rows than a piece should is ordered by row, so that its rows don't share a piece either.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkledger.llm.base import fresh, materialise

#: Bits of a dimension's level. Three dimensions make 4,096 cells.
BITS = 4
#: Pieces into which the rows are cut at least, besides one for each cell.
PIECES = 512


def curve_index(point: tuple[int, ...], bits: int = BITS) -> int:
    """Index of a grid point along the Hilbert curve, by exchanging and inverting low bits level by level."""
    x, dims = list(point), len(point)
    for level in reversed(range(1, bits)):
        mask = (1 << level) - 1
        for i in range(dims):
            if x[i] >> level & 1:
                x[0] ^= mask
            else:
                swap = (x[0] ^ x[i]) & mask
                x[0], x[i] = x[0] ^ swap, x[i] ^ swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = 0
    for level in reversed(range(1, bits)):
        if x[-1] >> level & 1:
            flip ^= (1 << level) - 1
    x = [v ^ flip for v in x]
    return reduce(lambda acc, b: acc << 1 | b, (x[i] >> level & 1 for level in reversed(range(bits)) for i in range(dims)), 0)


def curve_table(dims: int, bits: int = BITS) -> list[int]:
    """The curve index of every cell; a cell's number has the first dimension's level in its highest bits."""
    return [curve_index(tuple(cell >> bits * (dims - 1 - i) & ((1 << bits) - 1) for i in range(dims)), bits) for cell in range(1 << bits * dims)]


def text_bounds(rows: DataFrame, column: str, levels: int = 1 << BITS) -> list[tuple[str, int]]:
    """The values at which a level begins, and that level; in binary order, null counts as empty.

    Up to `levels` distinct values have a level each, evenly apart; of more, a value's level is the share of all rows that come
    before it. Distinct values are summed over ranges of them, so neither a task nor the driver holds them all.
    """
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    sizes = rows.select(value.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialise(sizes.repartitionByRange("v").sortWithinPartitions("v").withColumn("part", F.spark_partition_id()), "shard-values")
    parts = sorted(sizes.groupBy("part").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n")).collect())
    if sum(r.d for r in parts) <= levels:
        few = sorted((r.v for r in sizes.collect()), key=lambda v: v.encode("utf-8", "surrogatepass"))
        return [(v, i * levels // len(few)) for i, v in enumerate(few)]
    total, at, ahead = sum(r.n for r in parts), 0, []
    for r in parts:
        ahead.append((r.part, at))
        at += r.n
    of = rows.sparkSession.createDataFrame(ahead, "part int, ahead long")
    earlier = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("ahead") + F.coalesce(F.sum("n").over(earlier), F.lit(0))
    level = F.floor(before * levels / F.lit(total)).cast("int")
    found = sizes.join(F.broadcast(of), "part").select("v", level.alias("level")).groupBy("level").agg(F.min("v").alias("v")).collect()
    return sorted(((r.v, r.level) for r in found), key=lambda x: x[1])


def text_level(column: Column, bounds: list[tuple[str, int]]) -> Column:
    """The level of a string among the bounds that text_bounds() gives."""
    value = F.coalesce(column.cast("string"), F.lit(""))
    return F.greatest(F.lit(0), F.lit(0), *[F.when(value >= v, level) for v, level in bounds])


def size_position(c: Column) -> Column:
    """A byte size on a scale of eighths of powers of two."""
    return F.floor(F.log2(F.greatest(c, F.lit(1)).cast("double")) * 8).cast("long")


def number_level(c: Column, low: int, high: int) -> Column:
    """The level of a whole number between `low` and `high` (null: the first)."""
    return F.least(F.floor((F.coalesce(c, F.lit(low)) - low) * (1 << BITS) / (high - low + 1)), F.lit((1 << BITS) - 1))


def shard(rows: DataFrame, levels: dict[str, Column], order: Column, shards: int, id_col: str | None = None, pieces: int = PIECES) -> DataFrame:
    """`rows` with columns curve, shard and slot: counts at most one apart, slots gapless from 0 along the curve.

    `levels` are the dimensions, at most four, as whole numbers from 0 to 2**BITS - 1. `order` is a text of hexadecimal
    digits that orders rows with the same curve index, such as a hash of the id; equal ones follow in any order. Ids of
    `id_col` (null ones too) with more rows than a piece has on average are ordered by a hash of the row's place
    instead. Columns that have the names of the new ones are replaced, others pass through whatever they are called.
    An empty table gives an empty table.
    """
    keep = [c for c in rows.columns if c.lower() not in ("curve", "shard", "slot")]
    cells, place, by = fresh(rows.columns, "cell", "place", "by")
    cell = F.lit(0)
    for level in levels.values():
        cell = cell * (1 << BITS) + level.cast("int")
    curve = F.element_at(F.array(*map(F.lit, curve_table(len(levels)))), cell + 1)
    # rows in one column and all else beside it, so that no name of theirs can clash; places are written down once
    marked = materialise(rows.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias(cells), curve.alias("curve"), F.coalesce(order, F.lit("0")).alias(by), F.monotonically_increasing_id().alias(place)), "shard-rows")
    total = marked.count()
    if id_col:
        key = F.col(f"{cells}.`{id_col}`")
        often = marked.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1, total // pieces)).select("k")
        # fewer than `pieces` ids can have more rows than a piece
        often = materialise(often, "shard-often")
        if not often.isEmpty():
            marked = marked.join(F.broadcast(often.withColumn("many", F.lit(True))), key.eqNullSafe(F.col("k")), "left").withColumn(by, F.when(F.col("many"), F.md5(F.concat(F.lit("row "), F.col(place).cast("string")))).otherwise(F.col(by))).drop("k", "many")
    # the share of all hashes below this one, in 2**32ths; cells of many rows are cut by it
    part = F.conv(F.substring(F.rpad(by, 8, "0"), 1, 8), 16, 10).cast("long")
    cuts = marked.groupBy("curve").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * pieces / max(1, total))).cast("long").alias("cuts"))
    cut = marked.join(F.broadcast(cuts), "curve").withColumn("piece", F.floor(part * F.col("cuts") / F.lit(float(1 << 32))).cast("long"))
    before = Window.orderBy("curve", "piece").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cut.groupBy("curve", "piece").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("curve", "piece").orderBy(by, place)
    # as many rows as there are cells and pieces at most, both fixed
    ranked = cut.withColumn("row", F.row_number().over(within)).join(F.broadcast(ahead), ["curve", "piece"]).withColumn("rank", F.col("ahead") + F.col("row") - 1)
    # the first (total % shards) shards have one row more
    small, more = divmod(total, shards)
    edge = more * (small + 1)
    inner = F.col("rank") < edge
    of = F.when(inner, F.floor(F.col("rank") / (small + 1))).otherwise(more + F.floor((F.col("rank") - edge) / max(1, small)))
    start = F.when(inner, of * (small + 1)).otherwise(edge + (of - more) * small)
    return ranked.select(*[F.col(f"{cells}.`{c}`") for c in keep], "curve", of.cast("int").alias("shard"), (F.col("rank") - start).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard, curve), one row a row of `docs`, by language, source and size.

    size is the text's UTF-8 bytes plus one (null texts: one); counts of shards are at most one apart, whatever the
    groups of equal texts; null ids, languages and sources are allowed, repeated rows take slots of their own.
    """
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("crc"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    rows = materialise(rows, "shard-sizes")  # without the texts, which are read once
    ends = rows.agg(F.min(size_position(F.col("size"))).alias("low"), F.max(size_position(F.col("size"))).alias("high")).first()
    levels = {c: text_level(F.col(c), text_bounds(rows, c)) for c in ("lang", "source")}
    levels["size"] = number_level(size_position(F.col("size")), ends.low or 0, ends.high or 0)
    placed = shard(rows, levels, F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), shards, "id")
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(placed: DataFrame, path: str, files: int = 8) -> None:
    """One folder a shard, each with up to `files` files that cover runs of the curve; readers skip files by their statistics."""
    shards = placed.agg(F.max("shard")).first()[0]
    parts = max(1, files * (1 + (shards or 0)))
    placed.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
