"""What the operators of this subpackage share: bounded Arrow batches, checked broadcasts and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkledger.storage import discard, materialise, shared_path, ship_package

__all__ = ["broadcast_if_small", "connected_components", "crc_bucket", "discard", "fresh", "materialise", "shared_path", "small_batches"]

#: Rows and bytes of an Arrow batch between the JVM and Python; texts may be long, so far fewer than Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: A side of a join is broadcast only after its size was counted and is no more than this.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df (materialised) with a broadcast hint if its counted rows take at most `limit` bytes, else for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of this session to `rows` and BATCH_BYTES, so that long texts don't fill a worker's memory.

    Every operator that runs Python on the executors calls this first; it also sends them this package.
    """
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark, key) <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def _bytes(spark: SparkSession, key: str) -> int:
    """A size setting in bytes, whatever its unit; negative ones stand for no bound."""
    value = spark.conf.get(key)
    return -1 if value.startswith("-") else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(value)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like `names` that none of the columns `taken` has, whichever case it is written in."""
    low, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in low:
            n += "_"
        low.add(n.lower())
        out.append(n)
    return out


def crc_bucket(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected `edges`; root is the smallest node of its component.

    Alternating large-star and small-star contraction: each round is a grouped minimum (combined before the shuffle)
    and an equi-join, so a node with very many links is split by adaptive execution and never gathered. Every round is
    written to shared storage. Self-loops give a component of one; null ends are ignored; no edges give no rows.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    loops = links.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("root"))
    both = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = materialise(links.where("u <> v").select(*both).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        around = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node that is its own least neighbour keeps no link downwards, its larger neighbours now point to it
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = materialise(small, "cc")
        sums = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        done = before == tuple(sums)
        before = tuple(sums)
        discard(now)
        now = after
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.groupBy("v").agg(F.lit(1).alias("x")).select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots).union(loops.join(now.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_anti").distinct())
