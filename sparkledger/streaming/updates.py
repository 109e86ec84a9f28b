"""Incremental pulls as a stream: upserts by micro-batch, and trends over event time with a watermark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sparkledger.sources.ingest import upsert


#: Parts of an upserted table by hash of the key; a batch rewrites those that it touches.
PARTS = 256
PART = "_part"


def upsert_stream(updates: DataFrame, path: str, checkpoint: str, key: str = "id", at: str = "fetched_at", parts: int = PARTS) -> StreamingQuery:
    """Every micro-batch merged into the table under `path`, last write wins; a repeated batch changes nothing.

    Rows lie in `parts` parts by hash of the key. A batch writes new versions of the parts that it touches, and then a
    manifest that names the version of every part; the newest manifest is the table. Versions that neither it nor the
    one before it names are deleted, so a reader may be one batch behind. `parts` stays as the first batch set it.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = _manifest(spark, path, n)
        of = before["parts"] if before else parts
        rows = batch.withColumn(PART, F.pmod(F.xxhash64(F.col(key)), F.lit(of)).cast("int")).persist()
        try:
            touched = sorted(r[0] for r in rows.select(PART).distinct().collect())
            if not touched:
                return
            versions = before["versions"] if before else {}
            old = _read(spark, path, {p: versions[p] for p in map(str, touched) if p in versions}, batch.schema)
            merged = upsert(old, rows.drop(PART), key, at).withColumn(PART, F.pmod(F.xxhash64(F.col(key)), F.lit(of)).cast("int"))
            merged.repartition(PART).write.mode("overwrite").partitionBy(PART).parquet(f"{path}/v{n:012d}")
        finally:
            rows.unpersist()
        after = {"parts": of, "versions": versions | {str(p): n for p in touched}, "schema": batch.schema.json()}
        _write_manifest(spark, path, n, after)
        _tidy(spark, path, n, [after, before or after])

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The table of the newest manifest below `path`, older than batch `before` if given."""
    found = _manifest(spark, path, before)
    return _read(spark, path, found["versions"], StructType.fromJson(json.loads(found["schema"]))) if found else None


def _read(spark: SparkSession, path: str, versions: dict[str, int], schema: StructType) -> DataFrame:
    """Rows of the parts named, each in its version."""
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/v{n:012d}/{PART}={p}" for p, n in sorted(versions.items())])


def _fs(spark: SparkSession, path: str) -> tuple:
    """A function that makes paths, and the file system that holds `path`."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at, at(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str, first: str) -> list[str]:
    at, fs = _fs(spark, path)
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(at(path))) if n.startswith(first)) if fs.exists(at(path)) else []


def _manifest(spark: SparkSession, path: str, before: int | None) -> dict | None:
    names = [n for n in _names(spark, path, "m") if before is None or int(n[1:]) < before]
    return json.loads(spark.read.text(f"{path}/{names[-1]}", wholetext=True).first()[0]) if names else None


def _write_manifest(spark: SparkSession, path: str, n: int, content: dict) -> None:
    """Written aside and moved, so that a manifest is there whole or not at all."""
    at, fs = _fs(spark, path)
    aside, place = at(f"{path}/_new-m{n:012d}"), at(f"{path}/m{n:012d}")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    fs.delete(place, False)
    if not fs.rename(aside, place):
        raise OSError(f"can't move a manifest to {place.toString()}")


def _tidy(spark: SparkSession, path: str, n: int, kept: list[dict]) -> None:
    """Deletes parts and manifests that the kept manifests don't need."""
    at, fs = _fs(spark, path)
    wanted = {(v, p) for m in kept for p, v in m["versions"].items()}
    older = [int(name[1:]) for name in _names(spark, path, "m") if int(name[1:]) < n]
    for m in older[:-1]:
        fs.delete(at(f"{path}/m{m:012d}"), False)
    for name in _names(spark, path, "v"):
        parts = [p.removeprefix(f"{PART}=") for p in _names(spark, f"{path}/{name}", PART)]
        lost = [p for p in parts if (int(name[1:]), p) not in wanted and int(name[1:]) <= n]
        if len(lost) == len(parts):
            fs.delete(at(f"{path}/{name}"), True)
        else:
            for p in lost:
                fs.delete(at(f"{path}/{name}/{PART}={p}"), True)


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(period, by, n) of a stream or table; events later than the watermark are dropped from a stream."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("date").alias("period"), by, "n")
