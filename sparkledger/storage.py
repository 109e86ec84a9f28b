"""Storage that driver and executors share, and the library's own sources on the executors."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local session (tests) may leave it unset; it then gets a temporary folder for the life of the process.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="sparkledger-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path below shared_dir() that nothing has used before, in a folder of this application's own."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sparkledger/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df, written to shared storage and read back: lineage ends there, and a lost executor costs a re-read."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote for df; only once nothing lazy reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete every table and archive that this application has put on shared storage.

    Results are lazy and read those tables, so call it once the last of them is written or collected. The library's
    own sources stay, as executors that start later fetch them.
    """
    _delete(spark, _own_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ship_package(spark: SparkSession | None = None) -> None:
    """Send this package's sources to the executors, once a Spark context, so that it need not be installed there."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or getattr(spark.sparkContext, "_sparkledger_shipped", False):
        return
    top, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    path = f"{shared_dir(spark)}/sparkledger/code-{uuid.uuid4().hex}/sparkledger.zip"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(packed.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._sparkledger_shipped = True
