"""Ingest of JSON records: paged source, typed projection, upsert, incremental marks, change detection and exports."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from pathlib import Path

from pyarrow import fs as pa_fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from sparkledger.functions.text import compact_date, content_hash, ingest_date, record_id

RAW = "id string, source string, report_date date, raw string, fetched_at timestamp"
# fixed values: text and date keys of a report's JSON
TEXT_KEYS = ("recall_number", "event_id", "status", "classification", "product_type", "voluntary_mandated", "initial_firm_notification", "recalling_firm", "address_1", "address_2", "city", "state", "country", "postal_code", "distribution_pattern", "product_description", "product_quantity", "reason_for_recall", "code_info", "more_code_info")
DATE_KEYS = ("recall_initiation_date", "center_classification_date", "termination_date")
INDEX = "source string, source_id string, field string, content string, content_hash string, embedding array<float>, stored_at timestamp"
PAGE, MAX_SKIP = 1000, 25_000
RETRY = {429, 500, 502, 503, 504}


class HttpError(Exception):
    def __init__(self, status: int, retry_after: float | None = None) -> None:
        super().__init__(f"HTTP {status}")
        self.status, self.retry_after = status, retry_after


def build_search(base: str | None, date_field: str, since: date | None, today: date) -> str | None:
    """The source's own predicate: a base query and a date range, pushed to it instead of filtered here."""
    span = f"{date_field}:[{since:%Y%m%d} TO {today:%Y%m%d}]" if since else None
    return f"({base}) AND {span}" if base and span else base or span


def fetch_page(get: Callable[[str | None, int, int], list[dict]], search: str | None, skip: int, limit: int = PAGE, tries: int = 5, wait: Callable[[float], None] = time.sleep) -> list[dict]:
    """One page of a paged source; not found is an empty page, transient failures are tried again with doubling waits."""
    if skip > MAX_SKIP:
        raise ValueError(f"the source can't skip more than {MAX_SKIP} records: ask for a shorter range of dates")
    pause = 1.0
    for attempt in range(tries):
        try:
            return get(search, skip, min(limit, PAGE))
        except HttpError as e:
            if e.status == 404:
                return []
            if e.status not in RETRY or attempt == tries - 1:
                raise
            wait(e.retry_after or pause)
        except OSError:
            if attempt == tries - 1:
                raise
            wait(pause)
        pause *= 2
    return []


def pages(get: Callable[[str | None, int, int], list[dict]], search: str | None, wait: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """All records of a search."""
    skip = 0
    while True:
        got = fetch_page(get, search, skip, wait=wait)
        yield from got
        if len(got) < PAGE:
            return
        skip += PAGE


class _Slice(InputPartition):
    def __init__(self, first: date, last: date) -> None:
        super().__init__((first, last))
        self.first, self.last = first, last


def http_get(url: str, api_key: str | None = None, timeout: float = 30) -> Callable[[str | None, int, int], list[dict]]:
    """A client of a paged JSON endpoint for fetch_page(): a GET with limit, skip and search, whose `results` it returns."""

    def get(search: str | None, skip: int, limit: int) -> list[dict]:
        asked = {"limit": limit, "skip": skip} | ({"search": search} if search else {}) | ({"api_key": api_key} if api_key else {})
        try:
            with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(asked)}", timeout=timeout) as r:  # noqa: S310  the caller's own address
                return json.load(r).get("results", [])
        except urllib.error.HTTPError as e:  # is an OSError, but only some of its states are transient
            after = e.headers.get("Retry-After", "")
            raise HttpError(e.code, float(after) if after.isdigit() else None) from e

    return get


def saved_get(folder: str, field: str, low: str, high: str) -> Callable[[str | None, int, int], list[dict]]:
    """The same of saved responses, which any file system that pyarrow knows may hold; they are read once, not once a page."""
    fs, base = pa_fs.FileSystem.from_uri(folder) if "://" in folder else (pa_fs.LocalFileSystem(), folder)
    names = sorted(f.path for f in fs.get_file_info(pa_fs.FileSelector(base)) if f.path.endswith(".json"))
    rows = []
    for name in names:
        with fs.open_input_stream(name) as f:
            rows += [r for r in json.loads(f.read()).get("results", []) if low <= str(r.get(field, "")) <= high]
    return lambda search, skip, limit: rows[skip : skip + limit]


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.first, self.last = date.fromisoformat(options["since"]), date.fromisoformat(options["until"])
        self.days = int(options.get("days", "31"))
        self.url, self.api_key, self.folder = options.get("url"), options.get("api_key"), options.get("folder")
        self.field, self.base = options.get("date_field", "report_date"), options.get("search")
        if bool(self.url) == bool(self.folder):
            raise ValueError("give either url or folder")

    def partitions(self) -> list[_Slice]:
        out, at = [], self.first
        while at <= self.last:
            end = min(self.last, at + timedelta(days=self.days - 1))
            out.append(_Slice(at, end))
            at = end + timedelta(days=1)
        return out

    def read(self, part: _Slice) -> Iterator[tuple]:
        get = http_get(self.url, self.api_key) if self.url else saved_get(self.folder, self.field, f"{part.first:%Y%m%d}", f"{part.last:%Y%m%d}")
        for r in pages(get, build_search(self.base, self.field, part.first, part.last)):
            yield (json.dumps(r, sort_keys=True),)


class PagedSource(DataSource):
    """spark.read.format("paged_records"): one partition a slice of dates, read page by page.

    Options: url (a live endpoint, with api_key) or folder (saved responses, on storage that all executors reach), since,
    until, days, date_field, search.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return "raw string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(dict(self.options))


def as_raw(lines: DataFrame, source: str, key: str = "recall_number", date_key: str = "report_date", fetched_at: Column | None = None) -> DataFrame:
    """RAW rows of a column `raw` of JSON texts: id is the natural key, else a hash of the JSON with sorted keys."""
    raw = F.col("raw")
    return lines.select(record_id(F.get_json_object(raw, f"$.{key}"), raw).alias("id"), F.lit(source).alias("source"), ingest_date(F.get_json_object(raw, f"$.{date_key}")).alias("report_date"), raw, (fetched_at if fetched_at is not None else F.current_timestamp()).alias("fetched_at"))


def parsed(raw: DataFrame) -> DataFrame:
    """RAW rows with the 20 text and 3 date columns of their JSON, which is parsed once a row."""
    schema = ", ".join(f"{k} string" for k in (*TEXT_KEYS, *DATE_KEYS))
    rows = raw.withColumn("_r", F.from_json("raw", schema))
    return rows.select(*raw.columns, *[F.col(f"_r.{k}").alias(k) for k in TEXT_KEYS], *[compact_date(F.col(f"_r.{k}")).alias(k) for k in DATE_KEYS])


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key. max_by combines before the shuffle, so a key with many versions stays small."""
    at = F.struct(*order)
    out = rows.groupBy(*key).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns if c not in key]), at).alias("_r"))
    return out.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def upsert(existing: DataFrame, new: DataFrame, key: str = "id", at: str = "fetched_at") -> DataFrame:
    """Last write wins: by time, then new before existing, then by content."""
    rows = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    content = F.xxhash64(*[F.col(c).cast("string") for c in existing.columns if c != key])
    return latest(rows, [key], [F.col(at), F.col("_new"), content]).drop("_new")


def high_water(rows: DataFrame, date_column: str = "report_date") -> DataFrame:
    """One row (high_water): the day from which, inclusively, a next pull starts."""
    return rows.agg(F.max(date_column).alias("high_water"))


def text_registry(tables: dict[str, DataFrame], sources: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """(source, source_id, field, content) of registered tables: name -> (id column, text columns)."""
    out = None
    for name, (key, fields) in sources.items():
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("content")) for f in fields])).alias("x")
        rows = tables[name].select(F.lit(name).alias("source"), F.col(key).cast("string").alias("source_id"), pairs).select("source", "source_id", "x.field", "x.content")
        out = rows if out is None else out.unionByName(rows)
    return out


def pending(texts: DataFrame, index: DataFrame, limit: int | None = None) -> DataFrame:
    """Texts, not blank, whose hash the index doesn't have."""
    now = texts.where(F.length(F.btrim("content")) > 0).withColumn("content_hash", content_hash(F.col("content")))
    known = index.select("source", "source_id", "field", F.col("content_hash").alias("_old"))
    out = now.join(known, ["source", "source_id", "field"], "left").where(~F.col("content_hash").eqNullSafe(F.col("_old"))).drop("_old")
    return out.orderBy("source", "source_id", "field").limit(limit) if limit is not None else out


def embed_pending(todo: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 256) -> DataFrame:
    """`todo` with embeddings, asked for a batch at a time within each partition."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch].copy()
                part["embedding"] = embed(part["content"].tolist())
                yield part

    return todo.mapInPandas(run, StructType([*todo.schema.fields, StructField("embedding", ArrayType(FloatType()))]))


def store_pending(texts: DataFrame, path: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 256, per_commit: int = 100_000) -> int:
    """Embeds what the index under `path` lacks and appends it, about per_commit rows to a commit; the rows stored.

    Rows are cut into commits by a hash of their key. A run that breaks off keeps its commits, and the next one starts
    with the rows that are left. The newest row of a text (by stored_at) is its current one: see stored_index().
    """
    spark = texts.sparkSession
    todo = pending(texts, stored_index(spark, path)).select("source", "source_id", "field", "content", "content_hash")
    n = todo.count()
    commits = -(-n // per_commit)
    piece = F.pmod(F.xxhash64("source", "source_id", "field"), F.lit(commits))
    for i in range(commits):
        rows = embed_pending(todo.where(piece == i) if commits > 1 else todo, embed, batch)
        rows.withColumn("stored_at", F.current_timestamp()).write.mode("append").parquet(path)
    return n


def stored_index(spark: SparkSession, path: str) -> DataFrame:
    """The current row of each text that store_pending() has written; an index not yet written is empty."""
    try:
        rows = spark.read.schema(INDEX).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INDEX)
    key = ["source", "source_id", "field"]
    last = rows.groupBy(*key).agg(F.max(F.struct("stored_at", "content_hash")).alias("_m"))
    same = last.select(*key, F.col("_m.stored_at").alias("stored_at"), F.col("_m.content_hash").alias("content_hash"))
    return rows.join(same, [*key, "stored_at", "content_hash"], "left_semi").select(*rows.columns)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Edge seeds of a JSON list, an object with a list `edges`, or JSON lines: one row a firm name."""
    schema = "parent_group string, firm_names array<string>, provenance_tier string, source string, source_name string, source_url string, source_id string, as_of_date string, confidence double"
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    lines = F.split("v", "\n")
    as_list = F.when(F.col("v").startswith("["), F.from_json("v", f"array<struct<{_ddl(schema)}>>"))
    as_edges = F.when(F.get_json_object("v", "$.edges").isNotNull(), F.from_json(F.get_json_object("v", "$.edges"), f"array<struct<{_ddl(schema)}>>"))
    as_lines = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.from_json(x, schema))
    rows = whole.select(F.explode(F.coalesce(as_list, as_edges, as_lines)).alias("s")).select("s.*")
    out = rows.withColumn("firm_name", F.explode("firm_names")).drop("firm_names").withColumn("as_of_date", ingest_date(F.col("as_of_date")))
    return out.withColumn("seed_id", F.xxhash64("parent_group", "firm_name", "source", "source_id"))


def _ddl(schema: str) -> str:
    return ", ".join(f"{a}: {b}" for a, b in (x.split(" ", 1) for x in schema.split(", ")))


def report(path: str, rows: DataFrame, **more: object) -> None:
    """A small result as pretty JSON on the driver."""
    Path(path).write_text(json.dumps({**more, "rows": [r.asDict(recursive=True) for r in rows.collect()]}, indent=2, ensure_ascii=False, default=str) + "\n", encoding="utf-8")


def export(rows: DataFrame, path: str, form: str = "csv") -> None:
    """A result as CSV with a header or as JSON lines."""
    rows.write.mode("overwrite").csv(path, header=True) if form == "csv" else rows.write.mode("overwrite").json(path)


def planned(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(change, n): what writing `after` over `before` would insert, update, delete or leave; nothing is written."""
    digest = lambda d: F.xxhash64(*[F.col(c).cast("string") for c in sorted(d.columns) if c not in key])
    a, b = before.select(*key, digest(before).alias("_a")), after.select(*key, digest(after).alias("_b"))
    change = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(F.col("_a") != F.col("_b"), "update").otherwise("unchanged")
    return a.join(b, key, "full").groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


def newest_per_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in a given order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")
