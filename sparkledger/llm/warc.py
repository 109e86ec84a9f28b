"""WARC archives: written and read back with Spark's text files, record boundaries proven by chains of offsets.

Writing: a record is a line whose end is the blank line that closes a WARC record, so Spark's writer lays out valid
archives on any file system, with its commit protocol. Reading: every task cuts its byte range at each record magic it
meets, inside payloads too, and gives every such candidate the offset at which its successor must begin. Pointer
jumping from the start of each file doubles the reach of each step until nothing is added; only candidates reached
that way are records, and a record that its payload's magic had cut apart is joined again.

Offsets come from one scan and bytes from a later one, whose byte ranges may be others (settings change, executors
come and go). What the two have in common is a segment's content: it lies between two magics whatever the ranges, so
its file and two hashes of its bytes name it in both, and segments of a file with equal bytes can stand for each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkledger.llm.base import broadcast_if_small, discard, materialise, shared_path

MAGIC, EOL, CLOSE = "WARC/1.1\r\n", "\r\n", "\r\n\r\n"
#: Profile of a revisit record (fixed value of the format).
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows of the narrow tables of offsets that go into one file.
ROWS = 500_000
#: The digits of base32, and those that conv() uses.
_BASE32, _HEX32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 SHA-1 of binary data: five hexadecimal digits are four base32 ones."""
    digest = F.sha1(data)
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]), _HEX32, _BASE32)


def plan(pages: DataFrame, id_col: str, payload: Column, min_bytes: int = 0) -> DataFrame:
    """(first, digest) of payloads of at least `min_bytes` that more than one row has: the smallest id and the digest."""
    rows = pages.select(F.col(id_col).alias("id"), payload.alias("p")).select("id", sha1_base32(F.col("p")).alias("digest"), F.octet_length("p").alias("n"))
    return rows.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("digest", "n", "first")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """One record a row of `pages` under `path`: a response, or a revisit of the row with the smallest id and an equal payload.

    Payloads are strings (as UTF-8) or binary, null ones empty; only those of at least `min_bytes` are compared. Rows
    with a null id write responses that carry none. Of several rows with the smallest id all are responses. Null urls
    are empty targets; line breaks in urls become spaces. An empty table writes an archive without records.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    seen = materialise(plan(pages, id_col, payload, min_bytes), "warc-repeats")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", " ").alias("url"), payload.alias("p"))
    rows = rows.withColumn("n", F.octet_length("p")).withColumn("d", sha1_base32(F.col("p")))
    firsts = broadcast_if_small(seen.select(F.col("digest").alias("d2"), F.col("n").alias("n2"), "first"), 160)
    rows = rows.join(firsts, (F.col("d") == F.col("d2")) & (F.col("n") == F.col("n2")), "left")
    again = F.col("first").isNotNull() & F.col("id").isNotNull() & (F.col("id") > F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    maybe = lambda when, text: F.when(when, text).otherwise(F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + EOL), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.col("n").cast("string")), F.lit(EOL))
    rows = rows.withColumn("again", again).withColumn("http", http)
    block = F.octet_length("http") + F.when(F.col("again"), 0).otherwise(F.col("n"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response"))),
        maybe(F.col("id").isNotNull(), line("WARC-Record-ID", urn(F.col("id")))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("d"))),
        maybe(F.col("again"), F.concat(line("WARC-Refers-To", urn(F.col("first"))), line("WARC-Profile", F.lit(REVISIT)))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit(EOL),
    )
    body = F.when(F.col("again"), F.lit(b"")).otherwise(F.col("p"))
    record = F.concat(head.cast("binary"), F.col("http").cast("binary"), body)
    rows.select(record.cast("string").alias("value")).write.option("lineSep", CLOSE).text(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, fid, k1, k2, value, start, seg): what lies between one magic and the next, in every task's byte range.

    `fid`, a hash of the file's path, stands for it in the tables of offsets, which would otherwise repeat long paths;
    k1 and k2 are hashes of the segment's bytes. `start` is where the range begins in the file and `seg` orders the
    segments within it; these two hold for one scan only.
    """
    rows = spark.read.option("lineSep", MAGIC).text(path)
    path_of = F.col("_metadata.file_path")
    return rows.select(
        "value", path_of.alias("file"), F.xxhash64(path_of).alias("fid"), F.xxhash64("value").alias("k1"), F.xxhash64(F.lit(1), F.octet_length("value"), "value").alias("k2"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seg"),
    )


def _header(name: str) -> Column:
    return F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)


def records(spark: SparkSession, path: str, prove: bool = True, offsets: bool = True) -> DataFrame:
    """The records of the archives under `path` (a folder or file of uncompressed WARC).

    Without `offsets` that column is null, and records need not be joined with their places: only the few candidates
    that are none, or are cut apart, are looked up.

    (file, offset, type, record_id, target, digest, refers_to, http_head, payload binary, intact boolean): the payload
    is what follows the HTTP head; intact says whether a response's payload has the digest that its header states.
    An archive without records gives no rows; what can't be reached from the start of its file is no record.
    """
    segs = candidates(spark, path)
    magic = len(MAGIC)
    # one scan gives all places; where each range of a file begins to cut: the bytes of all segments before it
    parsed = segs.withColumn("head", F.substring_index("value", CLOSE, 1)).withColumn("size", _header("Content-Length")).withColumn("seg_bytes", F.octet_length("value").cast("long"))
    ends = F.col("size").rlike("^[0-9]{1,15}$") & (F.octet_length("head") < F.col("seg_bytes"))
    length = F.octet_length("head") + 4 + F.when(ends, F.col("size").cast("long")).otherwise(F.lit(None)) + 4
    small = materialise(parsed.select("fid", "start", "seg", "k1", "k2", "seg_bytes", (length + magic).alias("length")), "warc-candidates")
    ranges = small.groupBy("fid", "start").agg(F.sum(F.col("seg_bytes") + magic).alias("bytes"), F.min("seg").alias("first"))
    before = Window.partitionBy("fid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("begin", F.coalesce(F.sum("bytes").over(before), F.lit(0))).select("fid", "start", "begin")
    within = Window.partitionBy("fid", "start").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    at = small.withColumn("ahead", F.coalesce(F.sum(F.col("seg_bytes") + magic).over(within), F.lit(0))).join(ranges, ["fid", "start"])
    # a segment follows its magic, so the candidate begins that much earlier; the first of a file follows none
    spots = at.select("fid", "k1", "k2", "seg_bytes", (F.col("begin") + F.col("ahead") - magic).alias("offset"), "length")
    files = 1 + small.count() // ROWS
    spots = materialise(spots.withColumn("next", F.col("offset") + F.col("length")).coalesce(files), "warc-offsets")
    real = _reachable(spots, files) if prove else spots.where("offset >= 0").select("fid", "offset")
    return _assemble(segs.drop("start", "seg"), spots, real, offsets, files)


def _reachable(spots: DataFrame, files: int) -> DataFrame:
    """(fid, offset) of the candidates on the chain from offset 0 of each file, by pointer jumping.

    The narrow tables of each round are written as `files` files, so that many small ones don't cost more than the rows.
    """
    nodes = spots.where("offset >= 0").select("fid", "offset", "next")
    ok = nodes.select("fid", F.col("offset").alias("next"))
    # a candidate whose successor isn't one leads nowhere (the last record's successor is the end of its file)
    jump = materialise(nodes.join(ok, ["fid", "next"], "left_semi").select("fid", "offset", "next").coalesce(files), "warc-jumps")
    reach = materialise(nodes.where("offset = 0").select("fid", "offset").coalesce(files), "warc-reach")
    n = reach.count()
    while True:
        step = reach.join(jump, ["fid", "offset"]).select("fid", F.col("next").alias("offset"))
        more = materialise(reach.union(step).distinct().coalesce(files), "warc-reach")
        if (m := more.count()) == n:
            return more
        far = jump.join(jump.select("fid", F.col("offset").alias("next"), F.col("next").alias("far")), ["fid", "next"]).select("fid", "offset", F.col("far").alias("next"))
        longer = materialise(far.coalesce(files), "warc-jumps")
        discard(jump)
        discard(reach)
        jump, reach, n = longer, more, m


def _named(segs: DataFrame, names: DataFrame) -> DataFrame:
    """One segment of each of the (f, g1, g2) that `names` lists, with the columns of its row."""
    same = (F.col("fid") == F.col("f")) & (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2"))
    once = names.select("f", "g1", "g2").distinct()
    found = segs.join(broadcast_if_small(materialise(once, "warc-names"), 48), same, "left_semi").dropDuplicates(["fid", "k1", "k2"])
    return found.join(names, same)


def _assemble(segs: DataFrame, spots: DataFrame, real: DataFrame, offsets: bool, files: int) -> DataFrame:
    """Records from their segments; only those that a magic in their payload cut apart are shuffled with their bytes.

    Segments of a file with equal bytes are told apart by nothing but their offsets, so one stands for all: where some
    are records and others not, or where offsets are asked for, as many rows are made of it as there are records.
    """
    marked = materialise(spots.join(real.withColumn("is_record", F.lit(True)), ["fid", "offset"], "left").coalesce(files), "warc-marked")
    fits = F.coalesce(F.col("is_record") & (F.col("next") - F.col("offset") <= F.col("seg_bytes") + len(MAGIC)), F.lit(False))
    key = [F.col("fid").alias("f"), F.col("k1").alias("g1"), F.col("k2").alias("g2")]
    keyed = materialise(marked.groupBy("fid", "k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.sum(fits.cast("int")).alias("good"), F.max(F.when(fits, F.col("offset"))).alias("offset")).coalesce(files), "warc-keys")
    same = (F.col("fid") == F.col("f")) & (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2"))
    if offsets:
        alone = materialise(keyed.where("n = 1 AND good = 1").select(*key, "offset"), "warc-alone")
        whole = segs.join(broadcast_if_small(alone, 56), same).select("file", "offset", "value")
        shared = keyed.where("n > 1 AND good > 0").select("fid", "k1", "k2")
        places = marked.where(fits).join(shared, ["fid", "k1", "k2"], "left_semi").select(*key, "offset")
    else:
        # nearly all segments are records, so only the others are looked up
        odd = materialise(keyed.where("good < n").select(*key), "warc-odd")
        whole = segs.join(broadcast_if_small(odd, 48), same, "left_anti").select("file", F.lit(None).cast("long").alias("offset"), "value")
        some = keyed.where("good < n AND good > 0")
        places = some.select(*key, F.explode(F.sequence(F.lit(1), F.col("good").cast("int"))).alias("copy")).select("f", "g1", "g2", F.lit(None).cast("long").alias("offset"))
    places = materialise(places, "warc-places")
    if not places.isEmpty():
        whole = whole.union(_named(segs, places).select("file", "offset", "value"))
    whole = whole.withColumn("value", F.col("value").cast("binary"))
    cut = marked.where(F.col("is_record") & ~fits)
    if cut.isEmpty():
        return _parsed(whole)
    cut = materialise(cut.select("fid", "offset", "next"), "warc-cut")
    parts = spots.where("offset >= 0").select(*key, F.col("offset").alias("part")).join(cut, F.col("f") == F.col("fid")).where("part >= offset AND part < next").drop("fid")
    texts = _named(segs, materialise(parts, "warc-parts")).select("file", "fid", "offset", "part", F.col("value").cast("binary").alias("value"))
    joined = texts.groupBy("fid", "offset").agg(F.first("file").alias("file"), F.array_sort(F.collect_list(F.struct("part", F.base64("value").alias("v")))).alias("parts"))
    text = F.aggregate("parts", F.lit(None).cast("binary"), lambda acc, p: F.when(acc.isNull(), F.unbase64(p["v"])).otherwise(F.concat(acc, F.lit(MAGIC.encode()), F.unbase64(p["v"]))))
    return _parsed(whole.union(joined.select("file", "offset", text.alias("value"))))


def _parsed(found: DataFrame) -> DataFrame:
    """Fields of records whose `value` is all that follows their magic."""
    text = found.withColumn("head", F.substring_index(F.col("value").cast("string"), CLOSE, 1))
    size = _header("Content-Length").cast("int")
    block = text.withColumn("block", F.expr("substring(value, octet_length(head) + 5)")).withColumn("block", F.substring("block", F.lit(1), size))
    http = block.withColumn("http_head", F.when(_header("Content-Type").startswith("application/http"), F.substring_index(F.col("block").cast("string"), CLOSE, 1)))
    data = http.withColumn("payload", F.when(F.col("http_head").isNotNull(), F.expr("substring(block, octet_length(http_head) + 5)")).otherwise(F.col("block")))
    id_of = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1)
    digest = F.regexp_extract(_header("WARC-Payload-Digest"), "^sha1:(.*)$", 1)
    return data.select(
        "file", "offset", _header("WARC-Type").alias("type"), F.nullif(id_of(_header("WARC-Record-ID")), F.lit("")).cast("long").alias("record_id"), _header("WARC-Target-URI").alias("target"),
        digest.alias("digest"), F.nullif(id_of(_header("WARC-Refers-To")), F.lit("")).cast("long").alias("refers_to"), "http_head", "payload",
        ((_header("WARC-Type") == "revisit") | (sha1_base32(F.col("payload")) == digest)).alias("intact"),
    )


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, offsets: bool = True) -> DataFrame:
    """Writes the pages to archives on shared storage and returns records() of them."""
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path, id_col, url_col, payload_col, min_bytes)
    return records(pages.sparkSession, path, offsets=offsets)
