"""I-Match document fingerprints over randomised lexicons.

Terms are lower-case (A-Z) words. The lexicon holds the terms whose document frequency, as a share of all documents,
lies in a band, which is a band of inverse document frequency; as a document has a bounded number of distinct words,
the lower share also bounds the lexicon, whatever the corpus. Of it, SUBSETS random lexicons are drawn at six rates;
a document's distinct terms in one of them are sorted and hashed. A fingerprint is the row of these hashes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sparkledger.llm.base import small_batches

#: Document shares between which a term is in the lexicon, and documents that must hold it at least.
MIN_SHARE, MAX_SHARE, MIN_DOCUMENTS = 0.0005, 0.1, 2
#: Byte i of a term's two SHA-256 digests puts it into lexicon i if it is below the rate, in 256ths.
RATES = (32, 16, 8, 4, 2, 1)
SUBSETS = 64
#: Hexadecimal digits of each hash, and what stands for a lexicon that the document has no term of.
DIGITS, NONE = 4, "----"
#: Subsets of one rate that must hold terms for the rate to count by itself.
ENOUGH = 3
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FLUSH = 200_000


def terms(text: str | None) -> set[bytes]:
    """Distinct lower-case words (no ASCII white space) of a text."""
    return set((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split())


def lexicons_of(term: bytes) -> list[int]:
    """The random lexicons that a term of the lexicon belongs to."""
    digest = hashlib.sha256(b"0" + term).digest() + hashlib.sha256(b"1" + term).digest()
    return [i for i in range(SUBSETS) if digest[i] < RATES[i % len(RATES)]]


def fingerprint(text: str | None, lexicon: dict[bytes, list[int]]) -> str:
    """Row of hashes of a whole text; without any term of a random lexicon, the hash of the text itself."""
    held: dict[int, list[bytes]] = {}
    for term in sorted(t for t in terms(text) if t in lexicon):
        for i in lexicon[term]:
            held.setdefault(i, []).append(term)
    if not held:
        return "=" + hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest()
    return "".join(hashlib.md5(b" ".join(held[i])).hexdigest()[:DIGITS] if i in held else NONE for i in range(SUBSETS))


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, 0 if either has no terms, else the largest share of equal hashes at one rate.

    Counted are lexicons that either document has terms of, at rates where there are at least ENOUGH of them;
    if no rate has, over all rates together.
    """
    if a == b:
        return 1.0
    if a[0] == "=" or b[0] == "=":
        return 0.0
    same, seen = [0] * len(RATES), [0] * len(RATES)
    for i in range(SUBSETS):
        x, y = a[i * DIGITS : (i + 1) * DIGITS], b[i * DIGITS : (i + 1) * DIGITS]
        if x != NONE or y != NONE:
            seen[i % len(RATES)] += 1
            same[i % len(RATES)] += x == y
    shares = [s / n for s, n in zip(same, seen, strict=True) if n >= ENOUGH]
    return max(shares) if shares else sum(same) / sum(seen)


def lexicon(docs: DataFrame, text_col: str = "text", min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """(term, documents): the terms within the band, counted over every whole text.

    At most (mean distinct words of a document) / min_share terms can be in it.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])
            seen.clear()
            return out

        for b in batches:
            for t in b.column(0):
                seen.update(terms(t.as_py()))
                if len(seen) > _FLUSH:
                    yield flush()
        if seen:
            yield flush()

    n = docs.count()
    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("documents"))
    return counted.where((F.col("documents") >= max(MIN_DOCUMENTS, min_share * n)) & (F.col("documents") <= max_share * n))


def _collected(terms_df: DataFrame) -> dict[bytes, list[int]]:
    """The lexicon as the workers use it: terms that belong to some random lexicon."""
    found = {t.encode("utf-8", "surrogatepass"): lexicons_of(t.encode("utf-8", "surrogatepass")) for t in terms_df.select("term").toArrow()["term"].to_pylist()}
    return {t: i for t, i in found.items() if i}


def fingerprints(docs: DataFrame, text_col: str = "text", lexicon_df: DataFrame | None = None, name: str = "fingerprint") -> DataFrame:
    """`docs` with its I-Match fingerprint as column `name`; equal texts have equal fingerprints."""
    spark = docs.sparkSession
    small_batches(spark)
    words = spark.sparkContext.broadcast(_collected(lexicon(docs, text_col) if lexicon_df is None else lexicon_df))
    keep = docs.drop(name)
    at = keep.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([fingerprint(t.as_py(), words.value) for t in b.column(at)])], [*b.schema.names, name])

    return keep.mapInArrow(run, StructType([*keep.schema.fields, StructField(name, StringType())]))


def _ranges(spark, ids: DataFrame, parts: int) -> list[int]:
    """Ascending ids that cut the ids into about `parts` even ranges."""
    shares = [i / parts for i in range(1, parts)]
    found = ids.agg(F.percentile_approx("id", shares, 10_000)).first()[0] if shares else None
    return sorted({int(x) for x in found or []})


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, id, h, t, extra): rows by part in descending order of id, each part followed by a copy of the next one's first row.

    Integer ids; null ids come last, ties by descending hash of the text; the last row is followed by the first.
    Only one row a part is written twice. Parts are ranges of ids, and several of them may share a partition.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _ranges(spark, rows.select("id").where("id IS NOT NULL"), parts)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    part = F.lit(0)
    if bounds:  # how many bounds are above the id: first among the groups, then within one
        whole = F.size(F.filter(F.array(*[F.lit(g[0]) for g in groups]), lambda b: b > F.col("id")))
        short = F.lit(len(groups)) - whole
        inner = F.when(short > 0, F.size(F.filter(F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), F.greatest(short, F.lit(1))), lambda b: b > F.col("id")))).otherwise(0)
        sizes = [sum(map(len, groups[len(groups) - k :])) if k else 0 for k in range(len(groups) + 1)]
        part = F.element_at(F.array(*map(F.lit, sizes)), whole + 1) + inner
    # null ids have no ranges of their own: they are cut by their second key, the hash, which spreads all but equal texts
    fall = F.least(F.floor((F.lit(2.0**63) - F.col("h").cast("double")) / 2.0**64 * parts), F.lit(parts - 1)).cast("int")
    rows = rows.withColumn("h", F.xxhash64("t")).withColumn("part", F.when(F.col("id").isNull(), F.lit(len(bounds) + 1) + fall).otherwise(part).cast("int"))
    order = F.struct(F.col("id").isNotNull().alias("a"), F.col("id").alias("b"), F.col("h").alias("c"))
    firsts = sorted(rows.groupBy("part").agg(F.max(order).alias("m")).select("part", "m.b", "m.c").collect())
    before = [(r.part, r.b, r.c, firsts[i - 1].part) for i, r in enumerate(firsts)]
    marks = spark.createDataFrame(before, "p int, i long, c long, before int")
    found = rows.join(F.broadcast(marks), (F.col("part") == F.col("p")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("c")), "left")
    places = F.when(F.col("before").isNull(), F.array(F.struct(F.col("part").alias("at"), F.lit(0).alias("extra")))).otherwise(F.array(F.struct(F.col("part").alias("at"), F.lit(0).alias("extra")), F.struct(F.col("before").alias("at"), F.lit(1).alias("extra"))))
    out = found.select(F.explode(places).alias("x"), "id", "h", "t").select(F.col("x.at").alias("part"), "id", "h", "t", F.col("x.extra").alias("extra"))
    return out.repartition(parts // 4, "part").sortWithinPartitions(F.col("part"), F.col("extra"), F.col("id").desc_nulls_last(), F.col("h").desc())


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint against that of its edited text and that of the next document.

    The edited text is the document with its last floor(n_chars / 3) code points replaced by as many (or all) first
    ones of the next document in descending order of id; after the last comes the first. Null texts are empty. Rows
    with null or equal ids keep a defined order (see neighbours()); one row alone is its own next.
    Returns (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row a row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    words = spark.sparkContext.broadcast(_collected(lexicon(docs, text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = words.value
        part = held = None  # held: id, text, fingerprint of the row that waits for its next
        for b in batches:
            out = []
            for p, i, t, extra in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                if extra and (p != part or held is None):
                    continue
                t = t.as_py()
                fp = fingerprint(t, lex)
                if held is not None and p == part:
                    hid, text, own = held
                    cut = len(text) // 3
                    edited = text[: len(text) - cut] + t[:cut]
                    efp = fingerprint(edited, lex) if cut else own
                    out.append((hid, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, efp, likeness(own, efp), likeness(own, fp)))
                part, held = p, None if extra else (i, t, fp)
            cols = list(zip(*out, strict=True)) if out else [[] for _ in range(7)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    rows = neighbours(docs, id_col, text_col).select("part", "id", "t", "extra")
    out = rows.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
