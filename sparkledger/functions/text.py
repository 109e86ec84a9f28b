"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that Python's str.strip() and \s know; Java's \s alone knows ASCII only.
_SPACE = r"(?U)\s"


def normalize_text(c: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, f"{_SPACE}+", " "), "^ | $", ""))


def text_hash(c: Column) -> Column:
    """SHA-256 (hex) of the normalised text."""
    return F.sha2(normalize_text(c), 256)


def content_hash(c: Column) -> Column:
    """MD5 (hex) of the text as it is."""
    return F.md5(c.cast("binary"))


def record_id(key: Column, raw: Column) -> Column:
    """The natural key, else a hash of the JSON with sorted keys."""
    canonical = F.to_json(F.parse_json(raw))
    return F.when(key.isNotNull() & (key != ""), key).otherwise(F.concat(F.lit("sha1:"), F.sha1(canonical.cast("binary"))))


def extract_prefix(c: Column, max_words: int = 8, max_chars: int = 90) -> Column:
    """What stands before the first colon, semicolon or spaced dash: 1 to `max_words` words, else null."""
    head = F.element_at(F.split(normalize_text(c), r"[:;]| [-–—] ", 2), 1)
    head = F.regexp_replace(head, r"^[ .,-]+|[ .,-]+$", "")
    return F.when((head != "") & (F.size(F.split(head, " ")) <= max_words) & (F.length(head) <= max_chars) & c.rlike(r"[:;]|\s[-–—]\s"), head)


def slugify(c: Column, max_chars: int = 80) -> Column:
    """Lower case letters and digits joined by underscores; n_ stands before a leading digit."""
    out = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    out = F.when(out.rlike("^[0-9]"), F.concat(F.lit("n_"), out)).otherwise(out)
    return F.regexp_replace(F.substring(out, 1, max_chars), "_+$", "")


def clip(c: Column, n: int) -> Column:
    """White space collapsed, and an ellipsis where more than n characters are cut."""
    flat = F.regexp_replace(F.regexp_replace(c, f"{_SPACE}+", " "), "^ | $", "")
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…"))).otherwise(flat)


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, repeats included."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words, each padded by two spaces in front and one behind."""
    padded = F.transform(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3)))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared share of trigrams()."""
    return jaccard(trigrams(a), trigrams(b))


def grounded(snippet: Column, text: Column) -> Column:
    """Whether the snippet, not blank, occurs in the text, case and white space aside."""
    return (normalize_text(snippet) != "") & normalize_text(text).contains(normalize_text(snippet))


def compact_date(c: Column) -> Column:
    """Eight digits as a date; anything else, and days that don't exist, null."""
    return F.when(c.rlike("^[0-9]{8}$"), F.try_to_date(c, "yyyyMMdd"))


def ingest_date(c: Column) -> Column:
    """The first eight characters as digits, else the first ten as an ISO date, else null."""
    iso = F.substring(c, 1, 10)
    return F.coalesce(compact_date(F.substring(c, 1, 8)), F.when(iso.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(iso, "yyyy-MM-dd")))


def percent_encoded(c: Column) -> Column:
    """Every byte but letters, digits and _.-~ as %XX."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def evidence_url(base: str, field: str, value: Column) -> Column:
    """A link that looks one quoted value up."""
    return F.concat(F.lit(f"{base}?search="), percent_encoded(F.concat(F.lit(f'{field}:"'), value, F.lit('"'))), F.lit("&limit=1"))


def detail_path(value: Column) -> Column:
    """The path of a record's own page."""
    return F.concat(F.lit("/recalls/"), percent_encoded(value))
