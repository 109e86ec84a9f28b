"""SQL (DuckDB) that gives the same rows as the registered queries that SQL can express."""

from __future__ import annotations

from sparkledger.llm import hilbert, imatch

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc_table() -> list[int]:
    """What the eight shifts of the reflected CRC-32 polynomial make of each byte."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


def _base32(h: str) -> str:
    """Base32 of a hexadecimal SHA-1: five digits at a time make four."""
    part = lambda i: f"CAST('0x' || substr({h}, {5 * i + 1}, 5) AS INTEGER)"
    return " || ".join(f"substr('{_BASE32}', (({part(i)} >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))


def warc() -> str:
    return f"""
        WITH x AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
        y AS (SELECT page_id, octet_length(p) AS n, sha1(p) AS h, min(page_id) OVER (PARTITION BY p) AS first FROM x)
        SELECT page_id, n AS payload_bytes, {_base32("h")} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM y
    """


def imatch_fingerprints() -> str:
    """Terms, the band of document frequency, random lexicons by bytes of SHA-256, and hashes of sorted terms."""
    rates = ", ".join(f"'{r:02x}'" for r in imatch.RATES)
    n = len(imatch.RATES)
    d, none = imatch.DIGITS, imatch.NONE
    like = f"""CASE WHEN a = b THEN 1.0 WHEN a[1] = '=' OR b[1] = '=' THEN 0.0 ELSE (
            SELECT CASE WHEN max(share) IS NOT NULL THEN max(share) ELSE sum(same) / sum(seen) END FROM (
                SELECT CASE WHEN count(*) >= {imatch.ENOUGH} THEN sum(CAST(x = y AS INTEGER)) / count(*) END AS share, sum(CAST(x = y AS INTEGER)) AS same, count(*) AS seen FROM (
                    SELECT i, substr(a, i * {d} + 1, {d}) AS x, substr(b, i * {d} + 1, {d}) AS y FROM range({imatch.SUBSETS}) r(i)) WHERE x <> '{none}' OR y <> '{none}' GROUP BY i % {n})) END"""
    return f"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        nexts AS (SELECT doc_id, t, coalesce(lead(t) OVER o, first_value(t) OVER o) AS nt, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id FROM docs WINDOW o AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        texts AS (SELECT doc_id, 0 AS edited, t FROM docs UNION ALL SELECT doc_id, 1, substr(t, 1, length(t) - length(t) // 3) || substr(nt, 1, length(t) // 3) FROM nexts),
        words AS (SELECT DISTINCT doc_id, edited, unnest(regexp_extract_all(translate(t, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+')) AS w FROM texts),
        lex AS (SELECT w, sha256('0' || w) || sha256('1' || w) AS h FROM words WHERE edited = 0 GROUP BY w HAVING count(*) >= greatest({imatch.MIN_DOCUMENTS}, {imatch.MIN_SHARE} * (SELECT count(*) FROM docs)) AND count(*) <= {imatch.MAX_SHARE} * (SELECT count(*) FROM docs)),
        member AS (SELECT w, i FROM lex, range({imatch.SUBSETS}) r(i) WHERE substr(h, 2 * i + 1, 2) < [{rates}][i % {n} + 1]),
        parts AS (SELECT doc_id, edited, i, substr(md5(string_agg(w, ' ' ORDER BY w)), 1, {d}) AS part FROM words JOIN member USING (w) GROUP BY doc_id, edited, i),
        rows AS (SELECT doc_id, edited, string_agg(coalesce(part, '{none}'), '' ORDER BY i) AS fp FROM (SELECT DISTINCT doc_id, edited FROM parts) CROSS JOIN range({imatch.SUBSETS}) r(i) LEFT JOIN parts USING (doc_id, edited, i) GROUP BY doc_id, edited),
        fps AS (SELECT doc_id, edited, t, coalesce(fp, '=' || sha256(t)) AS fp FROM texts LEFT JOIN rows USING (doc_id, edited)),
        pairs AS (SELECT o.doc_id, length(o.t) AS n_chars, sha256(e.t) AS edited_sha256, o.fp AS fingerprint, e.fp AS edited_fingerprint, nx.fp AS next_fingerprint
            FROM fps o JOIN fps e ON e.doc_id = o.doc_id AND e.edited = 1 JOIN nexts ON nexts.doc_id = o.doc_id JOIN fps nx ON nx.doc_id = nexts.next_id AND nx.edited = 0 WHERE o.edited = 0),
        near_e AS (SELECT doc_id, CAST({like} AS DOUBLE) AS near_edited FROM (SELECT doc_id, fingerprint AS a, edited_fingerprint AS b FROM pairs)),
        near_n AS (SELECT doc_id, CAST({like} AS DOUBLE) AS near_next FROM (SELECT doc_id, fingerprint AS a, next_fingerprint AS b FROM pairs))
        SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next FROM pairs JOIN near_e USING (doc_id) JOIN near_n USING (doc_id)
    """


def hilbert_shards(shards: int = 8) -> str:
    """The levels of each dimension, the curve's index from its table, and shards and slots from ranks."""
    levels = 1 << hilbert.BITS
    level = lambda c: f"least((({c} - min({c}) OVER ()) * {levels}) // (max({c}) OVER () - min({c}) OVER () + 1), {levels - 1})"
    # whole values in binary order: a level each, or of many the share of rows before them
    values = lambda c: f"""{c}s AS (SELECT {c}, CASE WHEN count(*) OVER () <= {levels} THEN (row_number() OVER (ORDER BY {c}) - 1) * {levels} // count(*) OVER () ELSE coalesce(sum(n) OVER (ORDER BY {c} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {levels} // sum(n) OVER () END AS {c}_level
            FROM (SELECT {c}, count(*) AS n FROM x GROUP BY 1))"""  # noqa: E731
    return f"""
        WITH x AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, encode(coalesce(text, '')) AS b FROM documents), {values("lang")}, {values("source")},
        y AS (SELECT doc_id, octet_length(b) + 1 AS size, lang_level, source_level, CAST(floor(log2(octet_length(b) + 1) * 8) AS BIGINT) AS p2, hex(b) AS hx FROM x JOIN langs USING (lang) JOIN sources USING (source)),
        z AS (SELECT *, CAST(lang_level * {levels * levels} + source_level * {levels} + {level("p2")} AS BIGINT) AS cell FROM y),
        c AS (SELECT *, {hilbert.curve_table(3)}[cell + 1] AS curve FROM z),
        k AS (SELECT *, row_number() OVER (ORDER BY curve, md5(CAST(doc_id AS VARCHAR))) - 1 AS rk, count(*) OVER () AS n FROM c),
        s AS (SELECT *, n // {shards} AS small, n % {shards} AS more FROM k),
        t AS (SELECT *, CASE WHEN rk < more * (small + 1) THEN rk // (small + 1) ELSE more + (rk - more * (small + 1)) // greatest(small, 1) END AS shard FROM s),
        bytes AS (SELECT doc_id, hx, unnest(range(1, length(hx) // 2 + 1)) AS i FROM y),
        crc AS (SELECT doc_id, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list(CAST('0x' || substr(hx, CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT) ORDER BY i)), lambda a, v: xor(a >> 8, {_crc_table()}[(xor(a, v) & 255) + 1])) AS v FROM bytes GROUP BY doc_id)
        SELECT doc_id, size, CAST(xor(coalesce(crc.v, 4294967295), 4294967295) AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(rk - CASE WHEN shard <= more THEN shard * (small + 1) ELSE more * (small + 1) + (shard - more) * small END AS BIGINT) AS slot,
            CAST(NULL AS INTEGER) AS grown_shard, CAST(curve AS INTEGER) AS curve FROM t LEFT JOIN crc USING (doc_id)
    """


def top_k(k: int = 20) -> str:
    """Products and sums of unbounded size are taken as HUGEINT; a score beyond a long is given as the nearest long."""
    return f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, CAST(greatest(least(score, 9223372036854775807), -9223372036854775808) AS BIGINT) AS score FROM r WHERE rank <= {k}
    """
