"""Queries of this subpackage and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_trees, line_spread, minhash, pieces, quality_outliers, secret_owners, shards, substrings, vector_queries, warc
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(vector_queries.QUERIES)
SQL: dict[str, str] = dict(vector_queries.SQL)


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


@query("op6_quality_outliers")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    judged = quality_outliers.with_verdicts(quality_outliers.base_counts(docs).drop("text"))
    return judged.select("doc_id", *quality_outliers.COUNTS, "base_failed", "kept", "n_lines")


@query("op9_secret_owners")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_owners.scan(read(spark, sf, "documents").select("doc_id", "text", "source"))
    of = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda x: x["kind"] < 3)
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(secret_owners.span_text(base), 256).alias("base_sha256"),
        secret_owners.span_text(F.col("secrets")).alias("spans"),
        "n_live",
        "n_example",
    )


#: Literal patterns and bounds; positions from the lengths of the pieces between matches.
SQL["op9_secret_owners"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
p(kind, pattern) AS (VALUES
  (0, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'AKIA[A-Z0-9]+'), (2, '[0-9a-f]+'),
  (3, 'gh[opsu]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\x20\n]+|[a-z][a-z0-9+]{1,15}://[A-Za-z0-9_.-]+:[A-Za-z0-9_.!-]{6,}@')),
hits AS (
  SELECT r, 0 AS kind, regexp_extract_all(text, (SELECT pattern FROM p WHERE kind = 0)) AS ms, string_split_regex(text, (SELECT pattern FROM p WHERE kind = 0)) AS ps FROM d
  UNION ALL SELECT r, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]{16,}'), string_split_regex(text, 'AKIA[A-Z0-9]{16,}') FROM d
  UNION ALL SELECT r, 2, regexp_extract_all(text, '[0-9a-f]{24,}'), string_split_regex(text, '[0-9a-f]{24,}') FROM d
  UNION ALL SELECT r, 3, regexp_extract_all(text, (SELECT pattern FROM p WHERE kind = 3)), string_split_regex(text, (SELECT pattern FROM p WHERE kind = 3)) FROM d),
each AS (
  SELECT r, kind, ms[i] AS m, ps, ms, i FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM hits WHERE len(ms) > 0)),
placed AS (
  SELECT r, kind, m, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM each),
spans AS (
  SELECT r, kind, s, s + length(m) AS e,
    CASE WHEN kind = 0 THEN regexp_extract(m, (SELECT pattern FROM p WHERE kind = 0), 2) ELSE m END AS v FROM placed),
good AS (SELECT * FROM spans WHERE kind <> 0 OR length(v) >= 6),
held AS (SELECT v, count(DISTINCT source) >= 3 OR count(DISTINCT (source, coalesce(doc_id::VARCHAR, ''))) >= 10 AS example FROM good JOIN d USING (r) GROUP BY v),
judged AS (
  SELECT good.*, example,
    NOT example AND length(good.v) >= 16 AND len(list_distinct(string_split(good.v, ''))) >= 8 AND regexp_matches(good.v, '[0-9]') AS live
  FROM good JOIN held ON good.v = held.v),
named AS (
  SELECT *, concat_ws(':', CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'live' END, s, e) AS t FROM judged),
by_row AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(t, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(t, ',' ORDER BY s, kind) FILTER (kind < 3 OR live) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (example) AS n_example
  FROM named GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN by_row USING (r)
"""


@query("op2_circulant_minhash")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    rule = minhash.Rule(shingle=3, num=85, den=100, bands=36, rows=5)
    found = minhash.near_groups(read(spark, sf, "documents").select("doc_id", "text"), rule)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op4_line_spread")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    rest = line_spread.without_boilerplate(read(spark, sf, "documents").select("doc_id", "text", "source"))
    text = F.coalesce("text", F.lit(""))
    return rest.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


SQL["op4_line_spread"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS site, text FROM documents),
s AS (SELECT r, site, string_split(text, chr(10)) AS ls FROM d WHERE text IS NOT NULL),
l AS (SELECT r, site, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM s),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
b AS (SELECT line FROM w WHERE n >= 4 GROUP BY line HAVING count(DISTINCT site) >= 8),
m AS (SELECT w.*, b.line IS NOT NULL AS gone FROM w LEFT JOIN b ON w.line = b.line),
k AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_gone, coalesce(sum(n) FILTER (gone), 0) > 0.5 * sum(n) AS most,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS rest, string_agg(line, chr(10) ORDER BY i) AS whole
  FROM m GROUP BY r),
c AS (SELECT whole FROM k GROUP BY whole HAVING count(*) > 1),
g AS (SELECT k.*, NOT (most AND c.whole IS NOT NULL) AS goes FROM k LEFT JOIN c USING (whole)),
t AS (
  SELECT doc_id, coalesce(n_lines, 0) AS n_lines, CASE WHEN goes THEN n_gone ELSE 0 END AS n_removed,
    coalesce(CASE WHEN goes THEN rest ELSE whole END, '') AS kept
  FROM d LEFT JOIN g USING (r))
SELECT doc_id, n_lines, n_removed, length(kept) AS n_chars, sha256(kept) AS text_sha256 FROM t
"""


@query("op5_decontaminate")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, read(spark, sf, "benchmark").select("item_id", "text"))


@query("op1_substrings")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    found = substrings.without_repeats(read(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows by their words, not by hash; positions count from 1.
SQL["op1_substrings"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, i, hash(ws[i:i + 34]) AS h, md5(array_to_string(ws[i:i + 34], ' ')) AS k
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
again AS (SELECT h, k FROM w GROUP BY h, k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM w JOIN again USING (h, k)),
cut AS (SELECT r, list(p) AS ps, count(*) AS n FROM gone GROUP BY r),
word AS (SELECT d.r, i, ws[i] AS t FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) d),
kept AS (SELECT word.r, string_agg(t, ' ' ORDER BY i) AS rest FROM word ANTI JOIN gone ON word.r = gone.r AND word.i = gone.p GROUP BY word.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (r) LEFT JOIN kept USING (r)
"""


@query("op8_warc")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages").select("page_id", "url", "html")
    archives = warc.write_archives(pages)
    records = warc.read_ranges(archives, warc.build_index(archives).find(pages.select("url")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 from the hexadecimal digest: ten hexadecimal digits are eight characters.
SQL["op8_warc"] = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS size, sha1(payload) AS hex FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), 'string_agg', '') AS digest FROM d),
g AS (SELECT hex, max(page_id) AS largest FROM d GROUP BY hex HAVING count(*) > 1)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
  CASE WHEN largest IS NOT NULL AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM b LEFT JOIN g USING (hex)
"""


@query("op7_html_trees")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return html_trees.extract(read(spark, sf, "pages"), html_trees.fit(spark))


@query("op10_pieces")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.encoded_and_checked(read(spark, sf, "documents").select("doc_id", "text"), pieces.load(pieces.default_model()))


@query("op3_shards")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    tokenizer = shards.load_tokenizer()
    written = shards.materialise(read(spark, sf, "documents").select("doc_id", "text"), tokenizer)
    records = shards.read_records(written, tokenizer)
    return records.select("slot", F.expr(f"slot div {shards.PER_SHARD}").alias("shard"), "doc_id", "part", F.col("n").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"))
