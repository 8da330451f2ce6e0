"""Queries on ``embeddings`` and on language models, and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hadamard_codes, hard_negatives, kneser_ney
from .common import read


def op11(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved))


#: All inner products of anchors and rows.
SQL11 = r"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id::BIGINT AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.r, a.id AS anchor_id, b.id AS other, b.r AS o, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.id % 50 = 0 AND a.r <> b.r),
p AS (SELECT r, anchor_id, other AS positive_id, o AS po, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, other, o) <= 5),
n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, po ORDER BY s.score DESC, s.other, s.o) AS rank
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op12(spark: SparkSession, sf: str) -> DataFrame:
    codes, books = hadamard_codes.compress(read(spark, sf, "embeddings").select("vec_id", "embedding", "label"))
    found = hadamard_codes.with_label_errors(codes)
    return found.select("vec_id", "code", "error", "label_error", F.lit(hadamard_codes.digest(books)).alias("codebooks_sha256"))


def _rounds(n: int) -> str:
    """Common table expressions of the rounds: assignment a0, codebook b1, a1, ..."""
    out = []
    for i in range(n + 1):
        out.append(
            f"a{i} AS MATERIALIZED (SELECT r, p, min(16 * (list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y)) + c)::BIGINT AS m"
            f" FROM parts JOIN b{i} USING (p) GROUP BY r, p)"
        )
        if i < n:
            out.append(
                f"u{i} AS (SELECT p, m % 16 AS c, i, floor(sum(v) / count(*)) AS v FROM (SELECT p, m, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM a{i} JOIN parts USING (r, p)) GROUP BY ALL),\n"
                f"w{i} AS (SELECT p, c, list(v ORDER BY i) AS z FROM u{i} GROUP BY ALL),\n"
                f"b{i + 1} AS MATERIALIZED (SELECT p, c, coalesce(z, y) AS y FROM b{i} LEFT JOIN w{i} USING (p, c))"
            )
    return ",\n".join(out)


#: Plain squared distances to all entries.
SQL12 = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, e[p * (len(e) // 8) + 1:(p + 1) * (len(e) // 8)] AS x FROM (SELECT r, e, unnest(range(8)) AS p FROM k)),
ids AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS c FROM k QUALIFY c < 16),
b0 AS MATERIALIZED (SELECT p, c, x AS y FROM ids JOIN parts USING (r)),
{_rounds(6)},
coded AS (SELECT r, string_agg(printf('%02x', m % 16), '' ORDER BY p) AS code, sum(m // 16)::BIGINT AS error FROM a6 GROUP BY r),
books AS (SELECT sha256(string_agg(t, ',' ORDER BY p, c)) AS codebooks_sha256 FROM (SELECT p, c, array_to_string(list_transform(y, lambda v: v::BIGINT), ',') AS t FROM b6))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN k USING (r) CROSS JOIN books
"""


def op13(spark: SparkSession, sf: str) -> DataFrame:
    found = kneser_ney.score_corpus(read(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


def _discounts(n: str) -> str:
    """SQL for d1, d2, d3 from the columns ``n``1 to ``n``4 of counts of counts."""
    y = f"({n}1 / ({n}1 + 2 * {n}2))"
    plain = lambda k: f"{k} - {k + 1} * {y} * {n}{k + 1} / {n}{k}"
    one = lambda k: f"CASE WHEN {n}1 > 0 AND {n}2 > 0 AND {n}{k} > 0 AND {plain(k)} > 0 AND {plain(k)} < {k} THEN {plain(k)} ELSE {k} / 2 END AS d{k}"
    return ", ".join(map(one, (1, 2, 3)))


#: The formulas on words and pairs themselves. An end is a space, a start two, which no word is.
SQL13 = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 7 = 2, false) AS held_out,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS ws
  FROM documents),
t AS MATERIALIZED (SELECT r, held_out, unnest(list_prepend('  ', ws[1:len(ws) - 1])) AS v, unnest(ws) AS w FROM d),
c AS MATERIALIZED (SELECT v, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY v, w),
x AS MATERIALIZED (SELECT v, sum(c)::DOUBLE AS total, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c > 2) AS n3 FROM c GROUP BY v),
j AS MATERIALIZED (SELECT w, count(*) AS j, sum(c) AS plain FROM c GROUP BY w),
pn AS (SELECT count(*) FILTER (c = 1)::DOUBLE AS n1, count(*) FILTER (c = 2)::DOUBLE AS n2, count(*) FILTER (c = 3)::DOUBLE AS n3, count(*) FILTER (c = 4)::DOUBLE AS n4 FROM c),
pd AS MATERIALIZED (SELECT {_discounts("n")} FROM pn),
wn AS MATERIALIZED (SELECT count(*) FILTER (j = 1)::DOUBLE AS n1, count(*) FILTER (j = 2)::DOUBLE AS n2, count(*) FILTER (j = 3)::DOUBLE AS n3, count(*) FILTER (j = 4)::DOUBLE AS n4,
  count(*)::DOUBLE AS vocabulary, coalesce(sum(j), 0)::DOUBLE AS pairs, coalesce(sum(plain), 0)::DOUBLE AS tokens FROM j),
wd AS MATERIALIZED (SELECT *, {_discounts("n")} FROM wn),
each AS (
  SELECT t.r, t.held_out, coalesce(plain, 0) AS plain, coalesce(c, 0) AS c, coalesce(j, 0) AS j, x.total, x.n1, x.n2, x.n3,
    CASE WHEN wd.pairs = 0 THEN 1 / (wd.vocabulary + 1)
      ELSE (coalesce(j, 0) - CASE coalesce(j, 0) WHEN 0 THEN 0 WHEN 1 THEN wd.d1 WHEN 2 THEN wd.d2 ELSE wd.d3 END
        + (wd.d1 * wd.n1 + wd.d2 * wd.n2 + wd.d3 * (wd.vocabulary - wd.n1 - wd.n2)) / (wd.vocabulary + 1)) / wd.pairs END AS share
  FROM t LEFT JOIN c USING (v, w) LEFT JOIN x USING (v) LEFT JOIN j USING (w) CROSS JOIN wd),
p AS (
  SELECT r, plain, CASE WHEN total IS NULL THEN share
    ELSE (c - CASE c WHEN 0 THEN 0 WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END + (d1 * n1 + d2 * n2 + d3 * n3) * share) / total END AS p
  FROM each CROSS JOIN pd),
s AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (plain > 0) AS n_known, sum(log10((plain + 1) / (tokens + vocabulary + 1))) AS base, sum(log10(p)) AS score
  FROM p CROSS JOIN wd GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, (SELECT tokens FROM wd)::BIGINT AS train_tokens, round(base, 6) AS base_score, round(score, 6) AS score
FROM d JOIN s USING (r)
"""


QUERIES = {"op11_hard_negatives": op11, "op12_hadamard_codes": op12, "op13_kneser_ney": op13}
SQL = {"op11_hard_negatives": SQL11, "op12_hadamard_codes": SQL12, "op13_kneser_ney": SQL13}
