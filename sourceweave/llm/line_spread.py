"""Line dedup: lines that stand on many sites are boilerplate and go.

A HyperLogLog sketch of sites per line hash, merged by aggregation, settles most lines. Lines whose estimate is near
the threshold get an exact count of distinct sites, so the verdict is exact wherever the sketch errs by less than the
margin (over six standard errors).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, words

MIN_SITES, MIN_WORDS = 8, 4
MARGIN, SKETCH_BITS = 0.10, 12
#: A text that other rows hold as a whole stays so if it would lose more than this share of its words: it is a copied
#: document, which is for document dedup to judge.
MOST = 0.5


def _lines() -> Column:
    return F.split("text", "\n")


def _eligible(line: Column) -> Column:
    return F.size(words(line)) >= MIN_WORDS


def _hashes() -> Column:
    """Hash of every line in order, null for a line with too few words."""
    return F.transform(_lines(), lambda x: F.when(_eligible(x), F.xxhash64(x)))


def boilerplate(docs: DataFrame, site: str = "source") -> DataFrame:
    """(line,): hashes of the lines that stand on at least ``MIN_SITES`` distinct sites. A null site is one site."""
    each = docs.select(F.coalesce(F.col(site), F.lit("")).alias("site"), F.explode(_hashes()).alias("line")).where("line IS NOT NULL")
    sketched = each.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"))
    estimate = F.hll_sketch_estimate("sketch")
    likely = staged(sketched.select("line", estimate.alias("sites")).where(F.col("sites") >= MIN_SITES * (1 - MARGIN)), "line-sites")
    near = likely.where(F.col("sites") <= MIN_SITES * (1 + MARGIN)).select("line")
    exact = each.join(near, "line").groupBy("line", "site").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count(F.lit(1)).alias("sites"))
    clear = likely.where(F.col("sites") > MIN_SITES * (1 + MARGIN)).select("line")
    return staged(clear.union(exact.where(F.col("sites") >= MIN_SITES).select("line")), "boilerplate")


def without_boilerplate(docs: DataFrame, site: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and ``n_lines``, ``n_removed``.

    Boilerplate goes however much of a text it is, save in texts that other rows hold as a whole (see ``MOST``). A null text stays null with no lines; repeated
    rows are treated each alike; a doc_id may be null or repeat. Columns named like a result, or underscored like a step here, are replaced.
    """
    docs = docs.drop("_id", "_text", "_out", "_marked", "_goes", "_rest")
    key = [F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("_id"), F.xxhash64("text").alias("_text")]
    found = boilerplate(docs, site)
    each = docs.select(*key, F.explode(_hashes()).alias("line")).where("line IS NOT NULL")
    mine = each.join(found, "line").groupBy("_id", "_text").agg(F.collect_set("line").alias("_out"))
    rows = docs.drop("n_lines", "n_removed").select("*", *key).join(mine, ["_id", "_text"], "left")
    marked = rows.withColumn(
        "_marked",
        F.when(
            F.col("_out").isNotNull(),
            F.transform(_lines(), lambda x: F.struct(x.alias("line"), F.size(words(x)).alias("n"), (_eligible(x) & F.array_contains("_out", F.xxhash64(x))).alias("out"))),
        ),
    )
    count = lambda test: F.aggregate(F.filter("_marked", test), F.lit(0), lambda n, x: n + x["n"])
    goes = F.coalesce(count(lambda x: x["out"]) <= MOST * count(lambda x: F.lit(True)), F.lit(False))
    # only texts with something to lose are asked for
    texts = rows.where("_out IS NOT NULL").groupBy("_text").agg(F.count(F.lit(1)).alias("_n"))
    twice = staged(texts.where("_n > 1").select("_text", F.lit(True).alias("_goes")), "line-copies")
    marked = marked.join(twice, "_text", "left")
    goes = F.col("_out").isNotNull() & (goes | F.col("_goes").isNull())
    rest = F.array_join(F.transform(F.filter("_marked", lambda x: ~x["out"]), lambda x: x["line"]), "\n")
    return (
        marked.withColumn("_goes", goes)
        .withColumns(
            {
                "n_lines": F.coalesce(F.size(_lines()), F.lit(0)).cast("long"),
                "n_removed": F.when(F.col("_goes"), F.size(F.filter("_marked", lambda x: x["out"]))).otherwise(0).cast("long"),
                "_rest": F.when(F.col("_goes"), rest).otherwise(F.col("text")),
            }
        )
        .withColumn("text", F.col("_rest"))
        .drop("_id", "_text", "_out", "_marked", "_goes", "_rest")
    )
