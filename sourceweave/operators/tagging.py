"""Rule-based tagging against a taxonomy table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..session import counted
from .joins import contains_join


def tag_evidence(evidence: DataFrame, terms: DataFrame, keys: list[str], min_hits: int = 1, text: str = "excerpt") -> DataFrame:
    """(row, tag, hits): a row takes every tag of which it holds at least ``min_hits`` terms, repeats counted.

    Words are counted per row before they meet the terms, so a frequent term is one row per text.
    """
    counted = evidence.select(*keys, F.explode(t.token_counts(F.col(text))).alias("x")).select(*keys, F.col("x.token").alias("term"), "x.n")
    words = counted.join(terms.select("term").distinct(), "term", "left_semi")
    return words.join(terms, "term").groupBy(*keys, "tag").agg(F.sum("n").alias("hits")).filter(F.col("hits") >= min_hits)


def tag_closure(taxonomy: DataFrame) -> DataFrame:
    """(tag, ancestor, distance) pairs of a taxonomy table (tag, parent), each tag its own ancestor at 0.

    Pointer doubling: a step joins the pairs known with themselves and so doubles their reach, until nothing is new; a
    chain of n takes about log2(n) steps, each a written table. Of several ways up the shortest counts. A tag above itself
    is an error, found as soon as the reach spans the cycle.
    """
    known = taxonomy.where("parent IS NOT NULL AND tag IS NOT NULL").select("tag", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct()
    known, n = counted(known, "taxonomy-pairs")
    while n:
        if not known.where("tag = ancestor").isEmpty():
            raise ValueError("the taxonomy holds a cycle")
        on = known.select(F.col("tag").alias("ancestor"), F.col("ancestor").alias("_above"), F.col("distance").alias("_more"))
        further = known.join(on, "ancestor").select("tag", F.col("_above").alias("ancestor"), (F.col("distance") + F.col("_more")).alias("distance"))
        known, now = counted(known.unionByName(further).groupBy("tag", "ancestor").agg(F.min("distance").alias("distance")), "taxonomy-pairs")
        if now == n:
            break
        n = now
    return taxonomy.select("tag", F.col("tag").alias("ancestor"), F.lit(0).alias("distance")).distinct().unionByName(known)


def roll_up_tags(tags: DataFrame, taxonomy: DataFrame, keys: list[str]) -> DataFrame:
    """Tags of each row with all their ancestors; hits add up along the way."""
    up = tag_closure(taxonomy).select("tag", "ancestor")
    return tags.join(up, "tag").groupBy(*keys, F.col("ancestor").alias("tag")).agg(F.sum("hits").alias("hits"))


def tag_domains(urls: DataFrame, patterns: DataFrame, keys: list[str]) -> DataFrame:
    """Tags whose pattern occurs in the row's domain. Each distinct domain is matched once."""
    with_domain = urls.select(*keys, t.netloc(F.col("url")).alias("domain"))
    domains = with_domain.select("domain").distinct()
    hits = contains_join(domains, F.col("domain"), patterns, F.lower("pattern"), ["domain"])
    return with_domain.join(hits.select("domain", "tag").distinct(), "domain").select(*keys, "domain", "tag")


def tag_units(citations: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags of a unit = tags of the evidence it cites, strongest first."""
    unit = ["run_id", "path", "iteration"]
    cited = citations.select(*unit, "evidence_id").distinct()
    hits = cited.join(tags.select("run_id", F.col("id").alias("evidence_id"), "tag", "hits"), ["run_id", "evidence_id"])
    sums = hits.groupBy(*unit, "tag").agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("n_evidence"))
    return sums.withColumn("rank", F.row_number().over(W.partitionBy(*unit).orderBy(F.col("hits").desc(), "tag")))


def tag_coverage(citations: DataFrame, tags: DataFrame, all_tags: DataFrame, all_paths: DataFrame) -> DataFrame:
    """Citations by tag and path with sub-totals; combinations nobody cites appear with 0.

    Tags and paths are dimension rows, so their grid is bounded by the two configuration tables.
    """
    cited = citations.select("run_id", "path", "evidence_id").distinct()
    hits = cited.join(tags.select("run_id", F.col("id").alias("evidence_id"), "tag"), ["run_id", "evidence_id"])
    paths = all_paths.agg(F.collect_set("path")).scalar()
    grid = all_tags.select("tag", F.explode(paths).alias("path"), F.lit(0).alias("n"))
    counted = hits.groupBy("tag", "path").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(grid).cube("tag", "path").agg(F.sum("n").alias("n"))
