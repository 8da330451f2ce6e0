"""Opt-in source rules: declared in a policy or request, off unless a caller applies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t


def enforce_reputation(evidence: DataFrame, resolved: DataFrame) -> DataFrame:
    """Drop rows that miss a reputation demand of the run's policy."""
    rules = resolved.select("run_id", F.col("reputation").alias("_r"))
    r, s = F.col("_r"), F.col("source_quality")
    ok = (
        (~r["require_peer_reviewed"] | s["is_peer_reviewed"])
        & (~r["require_primary_source"] | s["is_primary_source"])
        & (~r["block_marketing"] | ~s["conflict_of_interest"])
    )
    return evidence.join(rules, "run_id").filter(ok).drop("_r")


def age_days(published_at: Column, as_of: Column) -> Column:
    return F.datediff(as_of, published_at)


def enforce_recency(evidence: DataFrame, resolved: DataFrame, as_of: Column) -> DataFrame:
    """Drop rows older than the policy allows; rows without a date stay."""
    rules = resolved.select("run_id", F.col("recency.max_age_days").alias("_max_age"))
    old = age_days(F.col("published_at"), as_of) > F.col("_max_age")
    return evidence.join(rules, "run_id").filter(~F.coalesce(old, F.lit(False))).drop("_max_age")


def prefer_recent(candidates: DataFrame, limit: int, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Newest ``limit`` candidates per run, undated last."""
    newest = W.partitionBy("run_id").orderBy(F.col("published_at").desc_nulls_last(), *order)
    return candidates.withColumn("recency_rank", F.row_number().over(newest)).filter(F.col("recency_rank") <= limit)


def constraint_filter(evidence: DataFrame, requests: DataFrame) -> DataFrame:
    """Apply a request's date range and denied domains; undated rows pass the range."""
    rules = requests.select("run_id", F.col("constraints").alias("_c"))
    c, day = F.col("_c"), F.to_date("published_at")
    domain = t.netloc(F.col("url"))
    early = F.coalesce(day < c["date_from"].try_cast("date"), F.lit(False))
    late = F.coalesce(day > c["date_to"].try_cast("date"), F.lit(False))
    denied = t.any_of(c["domains_deny"], lambda d: F.contains(domain, F.lower(d)))
    return evidence.join(rules, "run_id").filter(~early & ~late & ~denied).drop("_c")


def recency_score(evidence: DataFrame, as_of: Column, max_age_days: int) -> DataFrame:
    """Mean linear decay per run over the dated rows: 1 when new, 0 at ``max_age_days`` and beyond."""
    decay = F.greatest(F.lit(0.0), F.lit(1.0) - age_days(F.col("published_at"), as_of) / F.lit(float(max_age_days)))
    return evidence.groupBy("run_id").agg(
        F.count("published_at").alias("n_dated"),
        F.round(F.coalesce(F.avg(F.least(F.lit(1.0), decay)), F.lit(0.0)), 6).alias("recency"),
    )
