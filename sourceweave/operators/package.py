"""Roll-ups of units and decisions into jobs and packages, and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .drafts import UNIT_KEYS, _ordered_text

SCORE_FIELDS = ("confidence", "coverage", "source_diversity")


def final_unit(units: DataFrame) -> DataFrame:
    """Last non-empty version per (run, path)."""
    rest = [c for c in units.columns if c not in ("run_id", "path")]
    return (
        units.filter(F.coalesce("content", F.lit("")) != "")
        .groupBy("run_id", "path")
        .agg(F.max_by(F.struct(*rest), "iteration").alias("_u"))
        .select("run_id", "path", "_u.*")
    )


def job_status(runs: DataFrame, gate_results: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Status over all iterations: any review -> review_required, else completed; failed when the run is in
    ``failures`` (run_id, message). Runs without gate results count as completed."""
    seen = gate_results.groupBy("run_id").agg(
        F.bool_and(F.col("decision") == "pass").alias("all_pass"), F.bool_or(F.col("decision") == "review").alias("any_review")
    )
    out = runs.select("run_id").join(seen, "run_id", "left")
    failed = F.lit(False)
    if failures is not None:
        out = out.join(failures.groupBy("run_id").agg(F.max("message").alias("error")), "run_id", "left")
        failed = F.col("error").isNotNull()
    status = (
        F.when(failed, "failed")
        .when(F.coalesce("all_pass", F.lit(True)), "completed")
        .when(F.col("any_review"), "review_required")
        .otherwise("completed")
    )
    return out.withColumn("status", status).drop("all_pass", "any_review")


def failures(runs: DataFrame, evidence: DataFrame, early: DataFrame) -> DataFrame:
    """Failure rows of all runs: ``early`` ones, and runs that found nothing for no earlier reason."""
    return early.unionByName(no_evidence(runs.join(early.select("run_id"), "run_id", "left_anti"), evidence))


def no_evidence(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Failure rows of runs that found nothing."""
    return runs.select("run_id").join(evidence.select("run_id"), "run_id", "left_anti").withColumn(
        "message", F.lit("No evidence was found")
    )


def package_scores(runs: DataFrame, units: DataFrame) -> DataFrame:
    """Mean of the units' scores per run, three digits, zeros without units."""
    means = units.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_units"), *[F.avg(F.col(f"scores.{c}")).alias(c) for c in SCORE_FIELDS]
    )
    return runs.select("run_id").join(means, "run_id", "left").select(
        "run_id",
        F.coalesce("n_units", F.lit(0)).alias("n_units"),
        *[F.coalesce(F.bround(c, 3), F.lit(0.0)).alias(c) for c in SCORE_FIELDS],
    )


def assemble_package(jobs: DataFrame, units: DataFrame, evidence: DataFrame, scores: DataFrame, stages: DataFrame | None = None) -> DataFrame:
    """One nested row per run: units, evidence, scores, lineage. Lists are bounded by paths and the evidence cap."""
    u = units.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("path", "unit_id", "content", "citations", "evidence_map", "scores", "lineage"))).alias("units")
    )
    e = evidence.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "ev_pos", "id", "url", "title", "author", "published_at", "retrieved_at", "excerpt", "excerpt_hash", "locator", "source_quality"
        ))).alias("evidence")
    )
    s = scores.select("run_id", F.struct(*SCORE_FIELDS).alias("scores"))
    out = jobs.join(u, "run_id", "left").join(e, "run_id", "left").join(s, "run_id", "left")
    if stages is not None:
        log = stages.groupBy("run_id").agg(
            F.array_sort(F.collect_list(F.struct("started_at", "completed_at", "stage", "path", "iteration"))).alias("stages")
        )
        out = out.join(log, "run_id", "left")
    return out


def result_flags(jobs: DataFrame) -> DataFrame:
    """succeeded needs a package; needs_review and failed follow the status."""
    s = F.col("status")
    return (
        jobs.withColumn("succeeded", (s == "completed") & F.col("has_package"))
        .withColumn("needs_review", s == "review_required")
        .withColumn("failed", s == "failed")
    )


def stage_durations(events: DataFrame, stages: list[str]) -> DataFrame:
    """Seconds per stage and run, total, and the stage that takes most of it."""
    seconds = F.unix_seconds("completed_at") - F.unix_seconds("started_at")
    wide = events.withColumn("_s", seconds).groupBy("run_id").pivot("stage", stages).agg(F.sum("_s"))
    filled = wide.select("run_id", *[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in stages])
    total = sum((F.col(s) for s in stages), F.lit(0))
    slowest = F.greatest(*stages)
    bottleneck = F.coalesce(*[F.when(F.col(s) == slowest, s) for s in stages])
    return filled.withColumn("total", total).withColumn("bottleneck", bottleneck).withColumn(
        "bottleneck_share", F.round(F.try_divide(slowest.cast("double"), F.col("total")), 4)
    )


def stage_rollup(events: DataFrame) -> DataFrame:
    """Seconds and records by (stage, iteration), by stage, and in all."""
    seconds = F.unix_seconds("completed_at") - F.unix_seconds("started_at")
    return (
        events.withColumn("_s", seconds)
        .rollup("stage", "iteration")
        .agg(F.sum("_s").alias("seconds"), F.count(F.lit(1)).alias("n"))
    )


TERMINAL = ("completed", "failed", "review_required")


def job_transitions(events: DataFrame, order: list[str]) -> DataFrame:
    """Latest status and stage per job off an event log (job_id, status, stage, ts), and when it ended."""
    ended = F.col("status").isin(*TERMINAL)
    return events.groupBy("job_id").agg(
        F.max_by("status", F.struct("ts", *order)).alias("status"),
        F.max_by("stage", F.when(F.col("stage").isNotNull(), F.struct("ts", *order))).alias("stage"),
        F.max("ts").alias("updated_at"),
        F.max(F.when(ended, F.col("ts"))).alias("completed_at"),
        F.count(F.lit(1)).alias("n_events"),
    )


def bibliography(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct cited sources per run, numbered by URL. Cited sources are bounded by the evidence cap."""
    cited = citations.select("run_id", "evidence_id").distinct()
    src = evidence.select("run_id", F.col("id").alias("evidence_id"), "url", "title")
    urls = cited.join(src, ["run_id", "evidence_id"]).groupBy("run_id", "url").agg(
        F.min("title").alias("title"), F.count(F.lit(1)).alias("n_excerpts")
    )
    rows = urls.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("url", "title", "n_excerpts"))).alias("s"))
    return rows.select("run_id", F.posexplode("s").alias("p", "s")).select("run_id", (F.col("p") + 1).alias("number"), "s.*")


def outline(units: DataFrame) -> DataFrame:
    """Headings in reading order with their level."""
    lines = F.filter(F.split("content", "\n"), lambda l: F.rlike(l, F.lit(r"^#+ ")))
    return units.select(*UNIT_KEYS, F.posexplode(lines).alias("pos", "line")).select(
        *UNIT_KEYS, "pos",
        F.length(F.regexp_extract("line", r"^(#+) ", 1)).alias("level"),
        t.strip(F.regexp_replace("line", r"^#+ ", "")).alias("heading"),
    )


def evidence_usage(evidence: DataFrame, citations: DataFrame) -> DataFrame:
    """How often and in how many units each excerpt is cited; unused ones have zeros."""
    used = citations.groupBy("run_id", "evidence_id").agg(
        F.count(F.lit(1)).alias("n_citations"), F.count_distinct("path", "iteration").alias("n_units")
    )
    return (
        evidence.select("run_id", F.col("id").alias("evidence_id"), "url")
        .join(used, ["run_id", "evidence_id"], "left")
        .fillna(0, ["n_citations", "n_units"])
    )


def list_jobs(
    jobs: DataFrame, status: str | None = None, topic: str | None = None, policy_id: str | None = None,
    created_from: str | None = None, created_to: str | None = None, after: tuple[str, str] | None = None, limit: int = 50,
) -> DataFrame:
    """One page of jobs, newest first. ``after`` is (created_at, job_id) of the previous page's last row."""
    out = jobs
    if status:
        out = out.filter(F.col("status") == status)
    if topic:
        out = out.filter(F.contains(F.lower("topic"), F.lit(topic.lower())))
    if policy_id:
        out = out.filter(F.col("policy_id") == policy_id)
    if created_from:
        out = out.filter(F.col("created_at") >= F.lit(created_from).cast("timestamp"))
    if created_to:
        out = out.filter(F.col("created_at") < F.lit(created_to).cast("timestamp"))
    if after:
        at = F.lit(after[0]).cast("timestamp")
        out = out.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("job_id") > after[1])))
    return out.orderBy(F.col("created_at").desc(), "job_id").limit(limit)


def run_summary(jobs: DataFrame, scores: DataFrame, gate_results: DataFrame, raw_counts: DataFrame, evidence_counts: DataFrame) -> DataFrame:
    """Per run: excerpts before and after the caps, scores, iterations used, result."""
    rounds = gate_results.groupBy("run_id").agg(F.max("iteration").alias("iterations"))
    out = (
        jobs.join(raw_counts.select("run_id", F.col("n").alias("n_raw")), "run_id", "left")
        .join(evidence_counts.select("run_id", F.col("n").alias("n_evidence")), "run_id", "left")
        .join(rounds, "run_id", "left")
        .join(scores, "run_id", "left")
        .fillna(0, ["n_raw", "n_evidence", "iterations"])
    )
    return out.withColumn(
        "reduction", F.round(F.coalesce(1 - F.try_divide(F.col("n_evidence").cast("double"), F.col("n_raw")), F.lit(0.0)), 4)
    )


def run_key(package_run_id: Column, job_id: Column) -> Column:
    """Directory key of a result."""
    return F.coalesce(package_run_id, job_id)


def content_document(units: DataFrame, jobs: DataFrame) -> DataFrame:
    """Readable text per run: path marker, content, rule and a line of figures for each unit."""
    figures = F.format_string(
        "%d cited, %d claims mapped; confidence %.3f, coverage %.3f, diversity %.3f",
        F.size("citations"), F.size("evidence_map"),
        *[F.bround(F.col(f"scores.{c}"), 3) for c in SCORE_FIELDS],
    )
    part = F.concat_ws("\n", F.concat(F.lit("[path "), "path", F.lit("]")), F.lit(""), F.col("content"), F.lit(""), F.lit("* * *"), figures)
    docs = units.groupBy("run_id").agg(_ordered_text(["path"], part, "\n\n").alias("document"))
    return jobs.select("run_id").join(docs, "run_id", "left").withColumn("document", F.coalesce("document", F.lit("(no content)")))
