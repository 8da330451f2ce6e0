"""Writing results: one nested record, readable text, evidence and verification rows per run.

Every sink is one distributed write; nothing passes through the driver. ``folders`` gives each run its
own folder (``run_key=<key>``); without it the key stays a column, which suits very many runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.package import content_document, run_key

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"


def result_records(jobs: DataFrame, packages: DataFrame, gate_results: DataFrame) -> DataFrame:
    """(run_key, record) with the whole result of a run as JSON: status, job, package or null, gate results.

    ``jobs``: run_id, job_id, status, ...; ``packages``: run_id, units, evidence, scores, ...
    """
    results = gate_results.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("path", "iteration", "decision", "confidence", "pass_rate", "feedback"))).alias("gate_results")
    )
    fields = [c for c in packages.columns if c != "run_id"]
    have = packages.select("run_id", F.struct("run_id", *fields).alias("package"))
    rows = jobs.join(have, "run_id", "left").join(results, "run_id", "left")
    none = F.array().cast(results.schema["gate_results"].dataType)
    record = F.struct(
        F.col("status"),
        F.struct(*[c for c in jobs.columns]).alias("job"),
        F.col("package"),
        F.coalesce("gate_results", none).alias("gate_results"),
    )
    text = F.to_json(record, {"ignoreNullFields": "false", "timestampFormat": ISO})
    return rows.select(run_key(F.col("package.run_id"), F.col("job_id")).alias("run_key"), text.alias("record"))


def _save(rows: DataFrame, path: str, folders: bool, text: bool = False) -> None:
    if folders:  # a run's rows in one task, which opens one file
        rows = rows.repartition("run_key")
    w = rows.write.mode("overwrite").option("timestampFormat", ISO)
    if not folders:
        w.json(path)
    elif text:
        w.partitionBy("run_key").text(path)
    else:
        w.partitionBy("run_key").json(path)


def write_result(jobs: DataFrame, packages: DataFrame, gate_results: DataFrame, path: str, folders: bool = False) -> None:
    _save(result_records(jobs, packages, gate_results), path, folders, text=True)


def write_content(units: DataFrame, jobs: DataFrame, path: str, folders: bool = False) -> None:
    docs = content_document(units, jobs).select(F.col("run_id").alias("run_key"), F.col("document").alias("value"))
    _save(docs, path, folders, text=True)


def write_evidence_json(jobs: DataFrame, evidence: DataFrame, path: str, folders: bool = False) -> None:
    """Evidence rows of runs that have a package, as JSON lines; other runs simply have no rows."""
    rows = evidence.join(jobs.filter("has_package").select("run_id"), "run_id", "left_semi")
    _save(rows.withColumn("run_key", F.col("run_id")), path, folders)


def verification_rows(jobs: DataFrame, scores: DataFrame, gate_results: DataFrame) -> DataFrame:
    """Gate results with the run's final status and confidence (0 without a package)."""
    results = gate_results.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("path", "iteration", "decision", "confidence", "pass_rate", "feedback"))).alias("gate_results")
    )
    rows = jobs.select("run_id", "job_id", "status", "has_package").join(
        scores.select("run_id", "confidence"), "run_id", "left"
    ).join(results, "run_id", "left")
    return rows.select(
        F.when(F.col("has_package"), F.col("run_id")).otherwise(F.col("job_id")).alias("run_key"),
        F.coalesce("gate_results", F.array().cast(results.schema["gate_results"].dataType)).alias("gate_results"),
        F.col("status").alias("final_status"),
        F.when(F.col("has_package"), F.coalesce("confidence", F.lit(0.0))).otherwise(0.0).alias("final_confidence"),
    )


def write_verification(jobs: DataFrame, scores: DataFrame, gate_results: DataFrame, path: str, folders: bool = False) -> None:
    _save(verification_rows(jobs, scores, gate_results), path, folders)
