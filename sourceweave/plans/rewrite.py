"""The write-verify-gate loop over all open (run, path) rows at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import drafts as dr
from ..operators import gate as g
from ..operators import verify as v
from ..operators.package import final_unit
from ..session import scratch_path, staged

Writer = Callable[[DataFrame, int], DataFrame]  # open rows (run_id, path, feedback), iteration -> drafts
Judge = Callable[[DataFrame], DataFrame]  # units -> reports with counts, confidence and pass_rate


@dataclass(frozen=True)
class Rounds:
    units: DataFrame
    gate_results: DataFrame
    final: DataFrame


def rewrite_rounds(
    requests: DataFrame, evidence: DataFrame, config: DataFrame, write: Writer, judge: Judge, max_iterations: int | None = None
) -> Rounds:
    """Draft, judge and gate; rows that fail come back with their feedback until they pass, go to review,
    draft nothing or reach their profile's limit.

    The loop is bounded by the largest limit in ``config``, or by ``max_iterations`` if that is less. Each round is one job over
    the open rows; its drafts, units, reports and decisions are written to the shared checkpoint folder and read back, so the
    plan does not grow and a lost executor costs one round at most. Only an emptiness test reaches the driver.
    """
    spark = requests.sparkSession
    risk = requests.select("run_id", "risk_profile")
    have = evidence.select("run_id").distinct()
    open_rows = (
        dr.fan_out_paths(requests).select("run_id", "path").join(have, "run_id", "left_semi")
        .withColumn("feedback", F.lit(None).cast("string"))
    )
    done: list[str] = []
    largest = config.agg(F.max("max_writer_iterations")).first()[0] or 0
    for i in range(1, min(largest, max_iterations or largest) + 1):
        # drafts are the model's answers: kept, never asked for twice
        drafts = staged(write(open_rows, i).filter(F.coalesce("content", F.lit("")) != ""), f"drafts-{i}")
        units = staged(dr.build_units(drafts, evidence), f"units-{i}")
        reports = staged(judge(units), f"reports-{i}")
        scored = v.attach_scores(units.join(risk, "run_id"), reports)
        counts = reports.select(*dr.UNIT_KEYS, *v.COUNTS, "total_claims", "confidence", "pass_rate")
        done.append(scratch_path(spark, f"gate-{i}"))
        g.evaluate(scored, counts, config).write.parquet(done[-1])
        judged = spark.read.parquet(done[-1])
        open_rows = judged.filter("should_rewrite").select("run_id", "path", "feedback")
        if open_rows.isEmpty():
            break
    results = spark.read.parquet(*done)
    units = results.select(
        *dr.UNIT_KEYS, "unit_id", "content", "citations", "evidence_map", "scores", "gaps"
    )
    gate_results = results.select(
        *dr.UNIT_KEYS, "decision", "confidence", "pass_rate", *v.COUNTS, "total_claims", "density_ratio", "feedback",
        "should_publish", "should_rewrite", "needs_human",
    )
    return Rounds(units, gate_results, final_unit(units))
