"""Quality gate: citation density, decision, feedback and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.config_tables import DEFAULT_PROFILE, GATE_FALLBACK

SUBSTANTIVE_WORDS = 15
NO_ISSUES = "No issues."


def gate_profile(rows: DataFrame, config: DataFrame) -> DataFrame:
    """Attach the settings of each row's risk profile, else those of the medium profile, else defaults.

    The config table has one row per profile name; Spark broadcasts it by its known size.
    """
    own = config.select("risk_profile", F.struct(*GATE_FALLBACK).alias("_own"))
    base = config.filter(F.col("risk_profile") == DEFAULT_PROFILE).agg(F.any_value(F.struct(*GATE_FALLBACK)).alias("_base"))
    out = rows.join(own, "risk_profile", "left").withColumn("_base", base.scalar())
    return out.select(
        *rows.columns,
        *[F.coalesce(F.col("_own")[c], F.col("_base")[c], F.lit(v)).alias(c) for c, v in GATE_FALLBACK.items()],
    )


def substantive_paragraphs(content: Column) -> Column:
    blocks = F.transform(F.split(content, "\n\n"), t.strip)
    return F.filter(blocks, lambda p: (p != "") & ~F.startswith(p, F.lit("#")) & (t.word_count(p) > SUBSTANTIVE_WORDS))


def citation_density(units: DataFrame) -> DataFrame:
    """Share of substantive paragraphs with enough markers, and whether it meets the demanded ratio.

    Needs ``content`` and the gate settings on the row. Empty content fails with 0; content without
    substantive paragraphs passes with 1.
    """
    need = F.col("min_citations_per_paragraph")
    blocks = substantive_paragraphs(F.col("content"))
    n = F.size(blocks)
    good = F.size(F.filter(blocks, lambda p: t.citation_count(p) >= need))
    empty = F.coalesce("content", F.lit("")) == ""
    ratio = F.when(empty, 0.0).when(n == 0, 1.0).otherwise(F.try_divide(good.cast("double"), n))
    return units.withColumn("density_ratio", ratio).withColumn(
        "density_ok", ~empty & (F.col("density_ratio") >= F.col("min_citation_density_ratio"))
    )


def is_fixable() -> Column:
    return (F.col("unsupported") > 0) | (F.col("uncited") > 0) | (F.col("leakage") > 0) | (F.col("conflicts") > 0)


def fixable(reports: DataFrame) -> DataFrame:
    return reports.withColumn("fixable", is_fixable())


def decide(rows: DataFrame) -> DataFrame:
    """pass / fail / review from scores, counts, density and iteration."""
    passed = (
        (F.col("confidence") >= F.col("autopublish_threshold")) & F.col("density_ok") & (F.col("leakage") == 0)
    )
    again = (F.col("iteration") < F.col("max_writer_iterations")) & is_fixable()
    return rows.withColumn("decision", F.when(passed, "pass").when(again, "fail").otherwise("review"))


def _percent(c: Column) -> Column:
    return F.format_string("%.0f%%", F.bround(c * 100, 0))


def feedback(rows: DataFrame) -> DataFrame:
    """Notes for the writer or reviewer, one line per kind of issue, in fixed order."""

    def line(column: str, wording: str) -> Column:
        return F.when(F.col(column) > 0, F.concat(F.col(column).cast("string"), F.lit(wording)))

    density = F.when(
        ~F.col("density_ok"),
        F.concat(
            F.lit("Citations: "), _percent(F.col("density_ratio")),
            F.lit(" of the longer paragraphs carry at least "), F.col("min_citations_per_paragraph").cast("string"),
            F.lit(", wanted are "), _percent(F.col("min_citation_density_ratio")), F.lit("."),
        ),
    )
    issues = F.concat_ws(
        "\n",
        line("unsupported", " claim(s) are not backed by the evidence they cite: correct or drop them."),
        line("uncited", " claim(s) cite nothing: add a marker or declare the gap."),
        line("leakage", " claim(s) bring in facts that no excerpt holds: drop them or find a source."),
        line("conflicts", " claim(s) rest on sources that disagree: say so and cite both."),
        density,
    )
    at_limit = F.when(
        (F.col("decision") == "review") & (F.col("iteration") >= F.col("max_writer_iterations")),
        F.concat(F.lit("Iteration limit ("), F.col("max_writer_iterations").cast("string"), F.lit(") reached: a person decides.")),
    )
    return rows.withColumn("feedback", F.concat_ws("\n", F.when(issues == "", NO_ISSUES).otherwise(issues), at_limit))


def route(rows: DataFrame) -> DataFrame:
    d = F.col("decision")
    return (
        rows.withColumn("should_publish", d == "pass")
        .withColumn("should_rewrite", d == "fail")
        .withColumn("needs_human", d == "review")
    )


def evaluate(units: DataFrame, reports: DataFrame, config: DataFrame) -> DataFrame:
    """Full gate: units (content, risk_profile) with their reports -> decision, feedback and route."""
    keys = ["run_id", "path", "iteration"]
    rows = gate_profile(units.join(reports, keys), config)
    return route(feedback(decide(citation_density(rows))))


def conflict_policy(rows: DataFrame) -> DataFrame:
    """Optional conflict handling per profile: low is labelled mixed, medium and high with a conflict go to
    review (medium only once no rewrite is left)."""
    clash = F.col("conflicts") > 0
    p, d = F.col("risk_profile"), F.col("decision")
    return rows.withColumn(
        "decision", F.when(clash & (p == "high"), "review").when(clash & (p == "medium") & (d == "pass"), "review").otherwise(d)
    ).withColumn("label", F.when(clash & (p == "low"), "mixed"))


def style_gate(metrics: DataFrame, max_markers: float, min_burst: float, min_diversity: float, max_repeat: float) -> DataFrame:
    """Second gate over style metrics: marker density, sentence variety, word variety, structure variety."""
    ok = (
        (F.col("markers_per_1000") <= max_markers)
        & (F.coalesce("burstiness", F.lit(0.0)) >= min_burst)
        & (F.col("type_token_ratio") >= min_diversity)
        & (F.coalesce("structure_repeat", F.lit(0.0)) <= max_repeat)
    )
    return metrics.withColumn("style_ok", ok)
