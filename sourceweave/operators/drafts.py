"""Evidence to prompts, responses to content units, and a rule-based draft writer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import __version__, schemas
from ..functions import text as t
from ..functions.json_text import extract_json

# Formats that readers of blocks and drafts rely on.
BLOCK_HEAD = ("--- EVIDENCE [", "] ---")
GAP_MARK = "[INSUFFICIENT EVIDENCE: "

UNIT_KEYS = ["run_id", "path", "iteration"]
NO_EVIDENCE_GAP = "No evidence was found"
RAW_TEXT_GAP = "The response held no JSON object and needs a check by hand"


def _ordered_text(order: list[str], text: Column, sep: str) -> Column:
    """Aggregate: texts joined in the order of ``order``. Groups are bounded by the evidence cap."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("_t"))))
    return F.array_join(F.transform(rows, lambda r: r["_t"]), sep)


def evidence_block(evidence: DataFrame) -> DataFrame:
    """One listing per run: id line, source line, excerpt, blank line, for each excerpt."""
    source = F.concat_ws(
        " | ",
        F.concat(F.lit("URL: "), "url"),
        F.concat(F.lit("Title: "), F.nullif("title", F.lit(""))),
        F.concat(F.lit("Author: "), F.nullif("author", F.lit(""))),
        F.concat(F.lit("Published: "), F.date_format("published_at", "yyyy-MM-dd")),
        F.concat(F.lit("Reputation: "), F.nullif(F.col("source_quality.domain_reputation"), F.lit(""))),
    )
    entry = F.concat_ws("\n", F.concat(F.lit(BLOCK_HEAD[0]), "id", F.lit(BLOCK_HEAD[1])), source, F.col("excerpt"), F.lit(""))
    return evidence.groupBy("run_id").agg(
        _ordered_text(["ev_pos"], entry, "\n").alias("block"), F.count(F.lit(1)).alias("n_evidence")
    )


def fan_out_paths(requests: DataFrame) -> DataFrame:
    """One row per request and output path, in the order asked for."""
    return requests.select("*", F.posexplode("paths").alias("path_pos", "path")).drop("paths")


def writer_prompts(requests: DataFrame, evidence: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """Prompt text per (run, path). ``feedback`` (run_id, path, feedback) adds a section to open rows."""
    rows = fan_out_paths(requests).join(evidence_block(evidence), "run_id")
    if feedback is None:
        rows = rows.withColumn("feedback", F.lit(None).cast("string"))
    else:
        rows = rows.join(feedback.select("run_id", "path", "feedback"), ["run_id", "path"], "left")
    notes = F.when(
        F.col("feedback").isNotNull(),
        F.concat(F.lit("Notes on the last version:\n"), "feedback", F.lit("\nCorrect these points; mark what stays open.")),
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Topic: "), "topic"),
        F.concat(F.lit("Subtopics: "), F.when(F.size("subtopics") > 0, F.array_join("subtopics", ", ")).otherwise("None specified")),
        F.concat(F.lit("Audience: "), "audience"),
        F.concat(F.lit("Path: "), "path"),
        F.concat(F.lit("Excerpts: "), F.col("n_evidence").cast("string")),
        F.lit(""),
        F.col("block"),
        notes,
    )
    return rows.select("run_id", "path", "path_pos", text.alias("prompt"))


def verifier_prompts(units: DataFrame, evidence: DataFrame) -> DataFrame:
    """Draft text followed by the run's excerpts, each under its id and URL."""
    entry = F.concat_ws("\n", F.concat(F.lit("["), "id", F.lit("] (URL: "), "url", F.lit(")")), F.col("excerpt"), F.lit(""))
    block = evidence.groupBy("run_id").agg(_ordered_text(["ev_pos"], entry, "\n").alias("block"))
    text = F.concat_ws("\n", F.lit("Draft:"), F.col("content"), F.lit(""), F.lit("Excerpts:"), F.col("block"))
    return units.join(block, "run_id").select(*UNIT_KEYS, text.alias("prompt"))


def apply_model(prompts: DataFrame, fn: Callable[[list[str]], list[str]], keys: list[str] = UNIT_KEYS) -> DataFrame:
    """Caller-supplied text model over a prompt table, Arrow batch by batch: ``response`` per prompt row."""
    kept = prompts.select(*keys, "prompt")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "prompt")

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            out = pdf[keys].copy()
            out["response"] = list(fn(pdf["prompt"].tolist()))
            yield out

    return kept.mapInPandas(run, f"{fields}, response string")


def extract_json_column(responses: DataFrame) -> DataFrame:
    return responses.withColumn("json", extract_json(F.col("response")))


def parse_drafts(responses: DataFrame) -> DataFrame:
    """Responses -> content, cited ids, claim map, gaps. Text without JSON becomes the content as it is."""
    r = extract_json_column(responses).withColumn("d", F.from_json("json", schemas.DRAFT_JSON))
    d, ok = F.col("d"), F.col("json").isNotNull()
    no_ids, no_map = F.array().cast("array<string>"), F.array().cast(schemas.CLAIM_MAP)
    return r.select(
        *[c for c in responses.columns if c != "response"],
        F.when(ok, F.coalesce(d["content"], F.lit(""))).otherwise(t.strip(F.col("response"))).alias("content"),
        F.when(ok, F.coalesce(d["citations_used"], no_ids)).otherwise(no_ids).alias("citations_used"),
        F.when(ok, F.coalesce(d["evidence_map"], no_map)).otherwise(no_map).alias("evidence_map"),
        F.when(ok, F.coalesce(d["gaps"], no_ids)).otherwise(F.array(F.lit(RAW_TEXT_GAP))).alias("gaps"),
        ok.alias("structured"),
    )


def cited(drafts: DataFrame) -> DataFrame:
    """One row per cited id, with its position."""
    return drafts.select(*UNIT_KEYS, F.posexplode("citations_used").alias("cite_pos", "evidence_id"))


def resolve_citations(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cited ids that the run's evidence holds, in order and with their URL; repeats stay."""
    known = evidence.select("run_id", F.col("id").alias("evidence_id"), "url")
    return cited(drafts).join(known, ["run_id", "evidence_id"])


def dangling_citations(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cited ids that the run's evidence does not hold."""
    known = evidence.select("run_id", F.col("id").alias("evidence_id"))
    return cited(drafts).join(known, ["run_id", "evidence_id"], "left_anti")


def resolve_evidence_map(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with the ids that resolve. Empty claims go; a claim without any known id keeps an empty list."""
    claims = drafts.select(*UNIT_KEYS, F.posexplode("evidence_map").alias("claim_pos", "m")).filter(
        F.coalesce(F.col("m.claim"), F.lit("")) != ""
    )
    ids = claims.select(
        *UNIT_KEYS, "claim_pos", F.col("m.claim").alias("claim"), F.posexplode_outer("m.evidence_ids").alias("id_pos", "evidence_id")
    )
    known = evidence.select("run_id", F.col("id").alias("evidence_id"), F.lit(True).alias("known"))
    joined = ids.join(known, ["run_id", "evidence_id"], "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("id_pos", "evidence_id"))))
    return joined.groupBy(*UNIT_KEYS, "claim_pos").agg(
        F.any_value("claim").alias("claim"),
        F.transform(kept, lambda s: s["evidence_id"]).alias("evidence_ids"),
    )


def source_diversity(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct cited URLs over distinct available URLs, at most 1, per unit."""
    used = resolve_citations(drafts, evidence).groupBy(*UNIT_KEYS).agg(F.count_distinct("url").alias("n_cited"))
    offered = evidence.groupBy("run_id").agg(F.count_distinct("url").alias("n_available"))
    n = F.coalesce("n_cited", F.lit(0)).cast("double")
    return (
        drafts.select(*UNIT_KEYS)
        .join(used, UNIT_KEYS, "left")
        .join(offered, "run_id", "left")
        .select(
            *UNIT_KEYS,
            F.coalesce("n_cited", F.lit(0)).alias("n_cited"),
            F.coalesce("n_available", F.lit(0)).alias("n_available"),
            F.least(F.lit(1.0), n / F.greatest(F.lit(1), F.coalesce("n_available", F.lit(0))).cast("double")).alias("source_diversity"),
        )
    )


def empty_draft(requests: DataFrame, evidence: DataFrame, drafts: DataFrame) -> DataFrame:
    """Flags per (run, path): has_content, has_gaps; runs without evidence get a null draft and one gap."""
    have = evidence.select("run_id").distinct().withColumn("_e", F.lit(True))
    rows = (
        fan_out_paths(requests).select("run_id", "path")
        .join(have, "run_id", "left")
        .join(drafts.select("run_id", "path", "content", "gaps"), ["run_id", "path"], "left")
    )
    none = F.col("_e").isNull()
    gaps = F.when(none, F.array(F.lit(NO_EVIDENCE_GAP))).otherwise(F.coalesce("gaps", F.array().cast("array<string>")))
    content = F.when(~none, F.col("content"))
    return rows.select(
        "run_id", "path", content.alias("content"), gaps.alias("gaps"),
        F.coalesce(content != "", F.lit(False)).alias("has_content"), (F.size(gaps) > 0).alias("has_gaps"),
    )


def unit_id(run_id: Column, path: Column, iteration: Column) -> Column:
    return F.concat(F.lit("cu_"), F.sha2(F.concat_ws("\u0001", run_id, path, iteration.cast("string")), 256))


def stamp_lineage(units: DataFrame, requests: DataFrame, engine_version: str = __version__) -> DataFrame:
    """Attach which policy, taxonomy, path set, run and version made each unit; absent ids become ''."""
    origin = requests.select("run_id", "policy_id", "taxonomy_id", "path_config_id")
    lineage = F.struct(
        F.coalesce("policy_id", F.lit("")).alias("policy_id"),
        F.coalesce("taxonomy_id", F.lit("")).alias("taxonomy_id"),
        F.coalesce("path_config_id", F.lit("")).alias("path_config_id"),
        F.col("run_id").alias("run_id"),
        F.lit(engine_version).alias("engine_version"),
    )
    return units.join(origin, "run_id").withColumn("lineage", lineage).drop("policy_id", "taxonomy_id", "path_config_id")


def build_units(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Parsed drafts -> content units with resolved citations, claim map and diversity score."""
    cites = resolve_citations(drafts, evidence).groupBy(*UNIT_KEYS).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("cite_pos", "evidence_id", "url"))),
            lambda s: F.struct(s["evidence_id"].alias("evidence_id"), s["url"].alias("url")),
        ).alias("citations")
    )
    maps = resolve_evidence_map(drafts, evidence).groupBy(*UNIT_KEYS).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("claim_pos", "claim", "evidence_ids"))),
            lambda s: F.struct(s["claim"].alias("claim"), s["evidence_ids"].alias("evidence_ids")),
        ).alias("_map")
    )
    diversity = source_diversity(drafts, evidence).select(*UNIT_KEYS, "source_diversity")
    return (
        drafts.drop("evidence_map", "citations_used")
        .join(cites, UNIT_KEYS, "left")
        .join(maps, UNIT_KEYS, "left")
        .join(diversity, UNIT_KEYS, "left")
        .withColumn("unit_id", unit_id(F.col("run_id"), F.col("path"), F.col("iteration")))
        .withColumn("citations", F.coalesce("citations", F.array().cast(schemas.CITATIONS)))
        .withColumn("evidence_map", F.coalesce("_map", F.array().cast(schemas.CLAIM_MAP)))
        .withColumn(
            "scores",
            F.struct(F.lit(0.0).alias("confidence"), F.lit(0.0).alias("coverage"), F.col("source_diversity").alias("source_diversity")),
        )
        .drop("_map", "source_diversity")
    )


# --- rule-based writer ------------------------------------------------------------------------

def headings(requests: DataFrame) -> DataFrame:
    """Topic and subtopics as numbered headings."""
    return requests.select("run_id", F.posexplode(F.concat(F.array("topic"), "subtopics")).alias("heading_pos", "heading"))


def heading_matches(requests: DataFrame, evidence: DataFrame, limit: int) -> DataFrame:
    """Longest ``limit`` excerpts holding every word of a heading, per run and heading."""
    asked = headings(requests).withColumn("words", F.array_distinct(t.tokens(F.col("heading"))))
    wanted = asked.select("run_id", "heading_pos", F.size("words").alias("n_words"), F.explode("words").alias("word"))
    words = evidence.select(
        "run_id", "id", F.length("excerpt").alias("n_chars"), "ev_pos", F.explode(F.array_distinct(t.tokens(F.col("excerpt")))).alias("word")
    )
    hits = (
        wanted.join(words, ["run_id", "word"])
        .groupBy("run_id", "heading_pos", "id", "n_chars", "ev_pos")
        .agg(F.count(F.lit(1)).alias("n"), F.any_value("n_words").alias("n_words"))
        .filter("n = n_words")
    )
    longest = W.partitionBy("run_id", "heading_pos").orderBy(F.col("n_chars").desc(), "ev_pos")
    return hits.withColumn("rank", F.row_number().over(longest)).filter(F.col("rank") <= limit).select(
        "run_id", "heading_pos", "rank", "id"
    )


def extractive_picks(requests: DataFrame, evidence: DataFrame, paths: DataFrame, widest: int | None = None) -> DataFrame:
    """Excerpts chosen per (run, path, heading); a path takes its ``per_heading`` longest.

    ``widest`` is the largest ``per_heading``; it is read off the path table when not given.
    """
    if widest is None:
        widest = int(paths.agg(F.max("per_heading")).first()[0] or 0)
    best = heading_matches(requests, evidence, widest)
    return (
        fan_out_paths(requests).select("run_id", "path")
        .join(paths.select("path", "per_heading"), "path")
        .join(best, "run_id")
        .filter(F.col("rank") <= F.col("per_heading"))
        .drop("per_heading")
        .join(evidence.select("run_id", "id", "url", "excerpt"), ["run_id", "id"])
    )


def cited_paragraph(excerpt: Column, evidence_id: Column) -> Column:
    return F.concat(excerpt, F.lit(" [ev:"), evidence_id, F.lit("]"))


def assemble_drafts(requests: DataFrame, evidence: DataFrame, picks: DataFrame, paragraph: Column, iteration: Column) -> DataFrame:
    """Draft text per (run, path): title, a section per heading, a gap marker where nothing was picked.

    ``picks`` come from :func:`extractive_picks`; ``paragraph`` says how one pick reads.
    """
    heads = headings(requests).join(fan_out_paths(requests).select("run_id", "path"), "run_id")
    title = heads.filter("heading_pos = 0").select(
        "run_id", "path", F.lit(-1).alias("heading_pos"), F.lit(0).alias("rank"), F.concat(F.lit("# "), "heading").alias("line")
    )
    section = heads.select("run_id", "path", "heading_pos", F.lit(0).alias("rank"), F.concat(F.lit("## "), "heading").alias("line"))
    body = picks.select("run_id", "path", "heading_pos", "rank", paragraph.alias("line"))
    gap = heads.join(picks.select("run_id", "path", "heading_pos"), ["run_id", "path", "heading_pos"], "left_anti")
    marker = gap.select(
        "run_id", "path", "heading_pos", F.lit(1).alias("rank"),
        F.concat(F.lit(GAP_MARK), "heading", F.lit("]")).alias("line"),
    )
    lines = title.unionByName(section).unionByName(body).unionByName(marker)
    have = evidence.select("run_id").distinct()
    return (
        lines.join(have, "run_id", "left_semi")
        .groupBy("run_id", "path")
        .agg(_ordered_text(["heading_pos", "rank"], F.col("line"), "\n\n").alias("content"))
        .withColumn("iteration", iteration)
    )


def extractive_draft(requests: DataFrame, evidence: DataFrame, paths: DataFrame) -> DataFrame:
    """Draft made of verbatim excerpts, each paragraph ending in its marker, with the ids and claims it uses."""
    picks = extractive_picks(requests, evidence, paths)
    text = assemble_drafts(requests, evidence, picks, cited_paragraph(F.col("excerpt"), F.col("id")), F.lit(1))
    lists = picks.groupBy("run_id", "path").agg(
        F.array_sort(F.collect_list(F.struct("heading_pos", "rank", "id", "excerpt"))).alias("p")
    )
    gaps = F.regexp_extract_all("content", F.lit(r"\[INSUFFICIENT EVIDENCE: ([^\]]*)\]"), F.lit(1))
    ids = F.transform("p", lambda s: s["id"])
    claims = F.transform("p", lambda s: F.struct(s["excerpt"].alias("claim"), F.array(s["id"]).alias("evidence_ids")))
    return text.join(lists, ["run_id", "path"], "left").select(
        *UNIT_KEYS, "content",
        F.coalesce(ids, F.array().cast("array<string>")).alias("citations_used"),
        F.coalesce(claims, F.array().cast(schemas.CLAIM_MAP)).alias("evidence_map"),
        gaps.alias("gaps"),
    )
