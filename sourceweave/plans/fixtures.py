"""Entities of the data model read off the sample tables.

The sample tables hold pages, documents and events rather than requests, reports and jobs. Each
function here derives one entity from whole tables; ``oracle`` states the same rules in SQL.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drafts as dr
from ..sources import config_tables as cfg
from ..sources import crawl

RETRIEVED = "2024-01-31 00:00:00"

# Policies used with the page corpus. Hosts look like blog.<word>.example.{com,net,org}.
POLICIES = (
    {
        "id": "open",
        "domains_deny": ["spam-farm", "cheap-pills", "casino-win"],
        "reputation": {"trusted_institutions": ["thth", ".gov"]},
        "topic_overrides": [
            {"topic_pattern": "^In", "domains_allow": [".example.net"]},
            {
                "topic_pattern": "t",
                "domains_deny": ["blog."],
                "reputation": {"require_primary_source": True, "trusted_institutions": ["example.net"]},
            },
        ],
    },
    {
        "id": "org-net",
        "name": "Organisations and networks",
        "domains_allow": [".org", ".NET"],
        "domains_deny": ["Spam-Farm"],
        "reputation": {"trusted_institutions": [".org"]},
        "max_sources_per_run": 30,
        "topic_overrides": [
            {"topic_pattern": "th|an", "domains_deny": ["m."], "recency": {"max_age_days": 365}},
        ],
    },
    {
        "id": "reviewed",
        "name": "Reviewed sources",
        "domains_deny": ["reddit.com", "quora.com", "medium.com", "casino"],
        "reputation": {"trusted_institutions": [".gov", ".edu", "the"]},
        "recency": {"max_age_days": 1825},
        "max_sources_per_run": 15,
    },
)

# Output paths: id, label, excerpts per heading.
PATHS = (("learn", "Learn", 3), ("explore", "Explore", 2), ("apply", "Apply", 1))

# Small taxonomy over function words of the corpus languages: tag, parent, terms.
TAXONOMY = (
    ("english", "germanic", ("the", "of", "and", "that", "with")),
    ("german", "germanic", ("der", "die", "und", "das")),
    ("french", "romance", ("de", "la", "le", "que", "les")),
    ("spanish", "romance", ("el", "los", "que", "de", "la")),
    ("germanic", "european", ()),
    ("romance", "european", ()),
    ("european", None, ()),
)
# Tag by domain pattern.
DOMAIN_TAGS = (("network", ".net"), ("organisation", ".org"), ("weblog", "blog."), ("mobile", "m."), ("pharmacy", "pills"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def policies(spark: SparkSession) -> DataFrame:
    rows = [(i, json.dumps(p)) for i, p in enumerate(POLICIES)]
    return cfg.read_policies(cfg.parse_policy_lines(spark.createDataFrame(rows, "ord int, value string")))


def path_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PATHS), "path string, label string, per_heading int")


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, b, _ in TAXONOMY], "tag string, parent string")


def taxonomy_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, w) for a, _, ws in TAXONOMY for w in ws], "tag string, term string")


def domain_tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DOMAIN_TAGS), "tag string, pattern string")


def raw_requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per benchmark item: its first word is the topic, all its other distinct words are subtopics."""
    i = F.col("item_id")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))

    def by(n: int, step: int, values: list) -> Column:
        c = F.lit(None)
        for k, v in enumerate(values):
            c = F.when(F.pmod(F.floor(i / step), F.lit(n)) == k, v).otherwise(c)
        return c

    return (
        table(spark, sf, "benchmark")
        .withColumn("w", words)
        .select(
            F.concat(F.lit("run_"), i.cast("string")).alias("run_id"),
            F.get("w", F.lit(0)).alias("topic"),
            F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("subtopics"),
            by(3, 1, [
                F.array(F.lit("learn")),
                F.array(F.lit("learn"), F.lit("explore")),
                F.array(F.lit("learn"), F.lit("explore"), F.lit("apply")),
            ]).alias("paths"),
            by(5, 1, [
                F.struct(
                    F.lit("2020-01-01").alias("date_from"),
                    F.lit("2023-06-30").alias("date_to"),
                    F.array(F.lit("ththed.example.org"), F.lit("example.org")).alias("domains_allow"),
                    F.array(F.lit("blog.")).alias("domains_deny"),
                    F.lit(None).cast("string").alias("jurisdiction"),
                )
            ]).alias("constraints"),
            by(3, 3, ["open", "org-net", "reviewed"]).alias("policy_id"),
            by(4, 1, ["low", "medium", "high", None]).alias("risk_profile"),
        )
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return cfg.read_requests(raw_requests(spark, sf))


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The page corpus as crawl results."""
    return crawl.read_crawl(crawl.pages_as_fetches(table(spark, sf, "pages")))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`page_texts`; the paragraphs of every other page, but the last, close with a survey figure of the page, so
    that sources can disagree."""
    n = F.length("raw_html")
    survey = F.concat(F.lit(" A yearly survey of the region counted "), (1000 + F.pmod(F.floor(n / 2), F.lit(3))).cast("string"), F.lit(" visitors on the main site.\n\n"))
    return page_texts(spark, sf).withColumn("markdown", F.when(n % 2 == 0, F.replace("markdown", F.lit("\n\n"), survey)).otherwise(F.col("markdown")))


def document_url() -> Column:
    top = (
        F.when(F.col("lang") == "en", "org").when(F.col("lang") == "fr", "gov").when(F.col("lang") == "es", "edu").otherwise("com")
    )
    return F.concat(F.lit("https://"), "source", F.lit(".example."), top, F.lit("/doc/"), F.col("doc_id").cast("string"))


def document_fetches(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as raw fetches: toxic ones failed, low-quality ones answered 404."""
    doc = F.col("doc_id")
    day = F.date_add(F.lit("2019-01-01").cast("date"), F.pmod(doc, F.lit(1800)).cast("int"))
    published = F.when(F.col("lang") == "de", "2024").otherwise(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00Z")))
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.select(
        "doc_id",
        "source",
        document_url().alias("url"),
        (F.coalesce("toxic", F.lit(0)) == 0).alias("fetched"),
        F.when(F.col("quality") == 0, 404).alias("status_code"),
        F.lit(None).cast("string").alias("title"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("markdown"),
        F.lit(None).cast("string").alias("raw_html"),
        F.create_map(
            F.lit("title"), F.when(F.col("lang") == "en", "").otherwise(F.concat(F.lit("Doc "), doc.cast("string"))),
            F.lit("og:title"), F.concat("lang", F.lit(" document "), doc.cast("string")),
            F.lit("og:author"), F.col("source"),
            F.lit("article:published_time"), published,
        ).alias("metadata"),
    )


def document_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as crawled pages of one run per source."""
    raw = document_fetches(spark, sf)
    return crawl.read_crawl(raw.withColumnsRenamed({"source": "run_id", "doc_id": "page_pos"}))


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """Judged claims read off the events: five users form a run, each user is one output path."""
    e = table(spark, sf, "events")
    kind, v = F.col("event_type"), F.col("value")
    run = F.floor(F.col("user_id") / 5)
    return e.select(
        F.concat(F.lit("run_"), run.cast("string")).alias("run_id"),
        F.concat(F.lit("path_"), F.pmod("user_id", F.lit(5)).cast("string")).alias("path"),
        F.least(F.lit(3), 1 + F.floor((F.dayofmonth("ts") - 1) / 10)).cast("int").alias("iteration"),
        F.when((kind == "error") & (v < 1), "leakage")
        .when((kind == "signup") & (v < 3), "uncited")
        .when((kind == "purchase") & (v < 3), "gap_acknowledged")
        .when((kind == "view") & (v < 1), "conflict")
        .otherwise("supported")
        .alias("assessment"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.pmod(run, F.lit(3)) + 1).cast("int")).alias("risk_profile"),
    )


def stage_events(spark: SparkSession, sf: str) -> DataFrame:
    """Stage records read off line items: an order is a job, a line one stage lasting its quantity in seconds."""
    li = table(spark, sf, "lineitem")
    stages = F.array(*[F.lit(s) for s in ("discover", "write", "verify", "publish")])
    start = F.col("l_shipdate").cast("timestamp")
    return li.select(
        F.concat(F.lit("job_"), F.col("l_orderkey").cast("string")).alias("run_id"),
        F.element_at(stages, (F.pmod("l_linenumber", F.lit(4)) + 1).cast("int")).alias("stage"),
        F.lit("main").alias("path"),
        F.col("l_linenumber").cast("int").alias("iteration"),
        start.alias("started_at"),
        F.timestamp_seconds(F.unix_seconds(start) + F.col("l_quantity").cast("bigint")).alias("completed_at"),
    )


def retrieved_at() -> Column:
    return F.lit(RETRIEVED).cast("timestamp")


def _flaw(iteration: int) -> Column:
    """Which defect a paragraph still has: it depends on the excerpt's length and fades with the rounds."""
    n = F.length("excerpt")
    return F.when(F.lit(iteration) <= F.pmod(F.floor(n / 8), F.lit(4)), F.pmod(n, F.lit(8))).otherwise(9)


def flawed_paragraph(iteration: int) -> Column:
    flaw = _flaw(iteration)
    marker = F.concat(F.lit(" [ev:"), "id", F.lit("]"))
    return (
        F.when(flaw == 0, F.col("excerpt"))
        .when(flaw == 1, F.concat("excerpt", F.lit(" [ev:ev_unknown]")))
        .when(flaw == 2, F.concat("excerpt", F.lit(" Observed 98765 cases."), marker))
        .when(flaw.isin(4, 5, 6) & F.col("peer").isNotNull(), F.concat("excerpt", marker, F.lit("[ev:"), "peer", F.lit("]")))
        .otherwise(F.concat("excerpt", marker))
    )


def model_responses(requests: DataFrame, evidence: DataFrame, picks: DataFrame, iteration: int) -> DataFrame:
    """Writer responses of a careless model: some paragraphs lack markers, cite unknown ids, add a figure or cite a further
    survey without reading it, and the JSON comes bare, fenced or not at all."""
    flaw = _flaw(iteration)
    surveys = evidence.where(F.contains("excerpt", F.lit("yearly survey"))).groupBy("run_id").agg(F.min("id").alias("peer"))
    picks = picks.join(surveys, "run_id", "left")
    text = dr.assemble_drafts(requests, evidence, picks, flawed_paragraph(iteration), F.lit(iteration))
    cited = F.when(flaw == 1, F.lit("ev_unknown")).when(flaw != 0, F.col("id"))
    rows = F.array_sort(F.collect_list(F.struct(
        "heading_pos", "rank", cited.alias("cited"),
        F.struct(
            F.when(F.pmod(F.length("excerpt"), F.lit(8)) == 3, "").otherwise(F.col("excerpt")).alias("claim"),
            F.array(F.coalesce(cited, F.col("id"))).alias("evidence_ids"),
        ).alias("m"),
    )))
    lists = picks.groupBy("run_id", "path").agg(rows.alias("p"))
    body = F.to_json(F.struct(
        "content",
        F.filter(F.transform("p", lambda s: s["cited"]), lambda c: c.isNotNull()).alias("citations_used"),
        F.transform("p", lambda s: s["m"]).alias("evidence_map"),
        F.array().cast("array<string>").alias("gaps"),
    ))
    response = (
        F.when(F.pmod(F.length("content"), F.lit(7)) == 0, F.col("content"))
        .when(F.col("path") == "explore", F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\n")))
        .when(F.col("path") == "apply", F.concat(F.lit("Result: "), body, F.lit(" End.")))
        .otherwise(body)
    )
    return text.join(lists, ["run_id", "path"], "left").select("run_id", "path", "iteration", response.alias("response"))


def job_log(spark: SparkSession, sf: str) -> DataFrame:
    """Job event log read off the events: a user is a job, the event type gives status and stage."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(*job_log_columns(kind))


def job_log_columns(kind: Column) -> list[Column]:
    status = F.when(kind == "purchase", "completed").when(kind == "signup", "review_required").when(kind == "error", "failed").otherwise("running")
    return [
        F.concat(F.lit("job_"), F.col("user_id").cast("string")).alias("job_id"), F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"),
        status.alias("status"), F.when(kind != "error", kind).alias("stage"),
    ]


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their lines as paragraphs."""
    return table(spark, sf, "documents").select("doc_id", "lang", "source", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"))
