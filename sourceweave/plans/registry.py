"""Named queries over the sample tables, with their check SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import discovery as d
from ..operators import drafts as dr
from ..operators import package as pk
from ..operators import vector_index
from ..operators import verify as v
from ..session import scratch_path, staged
from ..sources import config_tables as cfg
from ..sources import store
from . import evidence_run, rewrite
from . import fixtures as fx
from .oracle import check_sql

Query = Callable[["Inputs"], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = check_sql(sql)
        return fn

    return register


class Inputs:
    """Lazy entity tables of one session and data folder, shared by the queries."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.spark, self.sf = spark, sf

    def table(self, name: str) -> DataFrame:
        return fx.table(self.spark, self.sf, name)

    @cached_property
    def requests(self) -> DataFrame:
        return staged(fx.requests(self.spark, self.sf), "requests")

    @cached_property
    def policies(self) -> DataFrame:
        return fx.policies(self.spark)

    @cached_property
    def pages(self) -> DataFrame:
        """Cleaned once: search, attachment and chunking all read the text, none the markup."""
        return staged(fx.pages(self.spark, self.sf).drop("raw_html"), "pages")

    @cached_property
    def found(self) -> evidence_run.Discovery:
        ceiling = max(p.get("max_sources_per_run", 50) for p in fx.POLICIES)
        return evidence_run.Discovery(self.requests, self.policies, self.pages, fx.retrieved_at(), ceiling)

    @property
    def evidence(self) -> DataFrame:
        return self.found.evidence

    @cached_property
    def document_pages(self) -> DataFrame:
        return fx.document_pages(self.spark, self.sf)

    @cached_property
    def document_excerpts(self) -> DataFrame:
        """Extracted once: the store, its look-ups and searches all read it."""
        at = F.timestamp_seconds(F.unix_seconds(fx.retrieved_at()) + F.col("page_pos") * 60)
        return staged(d.extract_evidence(d.drop_empty_pages(self.document_pages), at), "document-excerpts")

    @cached_property
    def store(self) -> str:
        """A written store of the labelled documents' excerpts: they play the part of what was stored before."""
        path = scratch_path(self.spark, "evidence-store")
        labelled = self.table("labels").select(F.col("doc_id").alias("page_pos"))
        store.write_evidence(self.document_excerpts.join(labelled, "page_pos", "left_semi"), path, ["page_pos", "chunk_pos"])
        return path

    @cached_property
    def vectors(self) -> vector_index.VectorIndex:
        """Index of the embeddings by language of their document, eight lists at least."""
        e = self.table("embeddings")
        langs = self.table("documents").select(F.col("doc_id").alias("vec_id"), "lang")
        rows = e.join(langs, "vec_id", "left").select(F.col("vec_id").alias("id"), "embedding", "lang")
        return vector_index.build(rows, scratch_path(self.spark, "vector-index"), 64, ("lang",), lists=max(8, e.count() // vector_index.LIST_ROWS))

    @cached_property
    def document_evidence(self) -> DataFrame:
        return staged(d.cap_evidence(self.document_excerpts), "document-evidence")

    @cached_property
    def paths(self) -> DataFrame:
        return fx.path_config(self.spark)

    @cached_property
    def picks(self) -> DataFrame:
        return staged(dr.extractive_picks(self.requests, self.evidence, self.paths), "picks")

    @cached_property
    def responses(self) -> DataFrame:
        return staged(fx.model_responses(self.requests, self.evidence, self.picks, 1), "responses")

    @cached_property
    def drafts(self) -> DataFrame:
        return dr.parse_drafts(self.responses)

    @cached_property
    def draft_claims(self) -> DataFrame:
        return staged(v.rule_verify(staged(v.split_claims(self.drafts), "claims"), self.evidence, facts=self.facts), "draft-claims")

    @cached_property
    def facts(self) -> DataFrame:
        """Words, figures and contexts of the evidence, which every round asks for."""
        return staged(v.evidence_facts(self.evidence), "evidence-facts")

    def judge(self, units: DataFrame) -> DataFrame:
        """Reports of all units by the rule-based judge."""
        found = v.rule_verify(staged(v.split_claims(units), "claims"), self.evidence, facts=self.facts)
        return v.with_scores(v.empty_report(units, v.tally_claims(found)))

    @cached_property
    def rounds(self) -> rewrite.Rounds:
        """Write-verify-gate rounds with the careless sample writer."""

        def write(open_rows: DataFrame, iteration: int) -> DataFrame:
            answers = fx.model_responses(self.requests, self.evidence, self.picks, iteration)
            return dr.parse_drafts(answers.join(open_rows.select("run_id", "path"), ["run_id", "path"], "left_semi"))

        config = cfg.default_gate_profiles(self.spark)
        return rewrite.rewrite_rounds(self.requests, self.evidence, config, write, self.judge)

    @cached_property
    def citations(self) -> DataFrame:
        """Resolved citations of the sample drafts."""
        return staged(dr.resolve_citations(self.drafts, self.evidence), "citations")

    @cached_property
    def jobs(self) -> DataFrame:
        """One job per request, failed when nothing was found, else by its gate results."""
        status = pk.job_status(self.requests, self.rounds.gate_results, pk.failures(self.requests, self.evidence, d.unknown_policy(self.requests, self.policies)))
        rows = status.select(
            "run_id", F.concat(F.lit("job_"), F.substring("run_id", 5, 20)).alias("job_id"), "status", F.col("error").isNull().alias("has_package"), "error"
        )
        return staged(rows, "jobs")

    @cached_property
    def claims(self) -> DataFrame:
        return fx.claims(self.spark, self.sf)

    @cached_property
    def claim_reports(self) -> DataFrame:
        """Scored recount of the event claims, with each unit's risk profile."""
        keys = [*dr.UNIT_KEYS, "risk_profile"]
        return v.with_scores(v.tally_claims(self.claims, keys))


@lru_cache(maxsize=8)
def _inputs(app_id: str, sf: str, spark: SparkSession) -> Inputs:
    return Inputs(spark, sf)


def run(name: str, spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES[name](_inputs(spark.sparkContext.applicationId, sf, spark))
