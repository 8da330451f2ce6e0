"""Discovery end to end: requests, policies and pages in, capped evidence out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import discovery as d
from ..session import staged

Stage = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class DiscoverySettings:
    search_limit: int = d.SEARCH_LIMIT
    per_source: int = d.PER_SOURCE
    per_run: int = d.PER_RUN
    strict_domains: bool = False


class Discovery:
    """The steps of one discovery, built when asked for.

    URL filters work on (run, url) keys; page texts join after the source cap. Results that many
    readers share, the term index, the chosen sources (keys only) and the final evidence, are written as stage tables.
    """

    def __init__(
        self, requests: DataFrame, policies: DataFrame, pages: DataFrame, retrieved_at: Column, source_ceiling: int,
        settings: DiscoverySettings = DiscoverySettings(), stage: Stage = staged,
    ) -> None:
        self.requests, self.policies, self.pages = requests, policies, pages
        self.retrieved_at, self.source_ceiling = retrieved_at, source_ceiling
        self.settings, self.stage = settings, stage

    @cached_property
    def queries(self) -> DataFrame:
        return d.build_queries(self.requests)

    @cached_property
    def found(self) -> DataFrame:
        return d.candidates_by_search(self.queries, self.pages, self.settings.search_limit, self.stage)

    @cached_property
    def candidates(self) -> DataFrame:
        hits = self.found.select("run_id", "query_pos", "result_pos", "url")
        return d.dedup_urls(hits.unionByName(d.seed_urls(self.requests)))

    @cached_property
    def resolved(self) -> DataFrame:
        return d.resolve_policy(self.requests, self.policies)

    @cached_property
    def sources(self) -> DataFrame:
        allowed = d.policy_filter(self.candidates, self.resolved, self.settings.strict_domains)
        return self.stage(d.max_sources(allowed, self.source_ceiling), "sources")

    @cached_property
    def fetched(self) -> DataFrame:
        return d.drop_empty_pages(d.attach_pages(d.crawl_plan(self.sources), self.pages))

    @cached_property
    def excerpts(self) -> DataFrame:
        return d.extract_evidence(self.fetched, self.retrieved_at, F.col("trusted"))

    @cached_property
    def evidence(self) -> DataFrame:
        return self.stage(d.cap_evidence(self.excerpts, self.settings.per_source, self.settings.per_run), "evidence")
