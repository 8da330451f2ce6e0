"""From requests to candidate sources to verbatim excerpts.

Everything a single request treats as "global" (caps, ranks, duplicates) is a window or a grouping on
``run_id`` here, so any number of runs share one job. Rank filters compare ``row_number`` to a literal:
Spark then cuts each map task's groups to the limit before the shuffle, which keeps a run or source
that holds most of the rows from landing whole in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions import text as t
from ..session import counted, staged

SEARCH_LIMIT = 20
#: Up to this number of distinct queries travel to the pages.
IN_ROW = 50_000
CRAWL_TIMEOUT = 30
MIN_EXCERPT = 50
PER_SOURCE = 5
PER_RUN = 100
SEED_POS = 2_147_483_647  # seeds rank behind every search result


# --- queries and candidates -------------------------------------------------------------------

def build_queries(requests: DataFrame) -> DataFrame:
    """One row per search query: the topic, then topic + subtopic, in order."""
    topic = F.col("topic")
    texts = F.concat(F.array(topic), F.transform("subtopics", lambda s: F.concat(topic, F.lit(" "), s)))
    return requests.select("run_id", F.posexplode(texts).alias("query_pos", "query"))


def page_terms(pages: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(url, term, tf) of the pages' titles and texts, only for terms in ``vocabulary``."""
    counted = t.token_counts(F.concat_ws(" ", "title", "markdown"))
    words = pages.select("url", F.explode(counted).alias("x")).select("url", F.col("x.token").alias("term"), F.col("x.n").alias("n"))
    return words.join(vocabulary, "term", "left_semi").groupBy("url", "term").agg(F.sum("n").alias("tf"))


def _hits_in_row(index: DataFrame, entry: DataFrame) -> DataFrame:
    """(query, url, score) of the pages holding every term of a query.

    The terms of a page lie in one row, dealt out by url, and all that follows keeps to that: a query looks its terms up
    in the pages that it opens, and no row for a query and page is shuffled.
    """
    spark = index.sparkSession
    # an even deal: AQE would merge the small rows into a few tasks, and each row meets many queries
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    terms = F.map_from_entries(F.collect_list(F.struct("term", "tf")))
    rows = index.filter("url IS NOT NULL").repartition(tasks, "url").groupBy("url").agg(terms.alias("tfs"))
    opened = rows.select("url", "tfs", F.explode(F.map_keys("tfs")).alias("term")).join(F.broadcast(entry), "term")
    # exploded, not folded by a lambda: that would copy the page's terms for each query
    asked = opened.select("query", "url", "tfs", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    return (
        asked.select("query", "url", "n_terms", F.try_element_at("tfs", F.col("term")).alias("tf"))
        .filter("tf IS NOT NULL")
        .groupBy("query", "url")
        .agg(F.sum("tf").alias("score"), F.count(F.lit(1)).alias("n"), F.any_value("n_terms").alias("n_terms"))
        .filter(F.col("n") == F.col("n_terms"))
        .select("query", "url", "score")
    )


def _hits_by_join(index: DataFrame, entry: DataFrame) -> DataFrame:
    """:func:`_hits_in_row` for any number of queries: the terms are checked on the (url, term) key."""
    opened = index.select("url", "term").join(entry, "term").select("query", "url", "terms")
    return (
        opened.select("query", "url", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
        .join(index, ["url", "term"])
        .groupBy("query", "url")
        .agg(F.sum("tf").alias("score"), F.count(F.lit(1)).alias("n"), F.any_value("n_terms").alias("n_terms"))
        .filter(F.col("n") == F.col("n_terms"))
        .select("query", "url", "score")
    )


def candidates_by_search(
    queries: DataFrame, pages: DataFrame, limit: int = SEARCH_LIMIT, stage: Callable[[DataFrame, str], DataFrame] = lambda df, name: df
) -> DataFrame:
    """Pages holding every term of a query, best total term count first, at most ``limit`` per query.

    Each distinct query enters through its rarest term; only those pages are checked for the other
    terms. Common words therefore never pull in the whole corpus. Up to ``IN_ROW`` queries travel to the pages, where a
    task passes on its best pages of a query alone; more meet the term index on the (url, term) key. ``stage`` may keep
    that index, which three steps read, as a table.
    """
    texts = queries.select("query").distinct()
    asked = texts.select("query", F.array_distinct(t.tokens(F.col("query"))).alias("terms"))
    vocabulary = asked.select(F.explode("terms").alias("term")).distinct()
    index = stage(page_terms(pages, vocabulary), "page-terms")
    spread = index.groupBy("term").agg(F.count(F.lit(1)).alias("n_pages"))
    entry, n = counted(
        asked.select("query", F.explode("terms").alias("term"), "terms")
        .join(spread, "term")
        .groupBy("query")
        .agg(
            F.min_by("term", F.struct("n_pages", "term")).alias("term"),
            F.count(F.lit(1)).alias("n_known"),
            F.any_value("terms").alias("terms"),
        )
        .filter(F.col("n_known") == F.size("terms"))
        .drop("n_known"),
        "search-entries",
    )
    hits = _hits_in_row(index, entry) if n <= IN_ROW else _hits_by_join(index, entry)
    best = W.partitionBy("query").orderBy(F.col("score").desc(), "url")
    top = hits.withColumn("result_pos", F.row_number().over(best)).filter(F.col("result_pos") <= limit)
    return queries.join(top.select("query", "url", "score", "result_pos"), "query").select(
        "run_id", "query_pos", "query", "url", "score", "result_pos"
    )


def seed_urls(requests: DataFrame) -> DataFrame:
    """https://<domain> for every allowed domain of the request's constraints."""
    return requests.select(
        "run_id", F.posexplode("constraints.domains_allow").alias("pos", "domain")
    ).select(
        "run_id",
        F.lit(SEED_POS).alias("query_pos"),
        F.col("pos").alias("result_pos"),
        F.concat(F.lit("https://"), "domain").alias("url"),
    )


def dedup_urls(candidates: DataFrame) -> DataFrame:
    """First occurrence of each URL per run."""
    return (
        candidates.groupBy("run_id", "url")
        .agg(F.min(F.struct("query_pos", "result_pos")).alias("p"))
        .select("run_id", "url", "p.query_pos", "p.result_pos")
    )


# --- policy -----------------------------------------------------------------------------------

def resolve_policy(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Effective policy per run.

    The first override whose pattern is found in the topic (any case) adds its domains to the lists and
    replaces the reputation and recency rules it gives. Overrides sit in the policy row, so there is
    one equi join and nothing to multiply.
    """
    topic = F.col("topic")
    first = F.get(
        F.filter("topic_overrides", lambda o: F.rlike(topic, F.concat(F.lit("(?i)"), o["topic_pattern"]))), F.lit(0)
    )
    none = F.array().cast("array<string>")
    joined = requests.join(policies, "policy_id").withColumn("hit", first)
    hit = F.col("hit")
    return joined.select(
        "run_id",
        "policy_id",
        "name",
        hit["topic_pattern"].alias("override"),
        F.concat("domains_allow", F.coalesce(hit["domains_allow"], none)).alias("domains_allow"),
        F.concat("domains_deny", F.coalesce(hit["domains_deny"], none)).alias("domains_deny"),
        F.coalesce(hit["reputation"], F.col("reputation")).alias("reputation"),
        F.coalesce(hit["recency"], F.col("recency")).alias("recency"),
        "max_sources_per_run",
    )


def unknown_policy(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Failure rows (run_id, message) of runs whose policy is not there."""
    lost = requests.join(policies.select("policy_id"), "policy_id", "left_anti")
    return lost.select("run_id", F.concat(F.lit("Unknown policy: "), F.coalesce("policy_id", F.lit(""))).alias("message"))


def passes_policy(domain: Column, allow: Column, deny: Column, strict: bool = False) -> Column:
    """Deny beats allow; an empty allow list admits all. Entries match anywhere in the domain, or
    with ``strict`` only as a whole-label suffix."""

    def hit(entry: Column) -> Column:
        e = F.lower(entry)
        if not strict:
            return F.contains(domain, e)
        bare = F.ltrim(e, F.lit("."))
        return (domain == bare) | F.endswith(domain, F.concat(F.lit("."), bare))

    return (
        (domain != "")
        & ~t.any_of(deny, hit)
        & ((F.size(F.coalesce(allow, F.array().cast("array<string>"))) == 0) | t.any_of(allow, hit))
    )


def policy_filter(candidates: DataFrame, resolved: DataFrame, strict: bool = False) -> DataFrame:
    """Candidates whose domain the run's effective policy admits, with the run's trusted domains.

    The join meets on ``run_id``; spreading its output by (run, url) lets AQE split a hot run in the join
    and lets later ranks per run prune before they gather.
    """
    rules = resolved.select(
        "run_id", "domains_allow", "domains_deny", "max_sources_per_run",
        F.col("reputation.trusted_institutions").alias("trusted"),
    )
    return (
        candidates.join(rules, "run_id")
        .filter(passes_policy(t.netloc(F.col("url")), F.col("domains_allow"), F.col("domains_deny"), strict))
        .drop("domains_allow", "domains_deny")
        .repartition("run_id", "url")
    )


def max_sources(candidates: DataFrame, ceiling: int) -> DataFrame:
    """The first ``max_sources_per_run`` URLs of a run in candidate order, numbered by ``pos``.

    ``ceiling`` is the largest limit any policy sets; as a literal it lets Spark prune before the shuffle.
    """
    order = W.partitionBy("run_id").orderBy("query_pos", "result_pos")
    return (
        candidates.withColumn("pos", F.row_number().over(order))
        .filter((F.col("pos") <= ceiling) & (F.col("pos") <= F.col("max_sources_per_run")))
        .drop("query_pos", "result_pos", "max_sources_per_run")
    )


def largest_source_limit(policies: DataFrame) -> int:
    """One number off the policy table, for :func:`max_sources`."""
    return int(policies.agg(F.max("max_sources_per_run")).first()[0] or 0)


# --- pages ------------------------------------------------------------------------------------

def crawl_plan(sources: DataFrame, timeout_seconds: int = CRAWL_TIMEOUT) -> DataFrame:
    return sources.withColumn("timeout_seconds", F.lit(timeout_seconds))


def _fetch_rank(pages: DataFrame) -> Column:
    """Orders the fetches of a URL by short values: a successful one first, the newest by ``fetched_at`` where the pages
    have it, the longest text, then a checksum of all its texts."""
    newest = [F.col("fetched_at").alias("at")] if "fetched_at" in pages.columns else []
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("markdown", "title", "author", "published_date") if c in pages.columns]
    ok = F.coalesce(F.col("status_code") != 0, F.lit(False))
    return F.struct(ok.alias("ok"), *newest, F.length("markdown").alias("n"), F.md5(F.concat_ws("\u0001", *texts)).alias("sum"), F.col("status_code").alias("status"))


def one_fetch(pages: DataFrame) -> DataFrame:
    """One row per URL: the best by :func:`_fetch_rank`. Only URLs and ranks are compared; texts move for the best alone."""
    ranked = pages.withColumn("_rank", _fetch_rank(pages))
    best = staged(ranked.groupBy(F.col("url").alias("_url")).agg(F.max("_rank").alias("_best")), "best-fetches")
    same = (F.col("url") == F.col("_url")) & F.col("_rank").eqNullSafe(F.col("_best"))
    return ranked.join(best, same).drop("_url", "_rank", "_best").dropDuplicates(["url"])


def attach_pages(plan: DataFrame, pages: DataFrame) -> DataFrame:
    """Crawl plan with the fetched page, one per URL; a URL that was not fetched has status 0.

    The plan's URLs are a written table, so Spark knows their size: while they fit its broadcast limit, pages are
    filtered where they are scanned and only those asked for are shuffled.
    """
    wanted = staged(plan.select(F.col("url").alias("_wanted")).distinct(), "plan-urls")
    mine = pages.select(*[c for c in pages.columns if c not in ("raw_html", "metadata")]).join(wanted, F.col("url") == F.col("_wanted"), "left_semi")
    found = one_fetch(mine)
    carried = [c for c in plan.columns if c not in ("pos", "timeout_seconds")]
    return plan.join(found, "url", "left").select(
        *carried,
        F.col("pos").alias("page_pos"),
        F.coalesce("status_code", F.lit(0)).alias("status_code"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "author", "published_date", "markdown")],
    )


def drop_empty_pages(pages: DataFrame) -> DataFrame:
    """Drop failed fetches (status 0, other codes stay) and blank texts."""
    return pages.filter((F.col("status_code") != 0) & ~t.is_blank(F.col("markdown")))


def explode_chunks(pages: DataFrame, min_chars: int = MIN_EXCERPT) -> DataFrame:
    """One row per excerpt. Locators count every piece, so dropping short ones leaves gaps."""
    keep = [c for c in pages.columns if c not in ("markdown", "raw_html")]
    return (
        pages.select(*keep, F.posexplode(t.chunk(F.col("markdown"))).alias("chunk_pos", "excerpt"))
        .filter(F.length("excerpt") >= min_chars)
        .withColumn("locator", F.concat(F.lit("chunk:"), F.col("chunk_pos").cast("string")))
        .withColumn("excerpt_hash", t.sha256_hex(F.col("excerpt")))
    )


def mint_id(run_id: Column, url: Column, locator: Column, excerpt_hash: Column) -> Column:
    """Deterministic evidence id: the same excerpt of the same run always gets the same one."""
    return F.concat(F.lit("ev_"), F.sha2(F.concat_ws("\u0001", run_id, url, locator, excerpt_hash), 256))


def extract_evidence(pages: DataFrame, retrieved_at: Column, trusted: Column | None = None) -> DataFrame:
    """Non-empty pages (run_id, url, page_pos, page fields) -> evidence rows before caps."""
    trusted = F.array().cast("array<string>") if trusted is None else trusted
    rated = pages.withColumn(
        "source_quality", q.source_quality(F.col("url"), F.col("markdown"), F.col("title"), trusted)
    )
    cut = explode_chunks(rated.select(
        "run_id", "url", "page_pos", "title", "author", "published_date", "markdown", "source_quality"
    ))
    return cut.select(
        "run_id",
        "page_pos",
        "chunk_pos",
        mint_id(F.col("run_id"), F.col("url"), F.col("locator"), F.col("excerpt_hash")).alias("id"),
        "url",
        F.nullif("title", F.lit("")).alias("title"),
        F.nullif("author", F.lit("")).alias("author"),
        t.parse_iso(F.col("published_date")).alias("published_at"),
        retrieved_at.alias("retrieved_at"),
        "excerpt",
        "excerpt_hash",
        "locator",
        "source_quality",
    )


# --- duplicates and caps ----------------------------------------------------------------------

def dedup_run(excerpts: DataFrame) -> DataFrame:
    """First excerpt per hash in (page, chunk) order within a run."""
    first = W.partitionBy("run_id", "excerpt_hash").orderBy("page_pos", "chunk_pos")
    return excerpts.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1).drop("_n")


def cap_per_source(excerpts: DataFrame, per_source: int = PER_SOURCE) -> DataFrame:
    """Longest ``per_source`` excerpts of each URL; ties keep document order."""
    longest = W.partitionBy("run_id", "url").orderBy(F.col("n_chars").desc(), "page_pos", "chunk_pos")
    return excerpts.withColumn("source_rank", F.row_number().over(longest)).filter(F.col("source_rank") <= per_source)


def cap_total(excerpts: DataFrame, per_run: int = PER_RUN) -> DataFrame:
    """Longest ``per_run`` excerpts of a run; ties by page, then rank within the page."""
    longest = W.partitionBy("run_id").orderBy(F.col("n_chars").desc(), "page_pos", "source_rank")
    return excerpts.withColumn("run_rank", F.row_number().over(longest)).filter(F.col("run_rank") <= per_run)


def cap_evidence(excerpts: DataFrame, per_source: int = PER_SOURCE, per_run: int = PER_RUN) -> DataFrame:
    """Apply both caps and number the survivors (``ev_pos``) in the order a run hands them on.

    Untouched runs keep document order, runs cut per source go by page and length, runs cut in total by
    length. Only keys and lengths pass through the windows; the texts are joined back at the end.
    """
    narrow = excerpts.select("run_id", "url", "page_pos", "chunk_pos", "excerpt_hash", F.length("excerpt").alias("n_chars"))
    unique = dedup_run(narrow)
    per_url = unique.groupBy("run_id", "url").agg(F.count(F.lit(1)).alias("n"))
    sizes = per_url.groupBy("run_id").agg(
        F.sum("n").alias("n_all"),
        F.max("n").alias("n_widest"),
        F.sum(F.least("n", F.lit(per_source))).alias("n_capped"),
    )
    kept = cap_total(cap_per_source(unique, per_source), per_run).join(sizes, "run_id")
    untouched = (F.col("n_all") <= per_run) & (F.col("n_widest") <= per_source)
    shape = F.when(untouched, F.struct(F.col("page_pos").alias("a"), F.col("chunk_pos").alias("b"))).when(
        F.col("n_capped") <= per_run, F.struct(F.col("page_pos").alias("a"), F.col("source_rank").alias("b"))
    ).otherwise(F.struct(F.col("run_rank").alias("a"), F.lit(0).alias("b")))
    key = ["run_id", "url", "page_pos", "chunk_pos", "excerpt_hash"]
    keys = kept.withColumn("ev_pos", F.row_number().over(W.partitionBy("run_id").orderBy(shape))).select(*key, "ev_pos")
    # rows that agree in all of the key are one excerpt
    return excerpts.join(keys, key).dropDuplicates(["run_id", "ev_pos"])


def discovery_stats(
    queries: DataFrame, candidates: DataFrame, sources: DataFrame, pages: DataFrame, excerpts: DataFrame, evidence: DataFrame
) -> DataFrame:
    """Row counts per run at each step of discovery."""

    def tally(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).select("run_id", F.lit(name).alias("step"), "n")

    parts = [
        tally(queries, "queries"),
        tally(candidates, "candidates"),
        tally(sources, "sources"),
        tally(pages, "pages"),
        tally(dedup_run(excerpts.select("run_id", "excerpt_hash", "page_pos", "chunk_pos")), "before_cap"),
        tally(evidence.select("run_id"), "after_cap"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    names = ["queries", "candidates", "sources", "pages", "before_cap", "after_cap"]
    wide = rows.groupBy("run_id").pivot("step", names).agg(F.sum("n"))
    return wide.select("run_id", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names]).withColumn(
        "dropped", F.col("before_cap") - F.col("after_cap")
    )
