"""Queries over sources, discovery and source quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import quality as q
from ..functions import text as t
from ..operators import discovery as d
from ..operators import quality as ql
from ..sources import config_tables as cfg
from ..sources import crawl
from . import fixtures as fx
from . import oracle as o
from .registry import query

T = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def joined(c):
    return F.concat_ws(",", c)


# --- sources ----------------------------------------------------------------------------------

@query("read_crawl", "SELECT url, status_code, title, author, published_date, sha256(markdown) AS text_hash FROM c_docs")
def _(x):
    return x.document_pages.select(
        "url", "status_code", "title", "author", "published_date", t.sha256_hex(F.col("markdown")).alias("text_hash")
    )


@query("html_to_text", "SELECT url, title, markdown FROM c_page_texts")
def _(x):
    return fx.page_texts(x.spark, x.sf).select("url", "title", "markdown")


@query("read_policies", """SELECT policy_id, coalesce(name, policy_id) AS name, coalesce(allow, '') AS allow_list, peer, marketing, recent, max_age,
    coalesce(max_sources, 50) AS max_sources FROM (
      SELECT source AS policy_id, CASE WHEN lang <> 'en' THEN lang END AS name, CASE WHEN lang <> 'fr' THEN lang END AS allow,
        lang = 'de' AS peer, lang <> 'de' AS marketing, true AS recent, CASE WHEN lang = 'es' THEN n_chars::INTEGER END AS max_age,
        CASE WHEN lang <> 'es' THEN n_chars::INTEGER END AS max_sources
      FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1)""")
def _(x):
    lang = F.col("lang")
    entries = x.table("documents").select(
        F.col("doc_id").alias("ord"),
        F.col("source").alias("id"),
        F.when(lang != "en", lang).alias("name"),
        F.when(lang != "fr", F.array(lang)).alias("domains_allow"),
        F.lit(None).cast("array<string>").alias("domains_deny"),
        F.when(lang == "de", F.struct(
            F.lit(True).alias("require_peer_reviewed"), F.lit(None).cast("boolean").alias("require_primary_source"),
            F.lit(None).cast("array<string>").alias("trusted_institutions"), F.lit(False).alias("block_marketing"),
        )).alias("reputation"),
        F.when(lang == "es", F.struct(F.col("n_chars").cast("int").alias("max_age_days"), F.lit(None).cast("boolean").alias("prefer_recent"))).alias("recency"),
        F.when(lang != "es", F.col("n_chars").cast("int")).alias("max_sources_per_run"),
        F.lit(None).cast(f"array<{schemas.OVERRIDE}>").alias("topic_overrides"),
    )
    return cfg.read_policies(entries).select(
        "policy_id", "name", joined("domains_allow").alias("allow_list"),
        F.col("reputation.require_peer_reviewed").alias("peer"), F.col("reputation.block_marketing").alias("marketing"),
        F.col("recency.prefer_recent").alias("recent"), F.col("recency.max_age_days").alias("max_age"),
        F.col("max_sources_per_run").alias("max_sources"),
    )


@query("read_gate_config", """SELECT coalesce(m.risk_profile, g.risk_profile) AS risk_profile,
    CASE WHEN m.risk_profile IS NOT NULL THEN m.threshold ELSE g.autopublish_threshold END AS autopublish_threshold,
    CASE WHEN m.risk_profile IS NOT NULL THEN 1 ELSE g.min_citations END AS min_citations,
    CASE WHEN m.risk_profile IS NOT NULL THEN 0.9 ELSE g.min_ratio END::DOUBLE AS min_ratio,
    CASE WHEN m.risk_profile IS NOT NULL THEN 3 ELSE g.max_iterations END AS max_iterations
  FROM (SELECT lower(split_part(o_orderpriority, '-', 2)) AS risk_profile,
      round(count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE, 6) AS threshold FROM orders GROUP BY 1 HAVING risk_profile <> 'low') m
  FULL JOIN c_gate g ON g.risk_profile = m.risk_profile""")
def _(x):
    custom = (
        x.table("orders").groupBy(F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("risk_profile"))
        .agg(F.round(F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1)), 6).alias("autopublish_threshold"))
        .filter("risk_profile <> 'low'")
        .select(
            "risk_profile", "autopublish_threshold", F.lit(None).cast("int").alias("min_citations_per_paragraph"),
            F.lit(None).cast("double").alias("min_citation_density_ratio"), F.lit(None).cast("int").alias("max_writer_iterations"),
        )
    )
    return cfg.read_gate_config(custom).select(
        "risk_profile", "autopublish_threshold", F.col("min_citations_per_paragraph").alias("min_citations"),
        F.col("min_citation_density_ratio").alias("min_ratio"), F.col("max_writer_iterations").alias("max_iterations"),
    )


@query("read_requests", """SELECT run_id, topic, array_to_string(subtopics, ',') AS subtopics, array_to_string(paths, ',') AS paths, audience,
    policy_id, risk_profile, coalesce(array_to_string(seeds, ','), '') AS domains_allow FROM c_requests""")
def _(x):
    return x.requests.select(
        "run_id", "topic", joined("subtopics").alias("subtopics"), joined("paths").alias("paths"), "audience", "policy_id",
        "risk_profile", joined("constraints.domains_allow").alias("domains_allow"),
    )


# --- candidates -------------------------------------------------------------------------------

@query("build_queries", "SELECT run_id, query_pos, query FROM c_queries")
def _(x):
    return x.found.queries


@query("candidates_by_search", "SELECT run_id, query_pos, query, url, score::BIGINT AS score, result_pos FROM c_search")
def _(x):
    return d.candidates_by_search(x.found.queries, x.pages)


@query("seed_urls", """SELECT run_id, 2147483647 AS query_pos, i AS result_pos, 'https://' || d AS url FROM (
    SELECT run_id, generate_subscripts(seeds, 1) - 1 AS i, unnest(seeds) AS d FROM c_requests)""")
def _(x):
    return d.seed_urls(x.requests)


@query("dedup_urls", "SELECT run_id, url, p[1] AS query_pos, p[2] AS result_pos FROM c_candidates")
def _(x):
    return x.found.candidates


@query("resolve_policy", """SELECT run_id, policy_id, name, override, array_to_string(allow, ',') AS allow_list, array_to_string(deny, ',') AS deny_list,
    reputation.require_primary_source AS needs_primary, array_to_string(reputation.trusted_institutions, ',') AS trusted,
    recency.max_age_days AS max_age, max_sources FROM c_resolved""")
def _(x):
    return x.found.resolved.select(
        "run_id", "policy_id", "name", "override", joined("domains_allow").alias("allow_list"), joined("domains_deny").alias("deny_list"),
        F.col("reputation.require_primary_source").alias("needs_primary"), joined("reputation.trusted_institutions").alias("trusted"),
        F.col("recency.max_age_days").alias("max_age"), F.col("max_sources_per_run").alias("max_sources"),
    )


@query("url_domain", f"SELECT url, {o.netloc('url')} AS domain FROM pages")
def _(x):
    return x.table("pages").select("url", t.netloc(F.col("url")).alias("domain"))


@query("policy_filter", "SELECT run_id, url, p[1] AS query_pos, p[2] AS result_pos, array_to_string(trusted, ',') AS trusted FROM (SELECT a.*, r.reputation.trusted_institutions AS trusted FROM c_allowed a JOIN c_resolved r USING (run_id))")
def _(x):
    return d.policy_filter(x.found.candidates, x.found.resolved).select(
        "run_id", "url", "query_pos", "result_pos", joined("trusted").alias("trusted")
    )


@query("policy_filter_strict", f"""SELECT run_id, url FROM (SELECT *, {o.netloc('url')} AS domain FROM c_candidates) JOIN c_resolved USING (run_id)
    WHERE domain <> '' AND len(list_filter(deny, lambda x: domain = ltrim(lower(x), '.') OR suffix(domain, '.' || ltrim(lower(x), '.')))) = 0
      AND (len(allow) = 0 OR len(list_filter(allow, lambda x: domain = ltrim(lower(x), '.') OR suffix(domain, '.' || ltrim(lower(x), '.')))) > 0)""")
def _(x):
    return d.policy_filter(x.found.candidates, x.found.resolved, strict=True).select("run_id", "url")


@query("max_sources", "SELECT run_id, url, pos FROM c_sources")
def _(x):
    return x.found.sources.select("run_id", "url", "pos")


@query("crawl_plan", "SELECT run_id, url, pos, 30 AS timeout_seconds FROM c_sources")
def _(x):
    return d.crawl_plan(x.found.sources).select("run_id", "url", "pos", "timeout_seconds")


@query("attach_pages", """SELECT s.run_id, s.url, s.pos AS page_pos, CASE WHEN p.url IS NULL THEN 0 ELSE 200 END AS status_code,
    coalesce(p.title, '') AS title, sha256(coalesce(p.markdown, '')) AS text_hash FROM c_sources s LEFT JOIN c_pages p USING (url)""")
def _(x):
    return d.attach_pages(d.crawl_plan(x.found.sources), x.pages).select(
        "run_id", "url", "page_pos", "status_code", "title", t.sha256_hex(F.col("markdown")).alias("text_hash")
    )


@query("drop_empty_pages", f"SELECT url, status_code FROM c_docs WHERE status_code <> 0 AND {o.strip('markdown')} <> ''")
def _(x):
    return d.drop_empty_pages(x.document_pages).select("url", "status_code")


# --- excerpts ---------------------------------------------------------------------------------

@query("chunk", f"""SELECT doc_id, chunk_pos, length(piece) AS n_chars, sha256(piece) AS piece_hash FROM (
    SELECT doc_id, unnest(cs) AS piece, generate_subscripts(cs, 1) - 1 AS chunk_pos FROM (SELECT doc_id, {o.chunk('text')} AS cs FROM documents))""")
def _(x):
    return x.table("documents").select("doc_id", F.posexplode(t.chunk(F.col("text"))).alias("chunk_pos", "piece")).select(
        "doc_id", "chunk_pos", F.length("piece").cast("bigint").alias("n_chars"), t.sha256_hex(F.col("piece")).alias("piece_hash")
    )


@query("explode_chunks", f"SELECT url, locator, excerpt, excerpt_hash FROM ({o.excerpt_rows('c_pages', 'url')})")
def _(x):
    return d.explode_chunks(x.pages.select("url", "markdown")).select("url", "locator", "excerpt", "excerpt_hash")


@query("hash_excerpt", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def _(x):
    return x.table("documents").select("doc_id", t.sha256_hex(F.col("text")).alias("text_hash"))


@query("parse_published", f"SELECT url, {T.format(o.parse_iso('published_date'))} AS published FROM c_docs")
def _(x):
    return x.document_pages.select("url", stamp(t.parse_iso(F.col("published_date"))).alias("published"))


@query("coerce_meta", "SELECT p_partkey, nullif(array_to_string(string_split(p_type, ' '), ', '), '') AS author FROM part")
def _(x):
    return x.table("part").select("p_partkey", crawl.coerce_meta(F.split("p_type", " ")).alias("author"))


@query("mint_id", "SELECT run_id, url, locator, id FROM c_excerpts")
def _(x):
    return x.found.excerpts.select("run_id", "url", "locator", "id")


@query("dedup_run", """SELECT run_id, url, locator, excerpt_hash FROM c_excerpts
    QUALIFY row_number() OVER (PARTITION BY run_id, excerpt_hash ORDER BY page_pos, chunk_pos) = 1""")
def _(x):
    keys = x.found.excerpts.select("run_id", "url", "locator", "excerpt_hash", "page_pos", "chunk_pos")
    return d.dedup_run(keys).drop("page_pos", "chunk_pos")


_DOC_KEYS = "SELECT run_id, url, locator, length(excerpt) AS n_chars, page_pos, chunk_pos FROM c_doc_excerpts"


def _doc_keys(x):
    return x.document_excerpts.select("run_id", "url", "locator", F.length("excerpt").cast("bigint").alias("n_chars"), "page_pos", "chunk_pos")


@query("cap_per_source", f"""SELECT run_id, url, locator, n_chars, row_number() OVER (PARTITION BY run_id, url ORDER BY n_chars DESC, page_pos, chunk_pos) AS source_rank
    FROM ({_DOC_KEYS}) QUALIFY source_rank <= 5""")
def _(x):
    return d.cap_per_source(_doc_keys(x)).drop("page_pos", "chunk_pos")


@query("cap_total", f"""SELECT run_id, url, locator, n_chars, row_number() OVER (PARTITION BY run_id ORDER BY n_chars DESC, page_pos, source_rank) AS run_rank
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id, url ORDER BY n_chars DESC, page_pos, chunk_pos) AS source_rank
      FROM ({_DOC_KEYS}) QUALIFY source_rank <= 5) QUALIFY run_rank <= 100""")
def _(x):
    return d.cap_total(d.cap_per_source(_doc_keys(x))).select("run_id", "url", "locator", "n_chars", "run_rank")


@query("cap_evidence", "SELECT run_id, id, url, locator, ev_pos FROM c_doc_evidence")
def _(x):
    return x.document_evidence.select("run_id", "id", "url", "locator", "ev_pos")


@query("discover_evidence", "SELECT run_id, ev_pos, id, url, title, excerpt, excerpt_hash, locator, reputation, primary_source, marketing FROM c_evidence")
def _(x):
    s = "source_quality."
    return x.evidence.select(
        "run_id", "ev_pos", "id", "url", "title", "excerpt", "excerpt_hash", "locator", F.col(s + "domain_reputation").alias("reputation"),
        F.col(s + "is_primary_source").alias("primary_source"), F.col(s + "conflict_of_interest").alias("marketing"),
    )


@query("discovery_stats", """SELECT * FROM (
    WITH n AS (SELECT run_id, 'queries' AS step FROM c_queries UNION ALL SELECT run_id, 'candidates' FROM c_candidates
      UNION ALL SELECT run_id, 'sources' FROM c_sources UNION ALL SELECT run_id, 'pages' FROM c_fetched
      UNION ALL SELECT DISTINCT ON (run_id, excerpt_hash) run_id, 'before_cap' FROM c_excerpts UNION ALL SELECT run_id, 'after_cap' FROM c_evidence)
    SELECT run_id, count(*) FILTER (step = 'queries') AS queries, count(*) FILTER (step = 'candidates') AS candidates,
      count(*) FILTER (step = 'sources') AS sources, count(*) FILTER (step = 'pages') AS pages, count(*) FILTER (step = 'before_cap') AS before_cap,
      count(*) FILTER (step = 'after_cap') AS after_cap, before_cap - after_cap AS dropped FROM n GROUP BY run_id)""")
def _(x):
    f = x.found
    return d.discovery_stats(f.queries, f.candidates, f.sources, f.fetched, f.excerpts, f.evidence)


@query("evidence_by_source", f"""SELECT host, reputation, count(*) AS n_excerpts, count(DISTINCT url) AS n_pages, sum(length(excerpt))::BIGINT AS n_chars FROM (
    SELECT *, {o.netloc('url')} AS host FROM (
      SELECT url, excerpt, {o.tier('url', "['.org']")} AS reputation, row_number() OVER (PARTITION BY url ORDER BY length(excerpt) DESC, chunk_pos) AS r FROM (
        SELECT * FROM ({o.excerpt_rows('c_pages', 'url')}) QUALIFY row_number() OVER (PARTITION BY excerpt_hash ORDER BY url, chunk_pos) = 1)))
    WHERE r <= 5 AND NOT contains(host, 'spam-farm') GROUP BY ALL""")
def evidence_by_source(x):
    """Flagship: one run over the whole page corpus, from HTML to capped evidence per host and reputation tier."""
    url = F.col("url")
    pages = fx.pages(x.spark, x.sf).select(F.lit("corpus").alias("run_id"), "url", url.alias("page_pos"), "markdown")
    narrow = d.explode_chunks(pages).select(
        "run_id", "url", "page_pos", "chunk_pos", "excerpt_hash", F.length("excerpt").alias("n_chars")
    )
    # denied hosts still take part in finding the first copy of an excerpt
    kept = d.cap_per_source(d.dedup_run(narrow)).filter(
        d.passes_policy(t.netloc(url), F.array().cast("array<string>"), F.array(F.lit("spam-farm")))
    )
    tier = q.reputation_tier(url, F.array(F.lit(".org")))
    return kept.groupBy(t.netloc(url).alias("host"), tier.alias("reputation")).agg(
        F.count(F.lit(1)).alias("n_excerpts"), F.count_distinct("url").alias("n_pages"), F.sum("n_chars").alias("n_chars")
    )


# --- source quality ---------------------------------------------------------------------------

@query("is_peer_reviewed", f"SELECT url, {o.contains_any('lower(url)', q.PEER_REVIEW_MARKS)} AS flag FROM c_docs UNION ALL SELECT url, {o.contains_any('lower(url)', q.PEER_REVIEW_MARKS)} FROM pages")
def _(x):
    urls = x.document_pages.select("url").unionByName(x.table("pages").select("url"))
    return urls.select("url", q.is_peer_reviewed(F.col("url")).alias("flag"))


@query("is_primary", f"SELECT url, {o.ends_any(o.netloc('url'), q.PRIMARY_SUFFIXES)} AS flag FROM c_docs UNION ALL SELECT url, {o.ends_any(o.netloc('url'), q.PRIMARY_SUFFIXES)} FROM pages")
def _(x):
    urls = x.document_pages.select("url").unionByName(x.table("pages").select("url"))
    return urls.select("url", q.is_primary(F.col("url")).alias("flag"))


@query("reputation_tier", f"SELECT url, {o.tier('url', chr(91) + chr(39) + 'SRC1.' + chr(39) + ', ' + chr(39) + 'blog.' + chr(39) + ']')} AS tier FROM (SELECT url FROM c_docs UNION ALL SELECT url FROM pages)")
def _(x):
    urls = x.document_pages.select("url").unionByName(x.table("pages").select("url"))
    return urls.select("url", q.reputation_tier(F.col("url"), F.array(F.lit("SRC1."), F.lit("blog."))).alias("tier"))


@query("is_marketing", f"SELECT url, {o.marketing('markdown', 'title')} AS flag FROM c_docs")
def _(x):
    return x.document_pages.select("url", q.is_marketing(F.col("markdown"), F.col("title")).alias("flag"))


@query("source_quality", f"""SELECT url, {o.contains_any('lower(url)', q.PEER_REVIEW_MARKS)} AS peer, {o.ends_any(o.netloc('url'), q.PRIMARY_SUFFIXES)} AS primary_source,
    {o.tier('url', "['the']")} AS tier, {o.marketing('markdown', 'title')} AS marketing FROM c_pages""")
def _(x):
    s = q.source_quality(F.col("url"), F.col("markdown"), F.col("title"), F.array(F.lit("the")))
    return x.pages.select("url", s.alias("s")).select(
        "url", F.col("s.is_peer_reviewed").alias("peer"), F.col("s.is_primary_source").alias("primary_source"),
        F.col("s.domain_reputation").alias("tier"), F.col("s.conflict_of_interest").alias("marketing"),
    )


@query("enforce_reputation", """SELECT run_id, e.id FROM c_evidence e JOIN c_resolved r USING (run_id)
    WHERE (NOT r.reputation.require_peer_reviewed OR e.peer) AND (NOT r.reputation.require_primary_source OR e.primary_source)
      AND (NOT r.reputation.block_marketing OR NOT e.marketing)""")
def _(x):
    return ql.enforce_reputation(x.evidence, x.found.resolved).select("run_id", "id")


_AS_OF = "DATE '2024-01-31'"


def _doc_rules(x):
    runs = x.table("documents").select(F.col("source").alias("run_id")).distinct()
    n = F.regexp_extract("run_id", "([0-9]+)$", 1).cast("int")
    return runs.select("run_id", F.struct((F.lit(400) + n * 50).alias("max_age_days"), F.lit(True).alias("prefer_recent")).alias("recency"))


@query("enforce_recency", f"""SELECT run_id, id, published FROM (SELECT *, {T.format('published_at')} AS published FROM c_doc_evidence)
    WHERE published_at IS NULL OR date_diff('day', published_at::DATE, {_AS_OF}) <= 400 + 50 * regexp_extract(run_id, '([0-9]+)$', 1)::INTEGER""")
def _(x):
    kept = ql.enforce_recency(x.document_evidence, _doc_rules(x), F.to_date(fx.retrieved_at()))
    return kept.select("run_id", "id", stamp("published_at").alias("published"))


@query("prefer_recent", f"""SELECT source AS run_id, url, published, row_number() OVER (PARTITION BY source ORDER BY published DESC NULLS LAST, doc_id) AS recency_rank
    FROM (SELECT *, {T.format(o.parse_iso('published_date'))} AS published FROM c_docs) QUALIFY recency_rank <= 15""")
def _(x):
    pages = x.document_pages.select("run_id", "url", "page_pos", t.parse_iso(F.col("published_date")).alias("published_at"))
    return ql.prefer_recent(pages, 15, ("page_pos",)).select("run_id", "url", stamp("published_at").alias("published"), "recency_rank")


@query("constraint_filter", f"""SELECT run_id, id FROM c_doc_evidence WHERE (published_at IS NULL OR (published_at::DATE >= DATE '2019-06-01' AND published_at::DATE <= DATE '2022-12-31'))
    AND NOT contains({o.netloc('url')}, '.gov')""")
def _(x):
    runs = x.table("documents").select(F.col("source").alias("run_id")).distinct()
    limits = F.struct(
        F.lit("2019-06-01").alias("date_from"), F.lit("2022-12-31").alias("date_to"), F.array(F.lit(".GOV")).alias("domains_deny")
    )
    return ql.constraint_filter(x.document_evidence, runs.select("run_id", limits.alias("constraints"))).select("run_id", "id")


@query("recency_score", f"""SELECT run_id, count(published_at) AS n_dated, round(coalesce(avg(least(1.0::DOUBLE, greatest(0.0::DOUBLE,
    1.0 - date_diff('day', published_at::DATE, {_AS_OF}) / 1825.0::DOUBLE))), 0.0), 6) AS recency FROM c_doc_evidence GROUP BY run_id""")
def _(x):
    return ql.recency_score(x.document_evidence, F.to_date(fx.retrieved_at()), 1825)
