"""Queries over the evidence store, drafts, verification and the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as t
from ..operators import drafts as dr
from ..operators import evidence as ev
from ..operators import gate as g
from ..operators import verify as v
from ..session import scratch_path
from ..sources import store
from ..sources.config_tables import default_gate_profiles
from . import oracle as o
from .queries_discovery import T, joined, stamp
from .registry import query

UNIT = "run_id, path, iteration"
LF = "chr(10)"


def labelled(x, rows):
    """Excerpts of labelled documents: they play the part of what was stored before."""
    docs = x.table("labels").select(F.col("doc_id").alias("page_pos"))
    return rows.join(docs, "page_pos", "left_semi")


_STORED = """SELECT * FROM c_doc_excerpts WHERE page_pos IN (SELECT doc_id FROM labels)
    QUALIFY row_number() OVER (PARTITION BY excerpt_hash ORDER BY page_pos, chunk_pos) = 1"""
_NEW = f"""SELECT * FROM c_doc_excerpts WHERE excerpt_hash NOT IN (SELECT excerpt_hash FROM ({_STORED}))
    QUALIFY row_number() OVER (PARTITION BY excerpt_hash ORDER BY page_pos, chunk_pos) = 1"""


def stored(x):
    first = x.document_excerpts.sparkSession.createDataFrame([], schemas.EVIDENCE)
    return ev.new_evidence(labelled(x, x.document_excerpts), first, ["page_pos", "chunk_pos"])


# --- evidence store ---------------------------------------------------------------------------

@query("put_many", f"SELECT id, excerpt_hash, url, locator FROM ({_NEW})")
def _(x):
    fresh = ev.new_evidence(x.document_excerpts, labelled(x, x.document_excerpts), ["page_pos", "chunk_pos"])
    return fresh.select("id", "excerpt_hash", "url", "locator")


@query("write_evidence", f"SELECT id, excerpt_hash, 1 AS round, n FROM ({_STORED}), (SELECT count(*) AS n FROM ({_STORED})) UNION ALL SELECT id, excerpt_hash, 2, n FROM ({_NEW}), (SELECT count(*) AS n FROM ({_NEW})) UNION ALL SELECT NULL, NULL, 3, 0")
def _(x):
    """Two appends and a repeat of the second: rows by round, and what each call reported."""
    path = scratch_path(x.spark, "store")
    order = ["page_pos", "chunk_pos"]
    first = store.write_evidence(labelled(x, x.document_excerpts), path, order)
    early = store.read_store(x.spark, path).select("id")
    early_path = scratch_path(x.spark, "store-ids")
    early.write.parquet(early_path)
    second = store.write_evidence(x.document_excerpts, path, order)
    third = store.write_evidence(x.document_excerpts, path, order)
    seen = x.spark.read.parquet(early_path).withColumn("round", F.lit(1))
    rows = store.read_store(x.spark, path).join(seen, "id", "left").select("id", "excerpt_hash", F.coalesce("round", F.lit(2)).alias("round"))
    counted = rows.withColumn("n", F.when(F.col("round") == 1, first).otherwise(second))
    return counted.unionByName(x.spark.range(1).select(
        F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("excerpt_hash"), F.lit(3).alias("round"), F.lit(third).alias("n")
    ))


@query("get", f"SELECT id, url, excerpt FROM ({_STORED}) WHERE id = (SELECT min(id) FROM ({_STORED}))")
def _(x):
    wanted = store.read_store(x.spark, x.store).agg(F.min("id")).first()[0]
    return store.get(x.spark, x.store, wanted).select("id", "url", "excerpt")


@query("get_many", f"SELECT id, url, locator FROM ({_STORED}) WHERE id IN (SELECT id FROM c_doc_evidence)")
def _(x):
    return store.get_many(x.spark, x.store, x.document_evidence.select("id")).select("id", "url", "locator")


_AT = "TIMESTAMP '2024-01-31 00:00:00' + to_minutes(page_pos)"


@query("search", f"""SELECT id, url, {T.format('seen_at')} AS retrieved FROM (SELECT *, {_AT} AS seen_at FROM ({_STORED}))
    WHERE starts_with(lower(url), 'https://src1') AND (contains(lower(coalesce(title, '')), 'the') OR contains(lower(excerpt), 'the')) ORDER BY seen_at DESC, id LIMIT 50""")
def _(x):
    return ev.search(store.read_store(x.spark, x.store), url="HTTPS://src1", topic="The").select("id", "url", stamp("retrieved_at").alias("retrieved"))


@query("search_many", f"""SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY seen_at DESC, id) AS rank FROM (SELECT *, {_AT} AS seen_at FROM c_doc_excerpts) e
    JOIN (SELECT DISTINCT query AS topic FROM c_queries) q
      ON contains({o.ascii_lower("concat_ws(chr(1), e.title, e.excerpt)")}, {o.ascii_lower('q.topic')}) QUALIFY rank <= 50""")
def _(x):
    topics = x.found.queries.select(F.col("query").alias("topic"))
    return ev.search_many(x.document_excerpts, topics).select("topic", "id", "rank")


@query("exists_by_hash", f"SELECT id, excerpt_hash, excerpt_hash IN (SELECT excerpt_hash FROM ({_STORED})) AS stored FROM c_doc_excerpts")
def _(x):
    return store.exists_by_hash(x.document_excerpts.select("id", "excerpt_hash"), x.store).select("id", "excerpt_hash", "stored")


@query("count", f"SELECT count(*) AS n FROM ({_STORED})")
def _(x):
    return ev.count(store.read_store(x.spark, x.store))


@query("round_trip", f"""SELECT id, title, author, {T.format('published_at')} AS published, {T.format(_AT)} AS retrieved, excerpt_hash, sha256(excerpt) AS text_hash,
    locator, peer, primary_source, reputation, marketing FROM c_doc_excerpts""")
def _(x):
    """Evidence written to parquet and read back through the declared schema."""
    path = scratch_path(x.spark, "round-trip")
    x.document_excerpts.select(*schemas.EVIDENCE_COLUMNS).write.parquet(path)
    s = F.col("source_quality")
    return x.spark.read.schema(schemas.EVIDENCE).parquet(path).select(
        "id", "title", "author", stamp("published_at").alias("published"), stamp("retrieved_at").alias("retrieved"), "excerpt_hash",
        t.sha256_hex(F.col("excerpt")).alias("text_hash"), "locator", s["is_peer_reviewed"].alias("peer"), s["is_primary_source"].alias("primary_source"),
        s["domain_reputation"].alias("reputation"), s["conflict_of_interest"].alias("marketing"),
    )


@query("canonicalise_ids", f"""SELECT e.id AS minted_id, coalesce(s.id, e.id) AS id FROM c_doc_excerpts e
    LEFT JOIN ({_STORED}) s USING (excerpt_hash)""")
def _(x):
    return ev.canonicalise_ids(x.document_excerpts, stored(x)).select("minted_id", "id")


# --- prompts and responses --------------------------------------------------------------------

_ENTRY = f"""'--- EVIDENCE [' || id || '] ---' || {LF} || concat_ws(' | ', 'URL: ' || url, 'Title: ' || title, 'Reputation: ' || reputation) || {LF} || excerpt || {LF}"""
_BLOCK = f"SELECT run_id, string_agg({_ENTRY}, {LF} ORDER BY ev_pos) AS block, count(*) AS n_evidence FROM c_evidence GROUP BY run_id"


@query("evidence_block", _BLOCK)
def _(x):
    return dr.evidence_block(x.evidence)


_PROMPT = f"""concat_ws({LF}, 'Topic: ' || topic, 'Subtopics: ' || CASE WHEN len(subtopics) > 0 THEN array_to_string(subtopics, ', ') ELSE 'None specified' END,
    'Audience: ' || audience, 'Path: ' || path, 'Excerpts: ' || n_evidence, '', block"""


@query("writer_prompts", f"SELECT run_id, path, path_pos, {_PROMPT}) AS prompt FROM c_fan JOIN c_requests USING (run_id) JOIN ({_BLOCK}) USING (run_id)")
def _(x):
    return dr.writer_prompts(x.requests, x.evidence)


@query("writer_prompts_with_feedback", f"""SELECT run_id, path, path_pos, {_PROMPT}, CASE WHEN f.gaps > 0 THEN 'Notes on the last version:' || {LF} || f.gaps || ' open' || {LF}
    || 'Correct these points; mark what stays open.' END) AS prompt FROM c_fan JOIN c_requests USING (run_id) JOIN ({_BLOCK}) USING (run_id)
    LEFT JOIN (SELECT run_id, path, len(regexp_extract_all(content, 'INSUFFICIENT')) AS gaps FROM c_drafts WHERE iteration = 1) f USING (run_id, path)""")
def _(x):
    n = F.regexp_count("content", F.lit("INSUFFICIENT"))
    notes = x.drafts.select("run_id", "path", n.alias("n")).filter("n > 0").select(
        "run_id", "path", F.concat(F.col("n").cast("string"), F.lit(" open")).alias("feedback")
    )
    return dr.writer_prompts(x.requests, x.evidence, notes)


@query("verifier_prompts", f"""SELECT {UNIT}, concat_ws({LF}, 'Draft:', content, '', 'Excerpts:', block) AS prompt FROM (SELECT * FROM c_drafts WHERE iteration = 1) JOIN (
    SELECT run_id, string_agg('[' || id || '] (URL: ' || url || ')' || {LF} || excerpt || {LF}, {LF} ORDER BY ev_pos) AS block FROM c_evidence GROUP BY run_id) USING (run_id)""")
def _(x):
    return dr.verifier_prompts(x.drafts, x.evidence)


@query("apply_model", f"""SELECT {UNIT}, 'words: ' || len(list_filter(regexp_split_to_array(content, '[ \\n]+'), lambda w: w <> '')) AS response FROM c_drafts WHERE iteration = 1""")
def _(x):
    """The model hook with a stand-in that counts words of each draft."""
    def count_words(texts):
        return [f"words: {len(s.split())}" for s in texts]

    return dr.apply_model(x.drafts.withColumn("prompt", F.col("content")), count_words)


@query("extract_json_column", f"""SELECT {UNIT}, structured AS found, CASE WHEN structured THEN sha256(content) END AS content_hash FROM c_drafts WHERE iteration = 1""")
def _(x):
    found = dr.extract_json_column(x.responses)
    content = F.get_json_object("json", "$.content")
    return found.select(
        *dr.UNIT_KEYS, F.col("json").isNotNull().alias("found"), t.sha256_hex(content).alias("content_hash")
    )


@query("parse_drafts", f"""SELECT {UNIT}, content, structured, coalesce(cites, '') AS cites, coalesce(claims, 0) AS n_claims, CASE WHEN structured THEN 0 ELSE 1 END AS n_gaps
    FROM (SELECT * FROM c_drafts WHERE iteration = 1) LEFT JOIN (SELECT {UNIT}, string_agg(evidence_id, ',' ORDER BY cite_pos) AS cites FROM c_cited GROUP BY ALL) USING ({UNIT})
    LEFT JOIN (SELECT {UNIT}, count(*) AS claims FROM c_mapped GROUP BY ALL) USING ({UNIT})""")
def _(x):
    return x.drafts.select(
        *dr.UNIT_KEYS, "content", "structured", joined("citations_used").alias("cites"), F.size("evidence_map").alias("n_claims"), F.size("gaps").alias("n_gaps")
    )


@query("resolve_citations", f"SELECT {UNIT}, cite_pos, evidence_id, url FROM c_resolved_cites WHERE iteration = 1")
def _(x):
    return dr.resolve_citations(x.drafts, x.evidence).select(*dr.UNIT_KEYS, "cite_pos", "evidence_id", "url")


@query("resolve_evidence_map", f"""SELECT {UNIT}, claim_pos, claim, CASE WHEN evidence_id IN (SELECT id FROM c_evidence e WHERE e.run_id = m.run_id) THEN evidence_id ELSE '' END AS ids
    FROM c_mapped m WHERE iteration = 1 AND claim <> ''""")
def _(x):
    return dr.resolve_evidence_map(x.drafts, x.evidence).select(*dr.UNIT_KEYS, "claim_pos", "claim", joined("evidence_ids").alias("ids"))


@query("dangling_citations", f"""SELECT {UNIT}, cite_pos, evidence_id FROM c_cited c WHERE iteration = 1
    AND NOT EXISTS (SELECT 1 FROM c_evidence e WHERE e.run_id = c.run_id AND e.id = c.evidence_id)""")
def _(x):
    return dr.dangling_citations(x.drafts, x.evidence).select(*dr.UNIT_KEYS, "cite_pos", "evidence_id")


_DIVERSITY = f"""SELECT {UNIT}, coalesce(n_cited, 0) AS n_cited, coalesce(n_available, 0) AS n_available,
    least(1.0, coalesce(n_cited, 0)::DOUBLE / greatest(1, coalesce(n_available, 0))) AS source_diversity FROM c_drafts
    LEFT JOIN (SELECT {UNIT}, count(DISTINCT url) AS n_cited FROM c_resolved_cites GROUP BY ALL) USING ({UNIT})
    LEFT JOIN (SELECT run_id, count(DISTINCT url) AS n_available FROM c_evidence GROUP BY ALL) USING (run_id)"""


@query("source_diversity", f"SELECT {UNIT}, n_cited, n_available, round(source_diversity, 9) AS source_diversity FROM ({_DIVERSITY}) WHERE iteration = 1")
def _(x):
    return dr.source_diversity(x.drafts, x.evidence).withColumn("source_diversity", F.round("source_diversity", 9))


@query("empty_draft", """SELECT run_id, path, coalesce(d.content, '') <> '' AS has_content, e.run_id IS NULL OR NOT d.structured AS has_gaps,
    CASE WHEN e.run_id IS NULL THEN 'No evidence was found' WHEN NOT d.structured THEN 'The response held no JSON object and needs a check by hand' ELSE '' END AS gaps
    FROM c_fan f LEFT JOIN (SELECT DISTINCT run_id FROM c_evidence) e USING (run_id) LEFT JOIN (SELECT * FROM c_drafts WHERE iteration = 1) d USING (run_id, path)""")
def _(x):
    return dr.empty_draft(x.requests, x.evidence, x.drafts).select("run_id", "path", "has_content", "has_gaps", F.array_join("gaps", ",").alias("gaps"))


@query("stamp_lineage", f"""SELECT {UNIT}, policy_id, '' AS taxonomy_id, '' AS path_config_id, '0.1.0' AS engine_version, run_id AS lineage_run
    FROM c_drafts JOIN c_requests USING (run_id) WHERE iteration = 1""")
def _(x):
    u = dr.stamp_lineage(x.drafts, x.requests)
    return u.select(
        *dr.UNIT_KEYS, "lineage.policy_id", "lineage.taxonomy_id", "lineage.path_config_id", "lineage.engine_version", F.col("lineage.run_id").alias("lineage_run")
    )


@query("extractive_draft", f"""SELECT run_id, path, 1 AS iteration, content, coalesce(cites, '') AS cites, len(regexp_extract_all(content, 'INSUFFICIENT EVIDENCE')) AS n_gaps
    FROM (SELECT * FROM c_contents WHERE iteration = 9) LEFT JOIN (SELECT run_id, path, string_agg(id, ',' ORDER BY heading_pos, rank) AS cites FROM c_picks GROUP BY ALL) USING (run_id, path)""")
def _(x):
    d = dr.extractive_draft(x.requests, x.evidence, x.paths)
    return d.select(*dr.UNIT_KEYS, "content", joined("citations_used").alias("cites"), F.size("gaps").alias("n_gaps"))


@query("build_units", f"""SELECT {UNIT}, coalesce(n_cites, 0) AS n_citations, coalesce(n_claims, 0) AS n_claims, round(source_diversity, 9) AS diversity, 
    'cu_' || sha256(concat_ws(chr(1), run_id, path, iteration)) AS unit_id FROM ({_DIVERSITY})
    LEFT JOIN (SELECT {UNIT}, count(*) AS n_cites FROM c_resolved_cites GROUP BY ALL) USING ({UNIT})
    LEFT JOIN (SELECT {UNIT}, count(*) AS n_claims FROM c_mapped WHERE claim <> '' GROUP BY ALL) USING ({UNIT}) WHERE iteration = 1""")
def _(x):
    u = dr.build_units(x.drafts, x.evidence)
    return u.select(
        *dr.UNIT_KEYS, F.size("citations").alias("n_citations"), F.size("evidence_map").alias("n_claims"),
        F.round("scores.source_diversity", 9).alias("diversity"), "unit_id",
    )


# --- verification -----------------------------------------------------------------------------

_COUNTS = "total_claims, supported, unsupported, uncited, leakage, conflicts, gaps_acknowledged"
_ONE = "SELECT * FROM c_judged WHERE iteration = 1"


def judge_responses(x):
    """The judged claims of each draft as a judge's JSON answer; units of the 'apply' path omit the total."""
    c = x.draft_claims
    rows = c.groupBy(*dr.UNIT_KEYS).agg(
        F.array_sort(F.collect_list(F.struct("para_pos", "sent_pos", "claim", F.col("cited_ids").alias("citation_ids"), "assessment"))).alias("claims")
    )
    counts = v.tally_claims(c)
    summary = F.struct(
        F.when(F.col("path") != "apply", F.col("total_claims")).alias("total_claims"),
        *[F.when(F.col("path") == "learn", F.col(n) + F.when(F.lit(n == "supported"), 1).otherwise(0)).otherwise(F.col(n)).alias(n) for n in v.COUNTS],
    )
    body = F.to_json(F.struct(
        "claims", summary.alias("summary"), F.lit("checked").alias("overall_feedback"),
        F.array(F.struct(F.col("path").alias("topic"), F.array(F.col("run_id")).alias("evidence_ids"))).alias("contradictions"),
    ))
    return rows.join(counts, dr.UNIT_KEYS).select(*dr.UNIT_KEYS, F.when(F.col("path") == "explore", F.concat(F.lit("```\n"), body, F.lit("\n```"))).otherwise(body).alias("response"))


_TALLIED = f"SELECT {UNIT}, total_claims, supported + CASE WHEN path = 'learn' THEN 1 ELSE 0 END AS supported, unsupported, uncited, leakage, conflicts, gaps_acknowledged FROM c_reports WHERE iteration = 1"


@query("parse_reports", f"SELECT {UNIT}, {_COUNTS}, round(pass_rate, 9) AS pass_rate, confidence, 'checked' AS overall_feedback FROM ({o.scored(_TALLIED)})")
def _(x):
    r = v.parse_reports(judge_responses(x))
    return r.select(*dr.UNIT_KEYS, "total_claims", *v.COUNTS, F.round("pass_rate", 9).alias("pass_rate"), "confidence", "overall_feedback")


@query("explode_claims", f"""SELECT {UNIT}, row_number() OVER (PARTITION BY {UNIT} ORDER BY para_pos, sent_pos) - 1 AS claim_pos, claim, array_to_string(cited_ids, ',') AS ids, assessment
    FROM ({_ONE})""")
def _(x):
    return v.explode_claims(v.parse_reports(judge_responses(x))).select(*dr.UNIT_KEYS, "claim_pos", "claim", joined("citation_ids").alias("ids"), "assessment")


@query("explode_contradictions", f"SELECT {UNIT}, path AS topic, run_id AS ids FROM c_reports WHERE iteration = 1")
def _(x):
    return v.explode_contradictions(v.parse_reports(judge_responses(x))).select(*dr.UNIT_KEYS, "topic", joined("evidence_ids").alias("ids"))


@query("tally_claims", f"SELECT {UNIT}, {_COUNTS} FROM c_claim_reports")
def _(x):
    return v.tally_claims(x.claims)


@query("tally_audit", f"SELECT {UNIT}, total_claims AS recount, supported + 1 AS declared_supported FROM c_reports WHERE iteration = 1 AND path = 'learn'")
def _(x):
    audit = v.tally_audit(v.parse_reports(judge_responses(x)), x.draft_claims)
    return audit.select(*dr.UNIT_KEYS, F.col("total_claims").alias("recount"), "declared_supported")


@query("pass_rate", f"SELECT {UNIT}, round(pass_rate, 9) AS pass_rate FROM c_claim_reports")
def _(x):
    return x.claim_reports.select(*dr.UNIT_KEYS, F.round("pass_rate", 9).alias("pass_rate"))


@query("confidence", f"SELECT {UNIT}, confidence FROM c_claim_reports")
def _(x):
    return x.claim_reports.select(*dr.UNIT_KEYS, "confidence")


@query("empty_report", f"""SELECT {UNIT}, coalesce(total_claims, 0) AS total_claims, coalesce(supported, 0) AS supported,
    CASE WHEN d.run_id IS NULL THEN 'The draft is empty, so there is nothing to check' ELSE '' END AS overall_feedback
    FROM (SELECT run_id, path, 1 AS iteration FROM c_fan) LEFT JOIN (SELECT * FROM c_drafts WHERE iteration = 1) d USING ({UNIT})
    LEFT JOIN (SELECT * FROM c_reports WHERE iteration = 1) USING ({UNIT})""")
def _(x):
    units = dr.empty_draft(x.requests, x.evidence, x.drafts).withColumn("iteration", F.lit(1))
    return v.empty_report(units, v.tally_claims(x.draft_claims)).select(*dr.UNIT_KEYS, "total_claims", "supported", "overall_feedback")


@query("citation_ids", f"SELECT {UNIT}, array_to_string({o.citation_ids('content')}, ',') AS ids, len({o.citation_ids('content')}) AS n FROM c_drafts WHERE iteration = 1")
def _(x):
    c = F.col("content")
    return x.drafts.select(*dr.UNIT_KEYS, joined(t.citation_ids(c)).alias("ids"), t.citation_count(c).alias("n"))


@query("split_claims", f"SELECT {UNIT}, para_pos, sent_pos, claim, array_to_string(cited_ids, ',') AS ids, is_gap FROM c_claim_rows WHERE iteration = 1")
def _(x):
    return v.split_claims(x.drafts).select(*v.CLAIM_KEYS, "claim", joined("cited_ids").alias("ids"), "is_gap")


@query("rule_verify", f"SELECT {UNIT}, para_pos, sent_pos, assessment FROM ({_ONE})")
def _(x):
    return x.draft_claims.select(*v.CLAIM_KEYS, "assessment")


@query("numeric_conflicts", f"""SELECT run_id, context, count(*) AS n_values, sum(n)::BIGINT AS n_mentions, min(value) AS least, max(value) AS greatest FROM (
    SELECT run_id, x['context'] AS context, x['value'] AS value, count(*) AS n FROM (
      SELECT run_id, unnest({o.figure_contexts('excerpt')}) AS x FROM (SELECT run_id, excerpt FROM c_doc_excerpts UNION ALL SELECT run_id, excerpt FROM c_evidence))
    GROUP BY ALL) GROUP BY run_id, context HAVING n_values > 1""")
def _(x):
    """Over all excerpts of the documents, and the evidence of the runs."""
    return v.numeric_conflicts(x.document_excerpts.select("run_id", "id", "excerpt").union(x.evidence.select("run_id", "id", "excerpt")), ["run_id"])


@query("attach_scores", f"""SELECT {UNIT}, confidence, round(least(1.0, greatest(0.0, pass_rate)), 9) AS coverage, round(source_diversity, 9) AS diversity, pass_rate > 1 AS clamped
    FROM ({o.scored(_TALLIED)}) JOIN ({_DIVERSITY}) USING ({UNIT})""")
def _(x):
    s = v.attach_scores(dr.build_units(x.drafts, x.evidence), v.parse_reports(judge_responses(x)))
    return s.select(
        *dr.UNIT_KEYS, "scores.confidence", F.round("scores.coverage", 9).alias("coverage"), F.round("scores.source_diversity", 9).alias("diversity"),
        F.col("coverage_clamped").alias("clamped"),
    )


# --- gate -------------------------------------------------------------------------------------

def gated_claims(x):
    rows = g.gate_profile(x.claim_reports.withColumn("density_ok", F.lit(True)).withColumn("density_ratio", F.lit(1.0)), default_gate_profiles(x.spark))
    return g.feedback(g.decide(rows))


def gated_drafts(x):
    reports = v.with_scores(v.tally_claims(x.draft_claims))
    return g.evaluate(x.drafts.join(x.requests.select("run_id", "risk_profile"), "run_id"), reports, default_gate_profiles(x.spark))


@query("gate_profile", """SELECT o_orderkey, coalesce(g.autopublish_threshold, m.autopublish_threshold) AS threshold, coalesce(g.max_iterations, m.max_iterations) AS max_iterations
    FROM (SELECT o_orderkey, lower(split_part(o_orderpriority, '-', 2)) AS risk_profile FROM orders) LEFT JOIN c_gate g USING (risk_profile), (SELECT * FROM c_gate WHERE risk_profile = 'medium') m""")
def _(x):
    rows = x.table("orders").select("o_orderkey", F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("risk_profile"))
    return g.gate_profile(rows, default_gate_profiles(x.spark)).select(
        "o_orderkey", F.col("autopublish_threshold").alias("threshold"), F.col("max_writer_iterations").alias("max_iterations")
    )


@query("citation_density", f"SELECT {UNIT}, round(density_ratio, 9) AS density_ratio, content <> '' AND density_ratio >= min_ratio AS density_ok FROM c_density WHERE iteration = 1")
def _(x):
    return gated_drafts(x).select(*dr.UNIT_KEYS, F.round("density_ratio", 9).alias("density_ratio"), "density_ok")


@query("fixable", f"SELECT {UNIT}, unsupported > 0 OR uncited > 0 OR leakage > 0 OR conflicts > 0 AS fixable FROM c_claim_reports")
def _(x):
    return g.fixable(x.claim_reports).select(*dr.UNIT_KEYS, "fixable")


_WORDS = f"""concat_ws({LF}, CASE WHEN unsupported > 0 THEN unsupported || ' claim(s) are not backed by the evidence they cite: correct or drop them.' END,
    CASE WHEN uncited > 0 THEN uncited || ' claim(s) cite nothing: add a marker or declare the gap.' END,
    CASE WHEN leakage > 0 THEN leakage || ' claim(s) bring in facts that no excerpt holds: drop them or find a source.' END,
    CASE WHEN conflicts > 0 THEN conflicts || ' claim(s) rest on sources that disagree: say so and cite both.' END,
    CASE WHEN NOT density_ok THEN 'Citations: ' || round_even(density_ratio * 100, 0)::INTEGER || '% of the longer paragraphs carry at least ' || min_citations || ', wanted are '
      || round_even(min_ratio * 100, 0)::INTEGER || '%.' END)"""
_FEEDBACK = f"""concat_ws({LF}, CASE WHEN {_WORDS} = '' THEN 'No issues.' ELSE {_WORDS} END,
    CASE WHEN decision = 'review' AND iteration >= max_iterations THEN 'Iteration limit (' || max_iterations || ') reached: a person decides.' END)"""


@query("feedback", f"SELECT {UNIT}, {_FEEDBACK} AS feedback FROM c_gated WHERE iteration = 1")
def _(x):
    return gated_drafts(x).select(*dr.UNIT_KEYS, "feedback")


@query("decide", f"SELECT {UNIT}, confidence, decision FROM c_claim_gates")
def _(x):
    return gated_claims(x).select(*dr.UNIT_KEYS, "confidence", "decision")


@query("gate_drafts", f"SELECT {UNIT}, confidence, decision FROM c_gated WHERE iteration = 1")
def _(x):
    return gated_drafts(x).select(*dr.UNIT_KEYS, "confidence", "decision")


@query("route", f"SELECT {UNIT}, decision = 'pass' AS should_publish, decision = 'fail' AS should_rewrite, decision = 'review' AS needs_human FROM c_claim_gates")
def _(x):
    return g.route(gated_claims(x)).select(*dr.UNIT_KEYS, "should_publish", "should_rewrite", "needs_human")


@query("conflict_policy", f"""SELECT {UNIT}, CASE WHEN conflicts > 0 AND (risk_profile = 'high' OR (risk_profile = 'medium' AND decision = 'pass')) THEN 'review' ELSE decision END AS decision,
    CASE WHEN conflicts > 0 AND risk_profile = 'low' THEN 'mixed' END AS label FROM c_claim_gates""")
def _(x):
    return g.conflict_policy(gated_claims(x)).select(*dr.UNIT_KEYS, "decision", "label")
