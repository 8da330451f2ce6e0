"""Building blocks of the check queries: named common table expressions, added where a query names them."""

from __future__ import annotations

import re

from ..functions import quality as q
from ..functions import text as t
from ..schemas import ASSESSMENTS
from ..sources import config_tables as cfg
from . import fixtures as fx


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return str(v)
    if isinstance(v, str):
        return quote(v)
    if isinstance(v, dict):
        return "{" + ", ".join(f"{quote(k)}: {literal(x)}" for k, x in v.items()) + "}"
    return "[" + ", ".join(literal(x) for x in v) + "]"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {quote(t.STRIP_PATTERN)}, '', 'g')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {quote(t.WORD_PATTERN)})"


def netloc(url: str) -> str:
    return f"lower(regexp_extract({url}, {quote(t.NETLOC_PATTERN)}, 1))"


def words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, {quote('[' + t.SPACE + ']+')}), lambda w: w <> ''))"


def ascii_lower(x: str) -> str:
    return f"translate({x}, '{t.UPPER_ASCII}', '{t.UPPER_ASCII.lower()}')"


def unescape(x: str) -> str:
    names = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in t.ENTITIES.items()) + "}"
    name = "regexp_extract(p, '^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);', 1)"
    code = f"CASE WHEN {name}[2] IN ('x', 'X') THEN ('0x' || {name}[3:])::INT ELSE {name}[2:]::INT END"
    char = f"CASE WHEN {name} = '' THEN NULL WHEN {name}[1] = '#' THEN CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr({code}) END ELSE {names}[{name}] END"
    return f"array_to_string(list_transform(string_split({x}, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE coalesce(({char}) || p[length({name}) + 2:], '&' || p) END), '')"


def html_title(h: str) -> str:
    return strip(unescape(f"regexp_extract({h}, '(?is)<title[^>]*>(.*?)</title>', 1)"))


def html_to_text(h: str) -> str:
    """Literal patterns; this matcher does not recurse, so nested adverts may be repeated groups here."""
    inner = r"(?:[^<]|<(?:[^/dD]|/[^dD]|/?[dD][^iI]))*"
    nested = rf"(?:<div(?:\s[^>]*)?>{inner}(?:<div(?:\s[^>]*)?>{inner}</div\s*>{inner})*</div\s*>{inner})*"
    drop = [r"(?is)<!--.*?-->", *[rf"(?is)<{n}(?:\s[^>]*)?>.*?</{n}\s*>" for n in ("head", "script", "style", "nav", "footer")], rf'(?is)<div class="ad"[^>]*>{inner}{nested}</div\s*>']
    for pattern in drop:
        h = f"regexp_replace({h}, {quote(pattern)}, ' ', 'g')"
    blocks = r"(?i)</?(?:p|br|h1|h2|h3|h4|h5|h6|ul|ol|li|div|tr|table|article|section|header|blockquote)(?:\s[^>]*)?/?>"
    h = f"regexp_replace({h}, {quote(blocks)}, chr(10) || chr(10), 'g')"
    h = f"regexp_replace({h}, '<[/!]?[A-Za-z][^>]*>', '', 'g')"
    return strip(f"regexp_replace({unescape(h)}, {quote('[ ' + chr(92) + 't]*' + chr(92) + 'n[' + t.SPACE + ']*' + chr(92) + 'n[' + t.SPACE + ']*')}, chr(10) || chr(10), 'g')")


def paragraphs(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '\\n\\n+'), lambda p: {strip('p')}), lambda p: p <> '')"


def chunk(x: str, limit: int = 1500) -> str:
    pack = f"""list_transform([list_reduce(
        list_transform(string_split(p, chr(10)), lambda l: {{'done': []::VARCHAR[], 'cur': l}}),
        lambda a, b: CASE WHEN length(a.cur) + length(b.cur) + 1 > {limit} AND a.cur <> ''
          THEN {{'done': list_append(a.done, {strip('a.cur')}), 'cur': b.cur}}
          ELSE {{'done': a.done, 'cur': CASE WHEN a.cur = '' THEN b.cur ELSE a.cur || chr(10) || b.cur END}} END)],
        lambda r: CASE WHEN {strip('r.cur')} = '' THEN r.done ELSE list_append(r.done, {strip('r.cur')}) END)[1]"""
    return f"flatten(list_transform({paragraphs(x)}, lambda p: CASE WHEN length(p) <= {limit} THEN [p] ELSE {pack} END))"


def contains_any(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {quote(n)})" for n in needles) + ")"


def ends_any(x: str, suffixes) -> str:
    return "(" + " OR ".join(f"suffix({x}, {quote(s)})" for s in suffixes) + ")"


def tier(url: str, trusted: str) -> str:
    d = netloc(url)
    return (
        f"CASE WHEN len(list_filter(coalesce({trusted}, []::VARCHAR[]), lambda t: contains({d}, lower(t)))) > 0 THEN 'trusted' "
        f"WHEN {ends_any(d, q.INSTITUTION_SUFFIXES)} THEN 'institutional' ELSE 'unknown' END"
    )


def marketing(markdown: str, title: str) -> str:
    return contains_any(
        f"lower({markdown} || coalesce({title}, ''))",
        ["sponsored", "advertisement", "promoted", "affiliate", "buy now", "sign up free", "limited time offer"],
    )


def mint_id(run: str, url: str, locator: str, digest: str) -> str:
    return f"'ev_' || sha256(concat_ws(chr(1), {run}, {url}, {locator}, {digest}))"


def numbers(x: str) -> str:
    return f"regexp_extract_all({x}, {quote(t.NUMBER_PATTERN)})"


def figure_contexts(x: str) -> str:
    """Three words on each side of every number, each of the six left out in turn."""
    place = lambda k: f"CASE WHEN i + {k} < 1 OR i + {k} > len(ps) THEN '' WHEN regexp_matches(ps[i + {k}], '^[0-9]') THEN '#' ELSE ps[i + {k}] END"
    words = "[" + ", ".join(place(k) for k in (-3, -2, -1, 1, 2, 3)) + "]"
    out = "list_transform(w, lambda v, n: CASE WHEN n = j THEN '*' ELSE v END)"
    each = f"list_transform([1, 2, 3, 4, 5, 6], lambda j: {{'context': array_to_string({out}[1:3] || ['#'] || {out}[4:6], ' '), 'value': ps[i]}})"
    enough = "len(list_filter(w, lambda v: v NOT IN ('', '#'))) >= 4"
    one = f"list_transform([{words}], lambda w: CASE WHEN {enough} THEN {each} ELSE [] END)[1]"
    numbers_at = "list_filter(range(1, len(ps) + 1), lambda i: regexp_matches(ps[i], '^[0-9]'))"
    parts = f"regexp_extract_all(lower({x}), '[0-9]+(?:\\.[0-9]+)?|\\p{{L}}+')"
    return f"list_transform([{parts}], lambda ps: flatten(list_transform({numbers_at}, lambda i: {one})))[1]"


def parse_iso(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^\\d{{4}}-?\\d{{2}}-?\\d{{2}}') THEN try_cast(replace({x}, 'Z', '') AS TIMESTAMP) END"


def excerpt_rows(source: str, keys: str) -> str:
    """Chunks of ``source(markdown, ...)`` with ordinals, hashes and the length filter."""
    return f"""SELECT *, 'chunk:' || chunk_pos AS locator, sha256(excerpt) AS excerpt_hash FROM (
        SELECT {keys}, unnest(chunks) AS excerpt, generate_subscripts(chunks, 1) - 1 AS chunk_pos
        FROM (SELECT *, {chunk('markdown')} AS chunks FROM {source})) WHERE length(excerpt) >= 50"""


def capped(source: str, per_source: int = 5, per_run: int = 100) -> str:
    """Duplicates dropped, both caps applied, survivors numbered like the operator does."""
    return f"""SELECT * EXCLUDE (n_all, n_widest, n_capped, source_rank, run_rank, n_chars, a, b),
          row_number() OVER (PARTITION BY run_id ORDER BY a, b) AS ev_pos FROM (
        SELECT *, CASE WHEN n_all <= {per_run} AND n_widest <= {per_source} THEN page_pos
                       WHEN n_capped <= {per_run} THEN page_pos ELSE run_rank END AS a,
                  CASE WHEN n_all <= {per_run} AND n_widest <= {per_source} THEN chunk_pos
                       WHEN n_capped <= {per_run} THEN source_rank ELSE 0 END AS b FROM (
          SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n_chars DESC, page_pos, source_rank) AS run_rank FROM (
            SELECT *, sum(CASE WHEN source_rank <= {per_source} THEN 1 ELSE 0 END) OVER (PARTITION BY run_id) AS n_capped,
              max(source_rank) OVER (PARTITION BY run_id) AS n_widest, count(*) OVER (PARTITION BY run_id) AS n_all FROM (
              SELECT *, length(excerpt) AS n_chars,
                row_number() OVER (PARTITION BY run_id, url ORDER BY length(excerpt) DESC, page_pos, chunk_pos) AS source_rank
              FROM (SELECT * FROM {source}
                QUALIFY row_number() OVER (PARTITION BY run_id, excerpt_hash ORDER BY page_pos, chunk_pos) = 1)
            )) WHERE source_rank <= {per_source})
        WHERE run_rank <= {per_run})"""


def citation_ids(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {quote(t.CITATION_PATTERN)}), lambda m: regexp_extract(m, '^\\[(?:ev:)?(.*)\\]$', 1))"


def sentences(x: str) -> str:
    cut = f"string_split(regexp_replace({x}, {quote(t.SENTENCE_END)}, '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {strip('s')}), lambda s: s <> '')"


def substantive(x: str) -> str:
    blocks = f"list_transform(string_split({x}, chr(10) || chr(10)), lambda p: {strip('p')})"
    return f"list_filter({blocks}, lambda p: p <> '' AND NOT starts_with(p, '#') AND {words('p')} > 15)"


def tally(source: str, keys: str) -> str:
    kinds = ", ".join(f"count(*) FILTER (assessment = '{label}') AS {col}" for label, col in ASSESSMENTS.items())
    return f"SELECT {keys}, count(*) AS total_claims, {kinds} FROM {source} GROUP BY ALL"


def scored(reports: str) -> str:
    return f"""SELECT *, round_even(least(1.0, greatest(0.0, pass_rate
        * CASE WHEN leakage > 0 THEN greatest(0.0, 1.0 - (leakage / greatest(1, total_claims)::DOUBLE) * 1.5::DOUBLE) ELSE 1.0::DOUBLE END
        * CASE WHEN conflicts > 0 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END)), 3) AS confidence
      FROM (SELECT *, (supported + gaps_acknowledged)::DOUBLE / greatest(1, total_claims) AS pass_rate FROM ({reports}))"""


def decision() -> str:
    return """CASE WHEN confidence >= autopublish_threshold AND density_ok AND leakage = 0 THEN 'pass'
      WHEN iteration < max_iterations AND (unsupported > 0 OR uncited > 0 OR leakage > 0 OR conflicts > 0) THEN 'fail' ELSE 'review' END"""


_RULES = "STRUCT(require_peer_reviewed BOOLEAN, require_primary_source BOOLEAN, trusted_institutions VARCHAR[], block_marketing BOOLEAN)"
_RECENCY = "STRUCT(max_age_days INTEGER, prefer_recent BOOLEAN)"


def _rules(r):
    return r and {
        "require_peer_reviewed": r.get("require_peer_reviewed", False),
        "require_primary_source": r.get("require_primary_source", False),
        "trusted_institutions": r.get("trusted_institutions", []),
        "block_marketing": r.get("block_marketing", True),
    }


def _recency(r):
    return r and {"max_age_days": r.get("max_age_days"), "prefer_recent": r.get("prefer_recent", True)}


def _policy_rows():
    for p in fx.POLICIES:
        yield (
            p["id"], p.get("name", p["id"]), p.get("domains_allow", []), p.get("domains_deny", []),
            _rules(p.get("reputation", {}) or {"block_marketing": True}),
            _recency(p.get("recency", {}) or {"prefer_recent": True}),
            p.get("max_sources_per_run", cfg.MAX_SOURCES_DEFAULT),
            [
                {
                    "topic_pattern": o["topic_pattern"], "domains_allow": o.get("domains_allow", []),
                    "domains_deny": o.get("domains_deny", []), "reputation": _rules(o.get("reputation")),
                    "recency": _recency(o.get("recency")),
                }
                for o in p.get("topic_overrides", [])
            ],
        )


def _pick(expr: str, names) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN {k} THEN {literal(v)}" for k, v in enumerate(names)) + " END"


CTES: dict[str, str] = {
    "c_policies": f"""SELECT policy_id, name, allow::VARCHAR[] AS allow, deny::VARCHAR[] AS deny, reputation::{_RULES} AS reputation,
        recency::{_RECENCY} AS recency, max_sources,
        overrides::STRUCT(topic_pattern VARCHAR, domains_allow VARCHAR[], domains_deny VARCHAR[], reputation {_RULES}, recency {_RECENCY})[] AS overrides
      FROM {values(_policy_rows())} AS v(policy_id, name, allow, deny, reputation, recency, max_sources, overrides)""",
    "c_gate": f"""SELECT risk_profile, autopublish_threshold::DOUBLE AS autopublish_threshold, min_citations, min_ratio::DOUBLE AS min_ratio, max_iterations
      FROM {values(cfg.GATE_DEFAULTS)} AS v(risk_profile, autopublish_threshold, min_citations, min_ratio, max_iterations)""",
    "c_paths": f"SELECT * FROM {values(fx.PATHS)} AS v(path, label, per_heading)",
    "c_terms": f"SELECT * FROM {values([(a, w) for a, _, ws in fx.TAXONOMY for w in ws])} AS v(tag, term)",
    "c_taxonomy": f"SELECT * FROM {values([(a, b) for a, b, _ in fx.TAXONOMY])} AS v(tag, parent)",
    "c_domain_tags": f"SELECT * FROM {values(fx.DOMAIN_TAGS)} AS v(tag, pattern)",
    "c_requests": f"""SELECT 'run_' || item_id AS run_id, w[1] AS topic, coalesce(w[2:], []) AS subtopics,
        {_pick('item_id % 3', [['learn'], ['learn', 'explore'], ['learn', 'explore', 'apply']])} AS paths,
        'general' AS audience,
        {_pick('(item_id // 3) % 3', ['open', 'org-net', 'reviewed'])} AS policy_id,
        coalesce({_pick('item_id % 4', ['low', 'medium', 'high'])}, 'medium') AS risk_profile,
        CASE WHEN item_id % 5 = 0 THEN ['ththed.example.org', 'example.org'] END AS seeds,
        CASE WHEN item_id % 5 = 0 THEN ['blog.'] END AS c_deny,
        CASE WHEN item_id % 5 = 0 THEN DATE '2020-01-01' END AS c_from,
        CASE WHEN item_id % 5 = 0 THEN DATE '2023-06-30' END AS c_to
      FROM (SELECT item_id, list_transform(list_filter(list_transform(range(1, len(x) + 1), lambda i: {{'i': i, 'v': x[i]}}),
              lambda s: list_position(x, s.v) = s.i), lambda s: s.v) AS w
            FROM (SELECT item_id, regexp_extract_all(lower(text), '\\p{{L}}+') AS x FROM benchmark))""",
    "c_page_texts": f"SELECT url, html, {html_title('html')} AS title, {html_to_text('html')} AS markdown FROM pages",
    "c_pages": """SELECT url, title, CASE WHEN length(html) % 2 = 0
        THEN replace(markdown, chr(10) || chr(10), ' A yearly survey of the region counted ' || (1000 + (length(html) // 2) % 3) || ' visitors on the main site.' || chr(10) || chr(10))
        ELSE markdown END AS markdown FROM c_page_texts""",
    "c_queries": """SELECT run_id, 0 AS query_pos, topic AS query FROM c_requests
      UNION ALL SELECT run_id, generate_subscripts(subtopics, 1), topic || ' ' || unnest(subtopics) FROM c_requests""",
    "c_page_tf": f"""SELECT url, term, count(*) AS tf FROM (
        SELECT url, unnest({tokens("concat_ws(' ', title, markdown)")}) AS term FROM c_pages) GROUP BY ALL""",
    "c_search": f"""SELECT r.run_id, r.query_pos, r.query, h.url, h.score, h.result_pos FROM c_queries r JOIN (
        SELECT query, url, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, url) AS result_pos FROM (
          SELECT query, url, sum(tf) AS score FROM (SELECT query, len(terms) AS n_terms, unnest(terms) AS term
              FROM (SELECT DISTINCT query, list_distinct({tokens('query')}) AS terms FROM c_queries)) JOIN c_page_tf USING (term)
          GROUP BY query, url HAVING count(*) = max(n_terms))) h ON h.query = r.query AND h.result_pos <= 20""",
    "c_candidates": f"""SELECT run_id, url, min((query_pos, result_pos)) AS p FROM (
        SELECT run_id, query_pos, result_pos, url FROM c_search
        UNION ALL SELECT run_id, 2147483647, i, 'https://' || d FROM (
          SELECT run_id, generate_subscripts(seeds, 1) - 1 AS i, unnest(seeds) AS d FROM c_requests)) GROUP BY ALL""",
    "c_resolved": """SELECT run_id, policy_id, name, hit.topic_pattern AS override,
        allow || coalesce(hit.domains_allow, []) AS allow, deny || coalesce(hit.domains_deny, []) AS deny,
        coalesce(hit.reputation, reputation) AS reputation, coalesce(hit.recency, recency) AS recency, max_sources
      FROM (SELECT r.run_id, p.*, list_filter(p.overrides, lambda o: regexp_matches(r.topic, '(?i)' || o.topic_pattern))[1] AS hit
            FROM c_requests r JOIN c_policies p USING (policy_id))""",
    "c_allowed": f"""SELECT run_id, url, p, max_sources FROM (SELECT *, {netloc('url')} AS domain FROM c_candidates) JOIN c_resolved USING (run_id)
      WHERE domain <> '' AND len(list_filter(deny, lambda x: contains(domain, lower(x)))) = 0
        AND (len(allow) = 0 OR len(list_filter(allow, lambda x: contains(domain, lower(x)))) > 0)""",
    "c_sources": """SELECT run_id, url, pos FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY p) AS pos FROM c_allowed)
      WHERE pos <= max_sources""",
    "c_fetched": f"""SELECT run_id, url, pos AS page_pos, title, markdown, reputation.trusted_institutions AS trusted
      FROM c_sources JOIN c_pages USING (url) JOIN c_resolved USING (run_id) WHERE {strip('markdown')} <> ''""",
    "c_excerpts": f"""SELECT *, {mint_id('run_id', 'url', 'locator', 'excerpt_hash')} AS id FROM (
      {excerpt_rows('c_fetched', f'''run_id, url, page_pos, nullif(title, '') AS title, {tier('url', 'trusted')} AS reputation,
        {contains_any('lower(url)', q.PEER_REVIEW_MARKS)} AS peer, {ends_any(netloc('url'), q.PRIMARY_SUFFIXES)} AS primary_source,
        {marketing('markdown', 'title')} AS marketing''')})""",
    "c_evidence": capped("c_excerpts"),
    "c_docs": f"""SELECT doc_id, source, 'https://' || source || '.example.' ||
          CASE lang WHEN 'en' THEN 'org' WHEN 'fr' THEN 'gov' WHEN 'es' THEN 'edu' ELSE 'com' END || '/doc/' || doc_id AS url,
        CASE WHEN coalesce(toxic, 0) <> 0 THEN 0 WHEN quality = 0 THEN 404 ELSE 200 END AS status_code,
        CASE WHEN coalesce(toxic, 0) <> 0 THEN '' WHEN lang = 'en' THEN lang || ' document ' || doc_id ELSE 'Doc ' || doc_id END AS title,
        CASE WHEN coalesce(toxic, 0) <> 0 THEN '' ELSE source END AS author,
        CASE WHEN coalesce(toxic, 0) <> 0 THEN '' WHEN lang = 'de' THEN '2024'
          ELSE strftime(DATE '2019-01-01' + (doc_id % 1800)::INTEGER, '%Y-%m-%d') || 'T00:00:00Z' END AS published_date,
        CASE WHEN coalesce(toxic, 0) <> 0 THEN '' ELSE replace(text, chr(10), chr(10) || chr(10)) END AS markdown
      FROM documents LEFT JOIN labels USING (doc_id)""",
    "c_doc_excerpts": f"""SELECT *, {mint_id('run_id', 'url', 'locator', 'excerpt_hash')} AS id FROM (
      {excerpt_rows(f"(SELECT * FROM c_docs WHERE status_code <> 0 AND {strip('markdown')} <> '')",
        f"source AS run_id, url, doc_id AS page_pos, nullif(title, '') AS title, nullif(author, '') AS author, {parse_iso('published_date')} AS published_at, "
        f"{ends_any(netloc('url'), q.PRIMARY_SUFFIXES)} AS primary_source, {contains_any('lower(url)', q.PEER_REVIEW_MARKS)} AS peer, "
        f"{tier('url', '[]::VARCHAR[]')} AS reputation, {marketing('markdown', 'title')} AS marketing")})""",
    "c_doc_evidence": capped("c_doc_excerpts"),
    "c_claims": """SELECT 'run_' || (user_id // 5) AS run_id, 'path_' || (user_id % 5) AS path,
        least(3, 1 + (day(ts) - 1) // 10)::INTEGER AS iteration,
        CASE WHEN event_type = 'error' AND value < 1 THEN 'leakage' WHEN event_type = 'signup' AND value < 3 THEN 'uncited'
             WHEN event_type = 'purchase' AND value < 3 THEN 'gap_acknowledged' WHEN event_type = 'view' AND value < 1 THEN 'conflict'
             ELSE 'supported' END AS assessment,
        ['low', 'medium', 'high'][(user_id // 5) % 3 + 1] AS risk_profile FROM events""",
    "c_headings": """SELECT run_id, unnest([topic] || subtopics) AS heading, generate_subscripts([topic] || subtopics, 1) - 1 AS heading_pos FROM c_requests""",
    "c_fan": "SELECT run_id, unnest(paths) AS path, generate_subscripts(paths, 1) - 1 AS path_pos FROM c_requests",
    "c_ev_words": f"SELECT run_id, id, length(excerpt) AS n_chars, ev_pos, unnest(list_distinct({tokens('excerpt')})) AS word FROM c_evidence",
    "c_best": f"""SELECT run_id, heading_pos, id, row_number() OVER (PARTITION BY run_id, heading_pos ORDER BY n_chars DESC, ev_pos) AS rank FROM (
        SELECT run_id, heading_pos, id, n_chars, ev_pos FROM (
          SELECT run_id, heading_pos, len(list_distinct({tokens('heading')})) AS n_words, unnest(list_distinct({tokens('heading')})) AS word FROM c_headings)
        JOIN c_ev_words USING (run_id, word) GROUP BY run_id, heading_pos, id, n_chars, ev_pos, n_words HAVING count(*) = n_words)
        QUALIFY rank <= 3""",
    "c_picks": """SELECT f.run_id, f.path, b.heading_pos, b.rank, b.id, e.url, e.excerpt
      FROM c_fan f JOIN c_paths p USING (path) JOIN c_best b USING (run_id) JOIN c_evidence e USING (run_id, id) WHERE b.rank <= p.per_heading""",
    "c_flawed": """SELECT *, CASE WHEN iteration <= (length(excerpt) // 8) % 4 THEN length(excerpt) % 8 ELSE 9 END AS flaw
      FROM c_picks, (SELECT unnest([1, 2, 3, 4, 9]) AS iteration)""",
    "c_contents": """SELECT run_id, path, iteration, string_agg(line, chr(10) || chr(10) ORDER BY heading_pos, rank) AS content FROM (
        SELECT run_id, path, iteration, -1 AS heading_pos, 0 AS rank, '# ' || heading AS line FROM c_headings JOIN c_fan USING (run_id), (SELECT unnest([1, 2, 3, 4, 9]) AS iteration) WHERE heading_pos = 0
        UNION ALL SELECT run_id, path, iteration, heading_pos, 0, '## ' || heading FROM c_headings JOIN c_fan USING (run_id), (SELECT unnest([1, 2, 3, 4, 9]) AS iteration)
        UNION ALL SELECT run_id, path, iteration, heading_pos, rank, CASE flaw WHEN 0 THEN excerpt WHEN 1 THEN excerpt || ' [ev:ev_unknown]'
            WHEN 2 THEN excerpt || ' Observed 98765 cases. [ev:' || id || ']'
            ELSE excerpt || ' [ev:' || id || ']' || CASE WHEN flaw IN (4, 5, 6) AND peer IS NOT NULL THEN '[ev:' || peer || ']' ELSE '' END END
          FROM c_flawed LEFT JOIN (SELECT run_id, min(id) AS peer FROM c_evidence WHERE contains(excerpt, 'yearly survey') GROUP BY run_id) USING (run_id)
        UNION ALL SELECT run_id, path, iteration, heading_pos, 1, '[INSUFFICIENT EVIDENCE: ' || heading || ']' FROM c_headings JOIN c_fan USING (run_id), (SELECT unnest([1, 2, 3, 4, 9]) AS iteration)
          WHERE NOT EXISTS (SELECT 1 FROM c_picks k WHERE k.run_id = c_headings.run_id AND k.path = c_fan.path AND k.heading_pos = c_headings.heading_pos))
      WHERE run_id IN (SELECT run_id FROM c_evidence) GROUP BY run_id, path, iteration""",
    "c_drafts": "SELECT *, length(content) % 7 <> 0 AS structured FROM c_contents WHERE iteration < 9",
    "c_cited": """SELECT run_id, path, iteration, evidence_id,
        row_number() OVER (PARTITION BY run_id, path, iteration ORDER BY heading_pos, rank) - 1 AS cite_pos FROM (
        SELECT f.*, CASE flaw WHEN 0 THEN NULL WHEN 1 THEN 'ev_unknown' ELSE id END AS evidence_id
        FROM c_flawed f JOIN c_drafts d USING (run_id, path, iteration) WHERE d.structured) WHERE evidence_id IS NOT NULL""",
    "c_mapped": """SELECT run_id, path, iteration, row_number() OVER (PARTITION BY run_id, path, iteration ORDER BY heading_pos, rank) - 1 AS claim_pos,
        CASE WHEN length(excerpt) % 8 = 3 THEN '' ELSE excerpt END AS claim, CASE flaw WHEN 1 THEN 'ev_unknown' ELSE id END AS evidence_id
      FROM c_flawed f JOIN c_drafts d USING (run_id, path, iteration) WHERE d.structured""",
    "c_resolved_cites": """SELECT c.*, e.url FROM c_cited c JOIN c_evidence e ON e.run_id = c.run_id AND e.id = c.evidence_id""",
    "c_paras": f"""SELECT run_id, path, iteration, unnest(ps) AS para, generate_subscripts(ps, 1) - 1 AS para_pos
      FROM (SELECT *, {paragraphs('content')} AS ps FROM c_drafts)""",
    "c_claim_rows": f"""SELECT run_id, path, iteration, para_pos, sent_pos, {strip(f"regexp_replace(sentence, {quote(t.CITATION_PATTERN)}, '', 'g')")} AS claim,
        list_transform([CASE WHEN len(own) > 0 THEN own ELSE para_ids END], lambda l: list_filter(l, lambda v, i: list_position(l, v) = i))[1] AS cited_ids, is_gap FROM (
        SELECT *, {citation_ids('sentence')} AS own FROM (
          SELECT run_id, path, iteration, para_pos, is_gap, {citation_ids('para')} AS para_ids, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS sent_pos
          FROM (SELECT *, CASE WHEN is_gap THEN [para] ELSE {sentences('para')} END AS ss FROM (
            SELECT *, starts_with(para, '[INSUFFICIENT EVIDENCE') AS is_gap FROM c_paras WHERE NOT starts_with(para, '#')))))
      WHERE {strip(f"regexp_replace(sentence, {quote(t.CITATION_PATTERN)}, '', 'g')")} <> ''""",
    "c_ev_tokens": f"""SELECT run_id, id, url, list_distinct({tokens('excerpt')}) AS words, list_distinct({numbers('excerpt')}) AS figures FROM c_evidence""",
    "c_support": f"""SELECT run_id, path, iteration, para_pos, sent_pos, count(*) AS n_resolved,
        max(len(list_intersect(c.words, e.words))) AS n_shared,
        len(list_distinct(flatten(list(list_intersect(c.figures, e.figures))))) AS n_found FROM (
        SELECT *, list_distinct({tokens('claim')}) AS words, list_distinct({numbers('claim')}) AS figures, unnest(cited_ids) AS id FROM c_claim_rows) c
      JOIN c_ev_tokens e USING (run_id, id) GROUP BY ALL""",
    "c_foreign": f"""SELECT DISTINCT run_id, path, iteration, para_pos, sent_pos FROM (
        SELECT *, unnest({numbers('claim')}) AS figure FROM c_claim_rows) c
      WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT run_id, unnest(figures) AS figure FROM c_ev_tokens) f WHERE f.run_id = c.run_id AND f.figure = c.figure)""",
    "c_disputed": f"""SELECT DISTINCT run_id, path, iteration, para_pos, sent_pos FROM (
        SELECT DISTINCT run_id, path, iteration, para_pos, sent_pos, id, x['context'] AS context FROM (
          SELECT *, unnest(cited_ids) AS id FROM (SELECT *, unnest({figure_contexts('claim')}) AS x FROM c_claim_rows))) c
      JOIN (SELECT run_id, id, x['context'] AS context, x['value'] AS value FROM (SELECT run_id, id, unnest({figure_contexts('excerpt')}) AS x FROM c_evidence)) e USING (run_id, id, context)
      GROUP BY run_id, path, iteration, para_pos, sent_pos, context HAVING count(DISTINCT value) > 1""",
    "c_judged": f"""SELECT c.*, CASE WHEN is_gap THEN 'gap_acknowledged' WHEN len(cited_ids) = 0 THEN 'uncited' WHEN s.n_resolved IS NULL THEN 'unsupported'
        WHEN f.run_id IS NOT NULL THEN 'leakage' WHEN z.run_id IS NOT NULL THEN 'conflict'
        WHEN s.n_found < len(list_distinct({numbers('claim')})) OR s.n_shared < len(list_distinct({tokens('claim')})) * 0.6::DOUBLE THEN 'unsupported'
        ELSE 'supported' END AS assessment
      FROM c_claim_rows c LEFT JOIN c_support s USING (run_id, path, iteration, para_pos, sent_pos)
      LEFT JOIN c_foreign f USING (run_id, path, iteration, para_pos, sent_pos)
      LEFT JOIN c_disputed z USING (run_id, path, iteration, para_pos, sent_pos)""",
    "c_reports": scored(tally("c_judged", "run_id, path, iteration")),
    "c_density": f"""SELECT run_id, path, iteration, content, structured, risk_profile, autopublish_threshold, min_citations, min_ratio, max_iterations,
        CASE WHEN content = '' THEN 0.0 WHEN len(subs) = 0 THEN 1.0
          ELSE len(list_filter(subs, lambda p: len(regexp_extract_all(p, {quote(t.CITATION_PATTERN)})) >= min_citations)) / len(subs)::DOUBLE END AS density_ratio
      FROM (SELECT d.*, g.*, {substantive('content')} AS subs FROM c_drafts d JOIN c_requests r USING (run_id) JOIN c_gate g USING (risk_profile))""",
    "c_gated": f"""SELECT *, {decision()} AS decision FROM (SELECT *, content <> '' AND density_ratio >= min_ratio AS density_ok
      FROM c_density JOIN c_reports USING (run_id, path, iteration))""",
    "c_rounds": """SELECT * FROM c_gated g WHERE NOT EXISTS (SELECT 1 FROM c_gated b WHERE b.run_id = g.run_id AND b.path = g.path
        AND b.iteration < g.iteration AND b.decision <> 'fail')""",
    "c_final": f"""SELECT r.run_id, r.path, r.iteration, r.content, r.confidence, least(1.0, greatest(0.0, r.pass_rate)) AS coverage,
        least(1.0, coalesce(n_cited, 0)::DOUBLE / greatest(1, coalesce(n_available, 0))) AS diversity, coalesce(n_cites, 0) AS n_cites, coalesce(n_claims, 0) AS n_claims
      FROM (SELECT * FROM c_rounds QUALIFY row_number() OVER (PARTITION BY run_id, path ORDER BY iteration DESC) = 1) r
      LEFT JOIN (SELECT run_id, path, iteration, count(DISTINCT url) AS n_cited, count(*) AS n_cites FROM c_resolved_cites GROUP BY ALL) USING (run_id, path, iteration)
      LEFT JOIN (SELECT run_id, path, iteration, count(*) AS n_claims FROM c_mapped WHERE claim <> '' GROUP BY ALL) USING (run_id, path, iteration)
      LEFT JOIN (SELECT run_id, count(DISTINCT url) AS n_available FROM c_evidence GROUP BY ALL) USING (run_id)""",
    "c_jobs": """SELECT run_id, 'job_' || substr(run_id, 5) AS job_id, e.run_id IS NOT NULL AS has_package,
        CASE WHEN e.run_id IS NULL THEN 'failed' WHEN coalesce(all_pass, true) THEN 'completed' WHEN any_review THEN 'review_required' ELSE 'completed' END AS status
      FROM c_requests LEFT JOIN (SELECT DISTINCT run_id FROM c_evidence) e USING (run_id)
      LEFT JOIN (SELECT run_id, bool_and(decision = 'pass') AS all_pass, bool_or(decision = 'review') AS any_review FROM c_rounds GROUP BY run_id) g USING (run_id)""",
    "c_scores": """SELECT run_id, coalesce(n, 0) AS n_units, coalesce(round_even(a, 3), 0.0) AS confidence, coalesce(round_even(b, 3), 0.0) AS coverage,
        coalesce(round_even(c, 3), 0.0) AS source_diversity FROM c_requests
      LEFT JOIN (SELECT run_id, count(*) AS n, avg(confidence) AS a, avg(coverage) AS b, avg(diversity) AS c FROM c_final GROUP BY run_id) USING (run_id)""",
    "c_stage": """SELECT 'job_' || l_orderkey AS run_id, ['discover', 'write', 'verify', 'publish'][l_linenumber % 4 + 1] AS stage,
        l_linenumber AS iteration, l_quantity::BIGINT AS seconds FROM lineitem""",
    "c_log": """SELECT 'job_' || user_id AS job_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'review_required'
        WHEN 'error' THEN 'failed' ELSE 'running' END AS status, CASE WHEN event_type <> 'error' THEN event_type END AS stage FROM events""",
    "c_tags": f"""SELECT run_id, id, tag, count(*) AS hits FROM (SELECT run_id, id, unnest({tokens('excerpt')}) AS term FROM c_evidence) JOIN c_terms USING (term) GROUP BY ALL""",
    "c_texts": "SELECT doc_id, lang, source, replace(text, chr(10), chr(10) || chr(10)) AS content FROM documents",
    "c_claim_reports": scored(tally("c_claims", "run_id, path, iteration, risk_profile")),
    "c_claim_gates": f"""SELECT *, {decision()} AS decision FROM (SELECT *, true AS density_ok FROM c_claim_reports JOIN c_gate USING (risk_profile))""",
}


def check_sql(body: str) -> str:
    """``body`` preceded by every named expression it needs, in dependency order."""
    done: list[str] = []

    def need(sql: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bc_[a-z_]+\b", sql)):
            if name in CTES and name not in done:
                need(CTES[name])
                if name not in done:
                    done.append(name)

    need(body)
    if not done:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in done) + "\n" + body
