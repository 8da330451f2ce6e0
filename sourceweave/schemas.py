"""Declared row types of the data model (DDL strings usable in reads, casts and ``from_json``)."""

CONSTRAINTS = (
    "struct<date_from:string,date_to:string,domains_allow:array<string>,"
    "domains_deny:array<string>,jurisdiction:string>"
)
REQUEST = (
    "run_id string, topic string, subtopics array<string>, paths array<string>, audience string, "
    f"constraints {CONSTRAINTS}, policy_id string, taxonomy_id string, path_config_id string, risk_profile string"
)

REPUTATION = (
    "struct<require_peer_reviewed:boolean,require_primary_source:boolean,"
    "trusted_institutions:array<string>,block_marketing:boolean>"
)
RECENCY = "struct<max_age_days:int,prefer_recent:boolean>"
OVERRIDE = (
    "struct<topic_pattern:string,domains_allow:array<string>,domains_deny:array<string>,"
    f"reputation:{REPUTATION},recency:{RECENCY}>"
)
POLICY_JSON = (
    f"id string, name string, domains_allow array<string>, domains_deny array<string>, reputation {REPUTATION}, "
    f"recency {RECENCY}, max_sources_per_run int, topic_overrides array<{OVERRIDE}>"
)
POLICY = POLICY_JSON.replace("id string", "policy_id string", 1)

CRAWL = (
    "url string, status_code int, title string, author string, published_date string, "
    "markdown string, raw_html string, metadata map<string,string>"
)
SOURCE_QUALITY = (
    "struct<is_peer_reviewed:boolean,is_primary_source:boolean,domain_reputation:string,conflict_of_interest:boolean>"
)
EVIDENCE = (
    "run_id string, id string, url string, title string, author string, published_at timestamp, "
    "retrieved_at timestamp, excerpt string, excerpt_hash string, locator string, "
    f"source_quality {SOURCE_QUALITY}"
)
EVIDENCE_COLUMNS = [
    "run_id", "id", "url", "title", "author", "published_at", "retrieved_at",
    "excerpt", "excerpt_hash", "locator", "source_quality",
]

CITATIONS = "array<struct<evidence_id:string,url:string>>"
CLAIM_MAP = "array<struct<claim:string,evidence_ids:array<string>>>"
SCORES = "struct<confidence:double,coverage:double,source_diversity:double>"
LINEAGE = (
    "struct<policy_id:string,taxonomy_id:string,path_config_id:string,run_id:string,engine_version:string>"
)
UNIT = (
    "run_id string, path string, iteration int, unit_id string, content string, "
    f"citations {CITATIONS}, evidence_map {CLAIM_MAP}, scores {SCORES}, lineage {LINEAGE}"
)

DRAFT_JSON = f"content string, citations_used array<string>, evidence_map {CLAIM_MAP}, gaps array<string>"
REPORT_JSON = (
    "claims array<struct<claim:string,citation_ids:array<string>,assessment:string,explanation:string,suggestion:string>>, "
    "summary struct<total_claims:bigint,supported:bigint,unsupported:bigint,uncited:bigint,leakage:bigint,"
    "conflicts:bigint,gaps_acknowledged:bigint>, overall_feedback string, "
    "contradictions array<struct<topic:string,evidence_ids:array<string>>>"
)

GATE_CONFIG = (
    "risk_profile string, autopublish_threshold double, min_citations_per_paragraph int, "
    "min_citation_density_ratio double, max_writer_iterations int"
)
STAGE_EVENT = "run_id string, stage string, path string, iteration int, started_at timestamp, completed_at timestamp"

#: assessment label -> count column, in report order (fixed values)
ASSESSMENTS = {
    "supported": "supported",
    "unsupported": "unsupported",
    "uncited": "uncited",
    "leakage": "leakage",
    "conflict": "conflicts",
    "gap_acknowledged": "gaps_acknowledged",
}
