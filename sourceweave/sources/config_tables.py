"""Policies, gate profiles and requests as typed tables with their defaults filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

MAX_SOURCES_DEFAULT = 50
DEFAULT_PROFILE = "medium"

# Profile, autopublish threshold, citations per paragraph, density ratio, iterations.
GATE_DEFAULTS = (
    ("low", 0.7, 1, 0.9, 2),
    ("medium", 0.85, 1, 0.9, 3),
    ("high", 0.95, 2, 0.9, 4),
)
# Fixed value: the settings of a profile that gives none.
GATE_FALLBACK = {
    "autopublish_threshold": 0.85,
    "min_citations_per_paragraph": 1,
    "min_citation_density_ratio": 0.9,
    "max_writer_iterations": 3,
}


def _texts(c) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _reputation(c: Column) -> Column:
    return F.struct(
        F.coalesce(c["require_peer_reviewed"], F.lit(False)).alias("require_peer_reviewed"),
        F.coalesce(c["require_primary_source"], F.lit(False)).alias("require_primary_source"),
        _texts(c["trusted_institutions"]).alias("trusted_institutions"),
        F.coalesce(c["block_marketing"], F.lit(True)).alias("block_marketing"),
    )


def _recency(c: Column) -> Column:
    return F.struct(
        c["max_age_days"].alias("max_age_days"),
        F.coalesce(c["prefer_recent"], F.lit(True)).alias("prefer_recent"),
    )


def read_policies(entries: DataFrame, order: str = "ord") -> DataFrame:
    """Policy entries (an ``ord`` column and the fields of ``schemas.POLICY_JSON``) -> one row per id.

    The entry with the highest ``ord`` wins; entries without an id are skipped.
    """
    fields = [c for c in entries.columns if c not in ("id", order)]
    last = (
        entries.filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max_by(F.struct(*fields), order).alias("p"))
    )
    p = F.col("p")

    def override(o: Column) -> Column:
        return F.struct(
            o["topic_pattern"].alias("topic_pattern"),
            _texts(o["domains_allow"]).alias("domains_allow"),
            _texts(o["domains_deny"]).alias("domains_deny"),
            F.when(o["reputation"].isNotNull(), _reputation(o["reputation"])).alias("reputation"),
            F.when(o["recency"].isNotNull(), _recency(o["recency"])).alias("recency"),
        )

    overrides = F.coalesce(
        F.transform(p["topic_overrides"], override), F.array().cast(f"array<{schemas.OVERRIDE}>")
    )
    return last.select(
        F.col("id").alias("policy_id"),
        F.coalesce(p["name"], F.col("id")).alias("name"),
        _texts(p["domains_allow"]).alias("domains_allow"),
        _texts(p["domains_deny"]).alias("domains_deny"),
        _reputation(p["reputation"]).alias("reputation"),
        _recency(p["recency"]).alias("recency"),
        F.coalesce(p["max_sources_per_run"], F.lit(MAX_SOURCES_DEFAULT)).alias("max_sources_per_run"),
        overrides.alias("topic_overrides"),
    )


def parse_policy_lines(lines: DataFrame, text: str = "value", order: str = "ord") -> DataFrame:
    """JSON texts, one policy each, -> policy entries; lines that do not parse get a null id."""
    return lines.select(order, F.from_json(text, schemas.POLICY_JSON).alias("p")).select(order, "p.*")


def read_policy_files(spark: SparkSession, folder: str) -> DataFrame:
    """Policy entries of a folder of JSON files, each one policy or a list of them, for :func:`read_policies`.

    Entries are ordered by file name, then by place in the file; files that do not parse are skipped.
    """
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(
        F.col("_metadata.file_name").alias("file"), F.trim("value").alias("text")
    )
    listed = F.when(F.startswith("text", F.lit("[")), F.col("text")).otherwise(F.concat(F.lit("["), "text", F.lit("]")))
    shape = T.ArrayType(T.StructType.fromDDL(schemas.POLICY_JSON))
    entries = files.select("file", F.posexplode(F.from_json(listed, shape)).alias("pos", "p"))
    return entries.select(F.struct("file", "pos").alias("ord"), "p.*")


def default_gate_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GATE_DEFAULTS), schemas.GATE_CONFIG)


def read_gate_config(custom: DataFrame) -> DataFrame:
    """Built-in profiles, overridden or extended by ``custom`` rows of the same columns.

    A custom row replaces a built-in profile whole; its missing fields take the general defaults.
    """
    mine = custom.select(
        "risk_profile", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in GATE_FALLBACK.items()]
    ).withColumn("given", F.lit(True))
    base = default_gate_profiles(custom.sparkSession)
    joined = base.alias("b").join(mine.alias("m"), "risk_profile", "full_outer")
    return joined.select(
        "risk_profile",
        *[F.when(F.col("m.given"), F.col(f"m.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in GATE_FALLBACK],
    )


def read_requests(raw: DataFrame) -> DataFrame:
    """Curation requests with defaults: audience general, risk profile medium, empty lists."""
    have = set(raw.columns)

    def col(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    return raw.select(
        "run_id",
        "topic",
        _texts(col("subtopics", "array<string>")).alias("subtopics"),
        _texts(col("paths", "array<string>")).alias("paths"),
        F.coalesce(col("audience", "string"), F.lit("general")).alias("audience"),
        col("constraints", schemas.CONSTRAINTS).alias("constraints"),
        "policy_id",
        col("taxonomy_id", "string").alias("taxonomy_id"),
        col("path_config_id", "string").alias("path_config_id"),
        F.coalesce(col("risk_profile", "string"), F.lit(DEFAULT_PROFILE)).alias("risk_profile"),
    )
