"""Verification: parsing judge reports, recounting them, and a rule-based judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scores
from ..functions import text as t
from ..functions.json_text import extract_json
from .drafts import UNIT_KEYS

COUNTS = ["supported", "unsupported", "uncited", "leakage", "conflicts", "gaps_acknowledged"]
EMPTY_NOTE = "The draft is empty, so there is nothing to check"
UNPARSED_NOTE = "The report held no JSON object and needs a check by hand"
CLAIM_KEYS = [*UNIT_KEYS, "para_pos", "sent_pos"]
GAP_PATTERN = r"^\[INSUFFICIENT EVIDENCE"
OVERLAP = 0.6


def with_scores(reports: DataFrame) -> DataFrame:
    """Add ``confidence`` and ``pass_rate`` from the counts."""
    n = {c: F.col(c) for c in [*COUNTS, "total_claims"]}
    return reports.withColumn(
        "confidence",
        scores.confidence(n["supported"], n["gaps_acknowledged"], n["leakage"], n["conflicts"], n["total_claims"]),
    ).withColumn("pass_rate", scores.pass_rate(n["supported"], n["gaps_acknowledged"], n["total_claims"]))


def parse_reports(responses: DataFrame) -> DataFrame:
    """Judge responses -> report rows. Declared counts are taken as given, missing ones are 0, a missing
    total is the number of claims; an unparsable response scores 0 with a note."""
    keep = [c for c in responses.columns if c != "response"]
    r = responses.withColumn("_json", extract_json(F.col("response"))).withColumn(
        "_p", F.from_json("_json", schemas.REPORT_JSON)
    )
    p, ok = F.col("_p"), F.col("_json").isNotNull()
    no_ids = F.array().cast("array<string>")
    claims = F.transform(
        F.coalesce(p["claims"], F.array()),
        lambda c: F.struct(
            F.coalesce(c["claim"], F.lit("")).alias("claim"),
            F.coalesce(c["citation_ids"], no_ids).alias("citation_ids"),
            F.coalesce(c["assessment"], F.lit("")).alias("assessment"),
            F.coalesce(c["explanation"], F.lit("")).alias("explanation"),
            F.coalesce(c["suggestion"], F.lit("")).alias("suggestion"),
        ),
    )
    contradictions = F.transform(
        F.coalesce(p["contradictions"], F.array()),
        lambda c: F.struct(F.coalesce(c["topic"], F.lit("")).alias("topic"), F.coalesce(c["evidence_ids"], no_ids).alias("evidence_ids")),
    )
    s = p["summary"]
    parsed = r.select(
        *keep,
        claims.alias("claims"),
        F.coalesce(s["total_claims"], F.size(claims).cast("bigint")).alias("total_claims"),
        *[F.coalesce(s[c], F.lit(0)).cast("bigint").alias(c) for c in COUNTS],
        contradictions.alias("contradictions"),
        F.when(ok, F.coalesce(p["overall_feedback"], F.lit(""))).otherwise(UNPARSED_NOTE).alias("overall_feedback"),
        ok.alias("structured"),
    )
    return with_scores(parsed)


def explode_claims(reports: DataFrame) -> DataFrame:
    return reports.select(*UNIT_KEYS, F.posexplode("claims").alias("claim_pos", "c")).select(*UNIT_KEYS, "claim_pos", "c.*")


def explode_contradictions(reports: DataFrame) -> DataFrame:
    return reports.select(*UNIT_KEYS, F.explode("contradictions").alias("c")).select(*UNIT_KEYS, "c.*")


def tally_claims(claims: DataFrame, keys: list[str] = UNIT_KEYS) -> DataFrame:
    """Counts per assessment, recounted from the claims themselves."""
    per_kind = [
        F.count_if(F.col("assessment") == label).alias(column) for label, column in schemas.ASSESSMENTS.items()
    ]
    return claims.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_claims"), *per_kind)


def tally_audit(declared: DataFrame, claims: DataFrame) -> DataFrame:
    """Units whose declared summary differs from the recount, with both totals."""
    names = ["total_claims", *COUNTS]
    real = tally_claims(claims)
    d = declared.select(*UNIT_KEYS, *[F.col(c).alias(f"declared_{c}") for c in names])
    joined = d.join(real, UNIT_KEYS, "left").fillna(0, names)
    differ = F.lit(False)
    for c in names:
        differ = differ | (F.col(c) != F.col(f"declared_{c}"))
    return joined.filter(differ)


def empty_report(units: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports of all units: empty content gets a zero report with a note."""
    note = F.when(F.coalesce("content", F.lit("")) == "", EMPTY_NOTE)
    joined = units.select(*UNIT_KEYS, "content").join(reports, UNIT_KEYS, "left")
    return joined.select(
        *UNIT_KEYS,
        *[F.when(note.isNull(), F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint").alias(c) for c in ["total_claims", *COUNTS]],
        F.coalesce(note, F.lit("")).alias("overall_feedback"),
    )


def split_claims(units: DataFrame) -> DataFrame:
    """Sentences of a draft as claims, with the ids they cite.

    Headings are skipped and markers taken out of the wording. A sentence without a marker of its own
    takes the markers of its paragraph. A paragraph that states a gap is one claim.
    """
    paras = units.select(*UNIT_KEYS, F.posexplode(t.paragraphs(F.col("content"))).alias("para_pos", "para")).filter(
        ~F.startswith("para", F.lit("#"))
    )
    gap = F.col("para").rlike(GAP_PATTERN)
    # ids of the paragraph first: taken beside the sentences, they would be sought in the whole paragraph for each of them
    marked = paras.select(*UNIT_KEYS, "para_pos", "para", gap.alias("is_gap"), t.citation_ids(F.col("para")).alias("_para_ids"))
    cut = marked.select(
        *UNIT_KEYS, "para_pos", "is_gap", "_para_ids",
        F.posexplode(F.when(F.col("is_gap"), F.array("para")).otherwise(t.sentences(F.col("para")))).alias("sent_pos", "sentence"),
    )
    own = t.citation_ids(F.col("sentence"))
    return cut.select(
        *CLAIM_KEYS,
        t.strip(F.regexp_replace("sentence", t.CITATION_PATTERN, "")).alias("claim"),
        F.array_distinct(F.when(F.size(own) > 0, own).otherwise(F.col("_para_ids"))).alias("cited_ids"),
        "is_gap",
    ).filter("claim <> ''")


def evidence_facts(evidence: DataFrame) -> DataFrame:
    """What the rules ask of each excerpt: its distinct words and figures, and its figures in context.

    Worth a written table where the same evidence is asked again, as in rewrite rounds.
    """
    text = F.col("excerpt")
    return evidence.select(
        "run_id", F.col("id").alias("evidence_id"),
        F.array_distinct(t.tokens(text)).alias("_words"),
        F.array_distinct(t.numbers(text)).alias("_figures"),
        F.when(text.rlike("[0-9]"), figure_contexts(text)).alias("_contexts"),
    )


def disputed_claims(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Keys of the claims with a figure for which their cited excerpts give different values in one context.

    Contexts meet on (run, excerpt, context), so only those that a claim speaks of are looked up; values are counted,
    never paired.
    """
    asked = claims.filter(F.col("claim").rlike("[0-9]")).select(*CLAIM_KEYS, F.explode("cited_ids").alias("evidence_id"), figure_contexts(F.col("claim")).alias("c"))
    asked = asked.select(*CLAIM_KEYS, "evidence_id", F.explode("c.context").alias("context")).distinct()
    told = facts.select("run_id", "evidence_id", F.explode("_contexts").alias("c")).select("run_id", "evidence_id", "c.*").distinct()
    met = asked.join(told, ["run_id", "evidence_id", "context"])
    values = met.groupBy(*CLAIM_KEYS, "context").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return values.filter("lo < hi").select(*CLAIM_KEYS).distinct()


def rule_verify(claims: DataFrame, evidence: DataFrame, overlap: float = OVERLAP, facts: DataFrame | None = None) -> DataFrame:
    """Judge each claim by rules: cited, resolvable, numbers known, sources at one, enough shared words.

    A number that no excerpt of the run holds is leakage; one on which the cited excerpts disagree is a conflict. The
    rules stand in for a model judge: the same categories, other judgements. ``facts``: :func:`evidence_facts` of
    ``evidence``, if they are at hand.
    """
    words = F.array_distinct(t.tokens(F.col("claim")))
    figures = F.array_distinct(t.numbers(F.col("claim")))
    known = evidence_facts(evidence) if facts is None else facts
    pairs = claims.select(
        *CLAIM_KEYS, words.alias("words"), figures.alias("figures"), F.explode("cited_ids").alias("evidence_id")
    ).join(known.select("run_id", "evidence_id", "_words", "_figures"), ["run_id", "evidence_id"])
    support = pairs.groupBy(*CLAIM_KEYS).agg(
        F.count(F.lit(1)).alias("n_resolved"),
        F.max(F.size(F.array_intersect("words", "_words"))).alias("n_shared"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.array_intersect("figures", "_figures"))))).alias("n_figures_found"),
    )
    run_figures = known.select("run_id", F.explode("_figures").alias("figure")).distinct()
    foreign = (
        claims.select(*CLAIM_KEYS, F.explode(figures).alias("figure"))
        .join(run_figures, ["run_id", "figure"], "left_anti")
        .groupBy(*CLAIM_KEYS)
        .agg(F.count(F.lit(1)).alias("n_foreign"))
    )
    disputed = disputed_claims(claims, known).withColumn("disputed", F.lit(True))
    j = claims.join(support, CLAIM_KEYS, "left").join(foreign, CLAIM_KEYS, "left").join(disputed, CLAIM_KEYS, "left")
    n_words, n_figures = F.size(words), F.size(figures)
    verdict = (
        F.when(F.col("is_gap"), "gap_acknowledged")
        .when(F.size("cited_ids") == 0, "uncited")
        .when(F.col("n_resolved").isNull(), "unsupported")
        .when(F.col("n_foreign").isNotNull(), "leakage")
        .when(F.col("disputed"), "conflict")
        .when((F.col("n_figures_found") < n_figures) | (F.col("n_shared") < n_words * F.lit(overlap)), "unsupported")
        .otherwise("supported")
    )
    return j.select(*CLAIM_KEYS, "claim", "cited_ids", verdict.alias("assessment"))


#: Words on each side of a figure that make up its context, and how many of them there must be.
AROUND, LEAST_WORDS = 3, 4


def figure_contexts(text: Column) -> Column:
    """(context, value) for each number and each place of its context, lower case.

    A context is the words around the number, which reads ``#`` as any other number does, with one of its places
    blotted out (``*``). So two numbers whose surroundings differ in one word at most share a context exactly.
    """
    parts = F.regexp_extract_all(F.lower(text), F.lit(rf"{t.NUMBER_PATTERN}|\p{{L}}+"), F.lit(0))
    number = lambda x: x.rlike("^[0-9]")
    places = [k for k in range(-AROUND, AROUND + 1) if k]

    def around(words: Column, i: Column) -> Column:
        at = lambda k: F.coalesce(F.when(i + k >= 0, F.get(words, i + k)), F.lit(""))
        return F.array(*[F.when(number(at(k)), "#").otherwise(at(k)) for k in places])

    def blotted(context: Column, value: Column) -> Column:
        place = lambda out: F.array_join(F.array(*[F.lit("*" if k == out else "#") if k in (0, out) else F.get(context, F.lit(places.index(k))) for k in range(-AROUND, AROUND + 1)]), " ")
        enough = F.size(F.filter(context, lambda w: ~w.isin("", "#"))) >= LEAST_WORDS
        every = F.array(*[F.named_struct(F.lit("context"), place(k), F.lit("value"), value) for k in places])
        return F.when(enough, every).otherwise(F.filter(every, lambda x: F.lit(False)))

    def found(words: Column) -> Column:
        at = F.filter(F.transform(words, lambda x, i: F.when(number(x), i)), lambda i: i.isNotNull())
        return F.flatten(F.transform(at, lambda i: t.bind(around(words, i), lambda c: blotted(c, F.get(words, i)))))

    return t.bind(parts, found)


def numeric_conflicts(rows: DataFrame, scope: list[str], text: str = "excerpt") -> DataFrame:
    """Contexts in which excerpts of one scope give different numbers. Groups are counted, not paired."""
    with_digits = rows.filter(F.col(text).rlike("[0-9]"))  # a cheap test spares most texts the pattern below
    found = with_digits.select(*scope, "id", F.explode(figure_contexts(F.col(text))).alias("f")).select(*scope, "id", "f.*")
    # one row per distinct value first, so that a hot context arrives pre-aggregated
    per_value = found.groupBy(*scope, "context", "value").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_value.groupBy(*scope, "context")
        .agg(
            F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n_mentions"),
            F.min("value").alias("least"), F.max("value").alias("greatest"),
        )
        .filter("n_values > 1")
    )


def attach_scores(units: DataFrame, reports: DataFrame) -> DataFrame:
    """Units with confidence and coverage of their report; diversity stays.

    A declared total below the holding claims would push coverage over 1: it is clamped and flagged.
    """
    r = reports.select(*UNIT_KEYS, F.col("confidence").alias("_c"), F.col("pass_rate").alias("_p"))
    return (
        units.join(r, UNIT_KEYS)
        .withColumn("coverage_clamped", F.col("_p") > 1)
        .withColumn(
            "scores",
            F.struct(
                F.col("_c").alias("confidence"), scores.clamp(F.col("_p")).alias("coverage"),
                F.col("scores.source_diversity").alias("source_diversity"),
            ),
        )
        .drop("_c", "_p")
    )
