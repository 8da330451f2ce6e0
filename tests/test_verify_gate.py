import json

import plans
import pytest
from pyspark.sql import functions as F

from sourceweave.operators import drafts as dr
from sourceweave.operators import gate as g
from sourceweave.operators import package as pk
from sourceweave.operators import verify as v
from sourceweave.sources import config_tables as cfg

KEYS = "run_id string, path string, iteration int"


def reports(spark, rows):
    cols = "total_claims bigint, supported bigint, gaps_acknowledged bigint, leakage bigint, conflicts bigint, unsupported bigint, uncited bigint"
    data = [(f"r{i}", "p", 1, *r) for i, r in enumerate(rows)]
    return v.with_scores(spark.createDataFrame(data, f"{KEYS}, {cols}"))


@pytest.mark.parametrize(
    "counts,confidence",
    [((10, 8, 2, 0, 0), 1.0), ((10, 7, 1, 2, 0), 0.56), ((10, 8, 2, 0, 1), 0.9), ((10, 7, 1, 1, 1), 0.612), ((10, 0, 0, 10, 5), 0.0), ((0, 0, 0, 0, 0), 0.0)],
)
def test_confidence(spark, counts, confidence):
    assert reports(spark, [(*counts, 0, 0)]).first().confidence == pytest.approx(confidence)


def test_pass_rate_is_not_clamped_but_coverage_is(spark):
    r = reports(spark, [(2, 3, 1, 0, 0, 0, 0)])
    assert r.first().pass_rate == 2.0
    units = spark.createDataFrame([("r0", "p", 1, (0.0, 0.0, 0.5))], f"{KEYS}, scores struct<confidence:double,coverage:double,source_diversity:double>")
    row = v.attach_scores(units, r).first()
    assert (row.scores.coverage, row.scores.source_diversity, row.coverage_clamped) == (1.0, 0.5, True)


def test_parse_reports(spark):
    full = {
        "claims": [{"claim": "a", "citation_ids": ["ev_1"], "assessment": "supported"}, {"assessment": "uncited"}],
        "summary": {"supported": 1, "uncited": 1},
        "contradictions": [{"topic": "t"}],
    }
    rows = [("r0", "p", 1, json.dumps(full)), ("r1", "p", 1, "no json"), ("r2", "p", 1, "[1]")]
    got = {r.run_id: r for r in v.parse_reports(spark.createDataFrame(rows, f"{KEYS}, response string")).collect()}
    a = got["r0"]
    assert (a.total_claims, a.supported, a.uncited, a.leakage, a.confidence) == (2, 1, 1, 0, 0.5)
    assert a.claims[1].claim == "" and a.claims[1].citation_ids == [] and a.contradictions[0].evidence_ids == []
    for k in ("r1", "r2"):
        assert not got[k].structured and got[k].confidence == 0.0 and got[k].overall_feedback == v.UNPARSED_NOTE


def gate(spark, content, counts, iteration=1, profile="medium"):
    r = reports(spark, [counts]).withColumn("iteration", F.lit(iteration))
    units = spark.createDataFrame([("r0", "p", iteration, content, profile)], f"{KEYS}, content string, risk_profile string")
    return g.evaluate(units, r, cfg.default_gate_profiles(spark)).first()


LONG = " ".join(["word"] * 20)
CITED = LONG + " [ev:ev_1]"


@pytest.mark.parametrize(
    "content,counts,iteration,decision",
    [
        (CITED, (10, 9, 1, 0, 0, 0, 0), 1, "pass"),
        (CITED, (10, 10, 0, 1, 0, 0, 0), 1, "fail"),  # leakage never passes
        (CITED, (10, 5, 0, 0, 0, 5, 0), 1, "fail"),
        (CITED, (10, 5, 0, 0, 0, 5, 0), 3, "review"),
        (CITED, (10, 5, 0, 0, 0, 0, 0), 1, "review"),  # nothing to fix
        (LONG, (10, 10, 0, 0, 0, 0, 0), 1, "review"),
        ("", (10, 10, 0, 0, 0, 0, 0), 1, "review"),
    ],
)
def test_decisions(spark, content, counts, iteration, decision):
    row = gate(spark, content, counts, iteration)
    assert row.decision == decision
    assert (row.should_publish, row.should_rewrite, row.needs_human) == (decision == "pass", decision == "fail", decision == "review")


def test_feedback(spark):
    row = gate(spark, LONG, (10, 2, 0, 1, 2, 3, 4), 3)
    lines = row.feedback.split("\n")
    assert [line.split(" ")[0] for line in lines] == ["3", "4", "1", "2", "Citations:", "Iteration"]
    assert "0%" in lines[4] and "90%" in lines[4]
    assert gate(spark, CITED, (10, 10, 0, 0, 0, 0, 0)).feedback == g.NO_ISSUES


@pytest.mark.parametrize(
    "content,ratio",
    [
        (f"# Head\n\n{CITED}\n\n{LONG}\n\nshort one", 0.5), ("short", 1.0), ("# " + LONG, 1.0), ("", 0.0),
        (LONG + " [ev_1]", 1.0), (f"{LONG} [ev:a] [ev:b]\n\n{LONG}\n\n{LONG}", 1 / 3),
    ],
)
def test_density(spark, content, ratio):
    assert gate(spark, content, (1, 1, 0, 0, 0, 0, 0)).density_ratio == pytest.approx(ratio)


def test_unknown_profile_takes_medium(spark):
    row = gate(spark, CITED, (1, 1, 0, 0, 0, 0, 0), profile="unheard")
    assert (row.autopublish_threshold, row.max_writer_iterations) == (0.85, 3)


def test_gate_config_merge(spark):
    custom = spark.createDataFrame([("low", 0.5, None, None, None), ("tiny", None, 5, None, 1)], "risk_profile string, autopublish_threshold double, min_citations_per_paragraph int, min_citation_density_ratio double, max_writer_iterations int")
    rows = {r.risk_profile: tuple(r)[1:] for r in cfg.read_gate_config(custom).collect()}
    assert rows == {"low": (0.5, 1, 0.9, 3), "tiny": (0.85, 5, 0.9, 1), "medium": (0.85, 1, 0.9, 3), "high": (0.95, 2, 0.9, 4)}


EV = [("r", "ev_1", 1, "http://a", "The cat sat on 12 mats."), ("r", "ev_2", 2, "http://b", "Dogs bark at 7 cats.")]


def evidence(spark):
    return spark.createDataFrame(EV, "run_id string, id string, ev_pos int, url string, excerpt string")


def test_rule_judge(spark):
    text = (
        "# Title\n\nThe cat sat on 12 mats. [ev:ev_1]\n\nThe cat sat on 99 mats. [ev:ev_1]\n\nThe cat sat on 7 mats. [ev:ev_1]\n\n"
        "Nothing cited here.\n\nDogs bark. [ev:ev_9]\n\nEntirely other words were used. [ev:ev_2]\n\n[INSUFFICIENT EVIDENCE: birds]"
    )
    units = spark.createDataFrame([("r", "p", 1, text)], f"{KEYS}, content string")
    got = {r.para_pos: r.assessment for r in v.rule_verify(v.split_claims(units), evidence(spark)).collect()}
    assert got == {1: "supported", 2: "leakage", 3: "unsupported", 4: "uncited", 5: "unsupported", 6: "unsupported", 7: "gap_acknowledged"}


def test_drafts_from_responses(spark):
    answer = {
        "content": "text [ev:ev_1]", "citations_used": ["ev_2", "ev_9", "ev_1", "ev_1"],
        "evidence_map": [{"claim": "c", "evidence_ids": ["ev_9"]}, {"claim": "", "evidence_ids": ["ev_1"]}, {"claim": "d", "evidence_ids": ["ev_2", "ev_9", "ev_1"]}],
    }
    rows = [("r", "p", 1, "Sure:\n```json\n" + json.dumps(answer) + "\n```"), ("r", "q", 1, " just text ")]
    drafts = dr.parse_drafts(spark.createDataFrame(rows, f"{KEYS}, response string"))
    units = {u.path: u for u in dr.build_units(drafts, evidence(spark)).collect()}
    p, q = units["p"], units["q"]
    assert [tuple(c) for c in p.citations] == [("ev_2", "http://b"), ("ev_1", "http://a"), ("ev_1", "http://a")]
    assert [(m.claim, m.evidence_ids) for m in p.evidence_map] == [("c", []), ("d", ["ev_2", "ev_1"])]
    assert p.scores.source_diversity == 1.0 and p.gaps == []
    assert (q.content, q.citations, q.gaps) == ("just text", [], [dr.RAW_TEXT_GAP])
    assert [r.evidence_id for r in dr.dangling_citations(drafts, evidence(spark)).collect()] == ["ev_9"]


def test_apply_model_sees_every_prompt(spark):
    prompts = spark.range(100).selectExpr("'r' AS run_id", "CAST(id AS STRING) AS path", "1 AS iteration", "CAST(id AS STRING) AS prompt")
    out = dr.apply_model(prompts, lambda texts: [s + "!" for s in texts]).collect()
    assert {r.response for r in out} == {f"{i}!" for i in range(100)}


def test_job_status(spark):
    runs = spark.createDataFrame([(c,) for c in "abcde"], "run_id string")
    gates = spark.createDataFrame([("a", "pass"), ("b", "fail"), ("b", "review"), ("c", "fail"), ("c", "pass")], "run_id string, decision string")
    failed = spark.createDataFrame([("e", "boom")], "run_id string, message string")
    got = {r.run_id: r.status for r in pk.job_status(runs, gates, failed).collect()}
    assert got == {"a": "completed", "b": "review_required", "c": "completed", "d": "completed", "e": "failed"}


def test_package_scores_without_units(spark):
    runs = spark.createDataFrame([("a",)], "run_id string")
    units = spark.createDataFrame([], "run_id string, scores struct<confidence:double,coverage:double,source_diversity:double>")
    assert tuple(pk.package_scores(runs, units).first()) == ("a", 0, 0.0, 0.0, 0.0)


def claim_rows(spark, rows):
    return spark.createDataFrame([("r", "p", 1, i, 0, c, ids, False) for i, (c, ids) in enumerate(rows)], "run_id string, path string, iteration int, para_pos int, sent_pos int, claim string, cited_ids array<string>, is_gap boolean")


def test_cited_excerpts_that_disagree_on_a_figure_are_a_conflict(spark):
    said = "A survey of the region counted {} visitors on the main site."
    excerpts = [("a", said.format("1,200")), ("b", said.format("1300").replace("region", "county")), ("c", said.format("1300").replace("visitors", "cars").replace("region", "county")), ("d", said.format("1300"))]
    excerpts = [(i, t.replace(",", "")) for i, t in excerpts] + [("e", None), ("f", "Only 1200 words.")]
    evidence = spark.createDataFrame([("r", i, t) for i, t in excerpts], "run_id string, id string, excerpt string")
    claims = claim_rows(spark, [
        (said.format(1200), ["a", "d"]),  # the same words, two values
        (said.format(1200), ["a", "b"]),  # one word differs
        (said.format(1200), ["a", "c"]),  # two words differ
        (said.format(1200), ["a"]),
        (said.format(1300), ["b", "d"]),  # one value
        ("The survey covers a region with a main site.", ["a", "d"]),  # speaks of no figure
        (said.format(1200), ["a", "d", "e", "gone"]),
        (said.format(77), ["a", "d"]),
    ])
    got = {r.para_pos: r.assessment for r in v.rule_verify(claims, evidence).collect()}
    assert got == {0: "conflict", 1: "conflict", 2: "supported", 3: "supported", 4: "supported", 5: "supported", 6: "conflict", 7: "leakage"}
    assert {r.para_pos: r.assessment for r in v.rule_verify(claims, evidence, facts=v.evidence_facts(evidence)).collect()} == got
    assert v.tally_claims(v.rule_verify(claims, evidence)).first().conflicts == 3
    assert v.rule_verify(claims.limit(0), evidence).count() == 0 == v.disputed_claims(claims, v.evidence_facts(evidence.limit(0))).count()


def test_contexts_blot_out_one_place_each(spark):
    df = spark.createDataFrame([("One two three 4 five six 7.5 eight",), ("1 2 3",), ("x 5",), (None,)], "s string")
    got = [r.c for r in df.select(v.figure_contexts(F.col("s")).alias("c")).collect()]
    assert [(x.context, x.value) for x in got[0]][:2] == [("* two three # five six #", "4"), ("one * three # five six #", "4")]
    assert [x.value for x in got[0]] == ["4"] * 6 and got[1:3] == [[], []] and got[3] is None


def test_many_figures_in_one_excerpt_are_counted_not_paired(spark):
    text = " ".join(f"on the way we met {i} people there" for i in range(3000))
    evidence = spark.createDataFrame([("r", "a", text)], "run_id string, id string, excerpt string")
    claims = claim_rows(spark, [("We know that on the way we met 12 people there.", ["a"])])
    assert v.rule_verify(claims, evidence).first().assessment == "conflict"
    assert "NestedLoop" not in plans.text_of(v.disputed_claims(claims, v.evidence_facts(evidence)))


def test_a_paragraph_is_not_carried_along_with_its_sentences(spark):
    """A paragraph of many sentences would cost its length for each of them."""
    units = spark.createDataFrame([("r", "p", 1, "One here. Two [ev:b]. Three.[ev:a]\n\n[INSUFFICIENT EVIDENCE: x. y]")], "run_id string, path string, iteration int, content string")
    found = v.split_claims(units)
    rows = sorted((r.para_pos, r.sent_pos, r.claim, r.cited_ids, r.is_gap) for r in found.collect())
    assert (rows[0][2], rows[0][4], rows[-1][0], rows[-1][4]) == ("One here.", False, 1, True) and set(rows[0][3]) == {"a", "b"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "para#" not in plan.split("Generate")[0]  # nothing above the sentences reads the paragraph
