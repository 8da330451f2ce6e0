import math
import random
import statistics

import plans
import pytest
from pyspark.sql import functions as F

from sourceweave.operators import discovery as d
from sourceweave.operators import package as pk
from sourceweave.operators import ranking as rk
from sourceweave.operators import style as st
from sourceweave.operators import tagging as tg
from sourceweave.operators import vector_index as vi


def test_style_metrics(spark):
    text = "Furthermore, we delve into it. It is robust.\n\nOne two three. One two three four five six seven.\n\nOne apples, pears and plums."
    df = spark.createDataFrame([(1, text), (2, "")], "id int, content string")
    a, b = sorted(st.style_metrics(df).collect(), key=lambda r: r.id)
    assert (a.n_markers, a.n_formulaic, a.n_paragraphs, a.n_triples) == (2, 1, 3, 1)
    spreads = [statistics.stdev([5, 3]), statistics.stdev([3, 7])]
    assert abs(a.burstiness - sum(spreads) / 2) < 1e-6 and a.n_even == 2
    assert a.structure_repeat == 0.5
    assert (b.n_words, b.n_markers, b.type_token_ratio, b.burstiness, b.structure_repeat) == (0, 0, None, None, None)


def test_spread_that_is_just_the_limit_is_not_even(spark):
    """Sentence lengths whose sample deviation is 4 exactly; sums of squared differences give 3.9999999999999996."""
    lengths = [3, 5, 6, 4, 11, 13, 12, 11, 4]
    df = spark.createDataFrame([(" ".join("w " * (n - 1) + "w." for n in lengths),)], "content string")
    row = st.burstiness(df).first()
    assert (row.burstiness, row.n_even) == (4.0, 0)


def test_repeated_ngrams(spark):
    df = spark.createDataFrame([(1, "a b c a b c a b"), (2, "x y")], "id int, content string")
    got = [(r.id, r.ngram, r.n) for r in st.repeated_ngrams(df, ["id"], 3, 5).orderBy("rank").collect()]
    assert got == [(1, "a b c", 2), (1, "b c a", 2), (1, "c a b", 2)]


def test_excess_words(spark):
    df = spark.createDataFrame([(True, "new new old"), (False, "old old old old")], "s boolean, content string")
    got = {r.word: (r.n_slice, r.n_base, r.ratio) for r in st.excess_words(df, F.col("s")).collect()}
    assert got == {"new": (2, 0, None), "old": (1, 4, 0.3333)}


def test_tags_roll_up(spark):
    ev = spark.createDataFrame([("r", "e1", "The cat and the dog"), ("r", "e2", "le chat")], "run_id string, id string, excerpt string")
    terms = spark.createDataFrame([("en", "the"), ("en", "and"), ("fr", "le")], "tag string, term string")
    tree = spark.createDataFrame([("en", "west"), ("west", "all"), ("fr", "all"), ("all", None)], "tag string, parent string")
    tags = tg.tag_evidence(ev, terms, ["run_id", "id"])
    assert sorted((r.id, r.tag, r.hits) for r in tags.collect()) == [("e1", "en", 3), ("e2", "fr", 1)]
    up = tg.roll_up_tags(tags, tree, ["id"])
    assert sorted((r.id, r.tag, r.hits) for r in up.collect()) == [("e1", "all", 3), ("e1", "en", 3), ("e1", "west", 3), ("e2", "all", 1), ("e2", "fr", 1)]


def test_relevance_cap_falls_back_to_length(spark):
    ev = spark.createDataFrame([("a", 1, 10), ("a", 2, 99), ("b", 3, 10), ("b", 4, 99)], "run_id string, id int, n_chars int")
    sims = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.1)], "run_id string, id int, similarity double")
    assert sorted(r.id for r in rk.relevance_cap(ev, sims, 1).collect()) == [1, 4]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    x, y = [r[0] for r in df.select(rk.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(x - 0.5**0.5) < 1e-12 and y is None


def test_list_jobs_pages(spark):
    rows = [(f"j{i}", "completed" if i % 2 else "failed", "Topic", "p", f"2024-01-{i % 5 + 1:02d}") for i in range(20)]
    jobs = spark.createDataFrame(rows, "job_id string, status string, topic string, policy_id string, d string").withColumn("created_at", F.col("d").cast("timestamp"))
    seen, after = [], None
    while True:
        page = pk.list_jobs(jobs, status="failed", after=after, limit=3).collect()
        if not page:
            break
        seen += [r.job_id for r in page]
        after = (str(page[-1].created_at), page[-1].job_id)
    assert sorted(seen) == sorted(r[0] for r in rows if r[1] == "failed")


def test_bottleneck(spark):
    rows = [("j", "write", "p", 1, "2024-01-01 00:00:00", "2024-01-01 00:00:30"), ("j", "verify", "p", 1, "2024-01-01 00:01:00", "2024-01-01 00:02:30")]
    df = spark.createDataFrame(rows, "run_id string, stage string, path string, iteration int, a string, b string").select(
        "run_id", "stage", "path", "iteration", F.col("a").cast("timestamp").alias("started_at"), F.col("b").cast("timestamp").alias("completed_at")
    )
    r = pk.stage_durations(df, ["discover", "write", "verify"]).first()
    assert (r.discover, r.write, r.verify, r.total, r.bottleneck, r.bottleneck_share) == (0, 30, 90, 120, "verify", 0.75)


def test_cyclic_taxonomy_is_refused(spark):
    tree = spark.createDataFrame([("a", "b"), ("b", "a")], "tag string, parent string")
    with pytest.raises(ValueError):
        tg.tag_closure(tree)


def near_by_hand(rows, asked, k):
    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)) if a and b else 0
        return round(sum(x * y for x, y in zip(a, b)) / n, 6) if n else None

    out = {}
    for q in asked:
        scored = sorted(((cos(rows[q], v) is None, -(cos(rows[q], v) or 0), i) for i, v in rows.items()))
        out[q] = [i for _, _, i in scored[:k]]
    return out


def test_indexed_search(spark, tmp_path):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = {i: [c + rng.gauss(0, 0.4) for c in centres[i % 12]] for i in range(600)} | {600: [0.0] * 16, 601: None, 602: [1.0] * 16, 603: [1.0] * 16}
    vectors = spark.createDataFrame([(i, v, "x" if i % 2 else "y") for i, v in rows.items()] + [(None, [1.0] * 16, "x")], "id long, embedding array<double>, kind string")
    index = vi.build(vectors, str(tmp_path / "index"), 16, ("kind",), lists=12)
    assert index.rows.count() == len(rows)
    asked = vectors.filter("id % 50 = 0").select(F.col("id").alias("query"), "embedding")
    exact = vi.search(index, asked, 10)
    got = {q: [r.id for r in sorted((r for r in exact.collect() if r["query"] == q), key=lambda r: r["rank"])] for q in range(0, 601, 50)}
    assert got == near_by_hand(rows, range(0, 601, 50), 10)
    some = vi.search(index, asked.where("query < 600"), 10, probes=3)
    hits = sum(len(set(got[q]) & {r.id for r in some.collect() if r["query"] == q}) for q in range(0, 600, 50))
    assert hits >= 0.9 * 120
    odd = vi.search(index, asked, 10, keep=F.col("kind") == "x")
    assert {r.id % 2 for r in odd.collect()} == {1}
    for df in (exact, some, odd):
        text = plans.text_of(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "PartitionFilters: [isnotnull(kind" in plans.text_of(odd)


def test_search_multiplies_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vi, "BLOCK", 16)
    monkeypatch.setattr(vi, "ASKED", 3)
    rng = random.Random(4)
    some = [[float(rng.randint(-2, 2)) for _ in range(4)] for _ in range(25)]  # many equal similarities and copies
    rows = {i: rng.choice(some) for i in range(300)} | {300: [0.0] * 4, 301: None}
    vectors = spark.createDataFrame(list(rows.items()), "id long, embedding array<double>")
    found = vi.search(vi.build(vectors, str(tmp_path / "index"), 4, lists=3), vectors.where("id % 20 = 0").select(F.col("id").alias("query"), "embedding"), 7)
    assert "CoGroups" in plans.text_of(found)
    got = {q: [r.id for r in sorted((r for r in found.collect() if r["query"] == q), key=lambda r: r["rank"])] for q in range(0, 301, 20)}
    assert got == near_by_hand(rows, range(0, 301, 20), 7)
    odd = spark.createDataFrame([(1, [float("nan"), 1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [1.0])], "query long, embedding array<double>")
    found = vi.search(vi.build(odd, str(tmp_path / "odd"), 2, lists=1), asked, 2).collect()
    assert sorted((r["query"], r["rank"], r.id) for r in found) == [(7, 1, 1), (7, 2, 2), (8, 1, 1), (8, 2, 2)]


def test_index_of_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    index = vi.build(none, str(tmp_path / "none"), 4)
    assert vi.search(index, none.withColumnRenamed("id", "query"), 3).count() == 0
    with pytest.raises(Exception, match="components"):
        vi.build(spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>"), str(tmp_path / "bad"), 4)


def test_index_recall_on_the_sample(spark):
    from sourceweave.plans import catalogue

    sf = "/root/testdata/sf0.1"
    exact, some = ({(r["query"], r.id) for r in catalogue.run(n, spark, sf).collect()} for n in ("knn_queries", "knn_index"))
    assert len(exact & some) >= 0.9 * len(exact)


def test_wrong_vector_length_is_an_error(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0])], "label string, embedding array<float>")
    with pytest.raises(Exception, match="components"):
        rk.topic_vectors(df, ["label"], 2).collect()


def test_closure_of_a_deep_chain_takes_few_steps(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(tg, "counted", lambda df, name, f=tg.counted: steps.append(name) or f(df, name))
    chain = spark.createDataFrame([(f"t{i}", f"t{i - 1}" if i else None) for i in range(1001)], "tag string, parent string")
    closed = tg.tag_closure(chain)
    assert len(steps) <= 12 and closed.count() == 1001 * 1002 // 2
    assert closed.where("distance = 1000").select("tag", "ancestor").collect() == [("t1000", "t0")]


def test_closure_of_several_ways_up(spark):
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), (None, "a")], "tag string, parent string").where("tag IS NOT NULL")
    got = {(r.tag, r.ancestor): r.distance for r in tg.tag_closure(tree).collect()}
    assert got == {(x, x): 0 for x in "abcd"} | {("b", "a"): 1, ("c", "b"): 1, ("c", "a"): 1, ("d", "c"): 1, ("d", "b"): 2, ("d", "a"): 2}
    with pytest.raises(ValueError, match="cycle"):
        tg.tag_closure(spark.createDataFrame([(f"x{i}", f"x{(i + 1) % 9}") for i in range(9)], "tag string, parent string"))


# --- plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_inside_the_row_do_not_shuffle(spark):
    df = spark.createDataFrame([("u", "a b c a b c")], "k string, content string")
    assert "Exchange" not in plan(st.repeated_ngrams(df, ["k"]))
    assert [(r.ngram, r.n, r["rank"]) for r in st.repeated_ngrams(df, ["k"]).collect()] == [("a b c", 2, 1)]


def test_ranks_are_cut_before_the_shuffle(spark):
    rows = spark.range(100_000).selectExpr("id % 7 AS run_id", "id AS page_pos", "id AS source_rank", "id AS n_chars")
    assert plan(d.cap_total(rows, 2_000)).count("WindowGroupLimit") >= 2


def test_no_python_and_no_cross_product_in_the_batch_plans(spark):
    df = spark.createDataFrame([("r", "u", 0, 0, "x", "h")], "run_id string, url string, page_pos int, chunk_pos int, excerpt string, excerpt_hash string")
    text = plan(d.cap_evidence(df))
    assert "Python" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
