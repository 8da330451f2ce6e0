import random

import numpy as np
import plans
import pytest
from pyspark.sql import functions as F

from sourceweave.functions import quality as q
from sourceweave.operators import discovery as d
from sourceweave.operators import joins
from sourceweave.operators.joins import contains_join
from sourceweave.plans import evidence_run
from sourceweave.session import staged
from sourceweave.sources import config_tables as cfg

TEXTS = "array<string>"


def passes(spark, url, allow=(), deny=(), strict=False):
    df = spark.createDataFrame([(url, list(allow), list(deny))], "u string, a array<string>, d array<string>")
    from sourceweave.functions.text import netloc

    return df.select(d.passes_policy(netloc(F.col("u")), F.col("a"), F.col("d"), strict)).first()[0]


@pytest.mark.parametrize(
    "url,allow,deny,expected",
    [
        ("https://example.com/a", [], [], True),
        ("https://spam.com/a", [], ["spam.com"], False),
        ("https://notmedium.com/a", [], ["medium.com"], False),
        ("https://a.gov/x", [".gov"], [], True),
        ("https://a.com/x", [".gov"], [], False),
        ("https://bad.gov/x", [".gov"], ["bad.gov"], False),
        ("https://EXAMPLE.com", ["Example.COM"], [], True),
        ("not a url", [], [], False),
    ],
)
def test_policy(spark, url, allow, deny, expected):
    assert passes(spark, url, allow, deny) is expected


def test_strict_policy_wants_whole_labels(spark):
    assert passes(spark, "https://notmedium.com", (), ("medium.com",), True)
    assert not passes(spark, "https://x.medium.com", (), ("medium.com",), True)


def requests(spark, rows):
    return cfg.read_requests(spark.createDataFrame(rows, "run_id string, topic string, subtopics array<string>, policy_id string"))


def policies(spark, *texts):
    return cfg.read_policies(cfg.parse_policy_lines(spark.createDataFrame(list(enumerate(texts)), "ord int, value string")))


def test_build_queries(spark):
    rows = d.build_queries(requests(spark, [("r", "Sleep", ["apnea", "naps"], "p"), ("s", "Tea", [], "p")])).collect()
    assert sorted((r.run_id, r.query_pos, r["query"]) for r in rows) == [
        ("r", 0, "Sleep"), ("r", 1, "Sleep apnea"), ("r", 2, "Sleep naps"), ("s", 0, "Tea")
    ]


def test_policy_defaults_and_last_entry_wins(spark):
    rows = {r.policy_id: r for r in policies(spark, '{"id": "a", "name": "old"}', "not json", '{"id": "a"}', '{"id": "b", "recency": {"max_age_days": 9}}').collect()}
    assert set(rows) == {"a", "b"}
    a = rows["a"]
    assert (a.name, a.domains_allow, a.max_sources_per_run) == ("a", [], 50)
    assert a.reputation.block_marketing is True and a.recency.prefer_recent is True and a.topic_overrides == []
    assert rows["b"].recency.max_age_days == 9


def test_first_matching_override_is_layered(spark):
    text = (
        '{"id": "p", "domains_allow": ["x.org"], "topic_overrides": ['
        '{"topic_pattern": "^sleep", "domains_allow": ["y.org"], "domains_deny": ["z.org"], "recency": {"max_age_days": 3}},'
        '{"topic_pattern": "sleep", "domains_allow": ["never.org"]}]}'
    )
    got = {
        r.run_id: r for r in d.resolve_policy(requests(spark, [("r", "SLEEP well", [], "p"), ("s", "Other", [], "p")]), policies(spark, text)).collect()
    }
    assert got["r"].domains_allow == ["x.org", "y.org"] and got["r"].domains_deny == ["z.org"] and got["r"].recency.max_age_days == 3
    assert got["s"].domains_allow == ["x.org"] and got["s"].override is None


def test_quality_signals(spark):
    df = spark.createDataFrame(
        [("https://pubmed.ncbi.nlm.nih.gov/1", "text", ""), ("https://x.edu:8080/a", "Buy NOW " + "a" * 10, "t"), ("https://who.int/a", "b" * 1995 + "sponsored", "")],
        "url string, md string, title string",
    )
    rows = df.select(q.source_quality(F.col("url"), F.col("md"), F.col("title"), F.array(F.lit("WHO.int"))).alias("s")).collect()
    assert [tuple(r.s) for r in rows] == [
        (True, True, "institutional", False), (False, False, "unknown", True), (False, False, "trusted", True)
    ]


def test_marketing_looks_at_whole_text_and_title(spark):
    df = spark.createDataFrame([("x" * 5000 + "affi", "liate"), ("y" * 5000 + "sponsored", None)], "md string, title string")
    assert all(r[0] for r in df.select(q.is_marketing(F.col("md"), F.col("title"))).collect())
    assert not df.select(q.is_marketing(F.col("md"), F.col("title"), 2000)).collect()[1][0]


def excerpts(spark, rows):
    return spark.createDataFrame(rows, "run_id string, url string, page_pos int, chunk_pos int, excerpt string").withColumn(
        "excerpt_hash", F.sha2("excerpt", 256)
    )


def test_caps(spark):
    rows = [("r", f"u{s}", s, i, "x" * (60 + i) + f"{s}-{i}") for s in range(3) for i in range(10)]
    rows.append(("r", "u9", 9, 0, rows[0][4]))  # a copy of the first excerpt
    df = excerpts(spark, rows)
    kept = d.cap_evidence(df, 5, 100).collect()
    assert len(kept) == 15 and {r.chunk_pos for r in kept} == {5, 6, 7, 8, 9}
    assert [r.chunk_pos for r in sorted(kept, key=lambda r: r.ev_pos)][:5] == [9, 8, 7, 6, 5]
    total = d.cap_evidence(df, 5, 4).collect()
    assert [(r.page_pos, r.chunk_pos) for r in sorted(total, key=lambda r: r.ev_pos)] == [(0, 9), (1, 9), (2, 9), (0, 8)]


def test_caps_leave_small_runs_in_document_order(spark):
    df = excerpts(spark, [("r", "u", 0, i, "y" * (90 - i)) for i in (2, 0, 1)])
    assert [r.chunk_pos for r in sorted(d.cap_evidence(df, 5, 100).collect(), key=lambda r: r.ev_pos)] == [0, 1, 2]


def test_caps_do_not_depend_on_partitioning(spark):
    rows = [("r", f"u{i % 7}", i % 7, i // 7, "w" * (50 + i * 13 % 40)) for i in range(140)]
    df = excerpts(spark, rows)
    a = sorted((r.page_pos, r.chunk_pos, r.ev_pos) for r in d.cap_evidence(df.repartition(1), 3, 10).collect())
    b = sorted((r.page_pos, r.chunk_pos, r.ev_pos) for r in d.cap_evidence(df.repartition(13), 3, 10).collect())
    assert a == b


def pages(spark, rows):
    return spark.createDataFrame(
        [(u, s, ti, "", p, m) for u, s, ti, p, m in rows],
        "url string, status_code int, title string, author string, published_date string, markdown string",
    )


def discovery(spark, reqs, pol, pgs, **settings):
    at = F.lit("2024-01-01").cast("timestamp")
    return evidence_run.Discovery(reqs, pol, pgs, at, 50, evidence_run.DiscoverySettings(**settings), stage=lambda df, name: df)


def test_full_discovery(spark):
    body = "Sleep therapy helps many people to rest well at night, as trials show."
    other = "A second paragraph about sleep that is long enough to be kept as evidence."
    pgs = pages(spark, [
        ("https://a.edu/1", 200, "T", "2024-01-15T00:00:00Z", f"# Sleep\n\n{body}\n\nshort\n\n{other}"),
        ("https://b.com/2", 404, "", "bad date", body),
        ("https://spam.com/3", 200, "", "", body),
        ("https://c.org/4", 0, "", "", "Sleep"),
    ])
    reqs = requests(spark, [("r", "sleep", [], "p")])
    f = discovery(spark, reqs, policies(spark, '{"id": "p", "domains_deny": ["spam"]}'), pgs)
    rows = sorted(f.evidence.collect(), key=lambda r: r.ev_pos)
    assert sorted(r.excerpt for r in rows) == sorted([body, other])
    # b.com holds the query once, a.edu more often: a.edu comes first and keeps the shared excerpt
    assert {r.url for r in rows} == {"https://a.edu/1"}
    assert {r.locator for r in rows} == {"chunk:1", "chunk:3"}
    assert rows[0].published_at.year == 2024 and rows[0].title == "T" and rows[0].author is None
    assert rows[0].source_quality.domain_reputation == "institutional"


def test_search_needs_every_term_and_ranks_by_count(spark):
    pgs = pages(spark, [
        ("u1", 200, "", "", "cat dog"), ("u2", 200, "", "", "cat cat dog"), ("u3", 200, "", "", "cat"), ("u4", 200, "dog", "", "CAT"),
    ])
    found = d.candidates_by_search(d.build_queries(requests(spark, [("r", "cat dog", ["emu"], "p")])), pgs)
    assert [(r.query_pos, r.url, r.score) for r in sorted(found.collect(), key=lambda r: r.result_pos)] == [(0, "u2", 3), (0, "u1", 2), (0, "u4", 2)]


def test_source_limit(spark):
    pgs = pages(spark, [(f"https://h{i}.com/", 200, "", "", "sleep " * 20 + str(i)) for i in range(10)])
    f = discovery(spark, requests(spark, [("r", "sleep", [], "p")]), policies(spark, '{"id": "p", "max_sources_per_run": 2}'), pgs)
    assert f.sources.count() == 2


@pytest.mark.parametrize("in_row", [0, joins.IN_ROW])
def test_contains_join_equals_brute_force(spark, monkeypatch, in_row):
    monkeypatch.setattr(joins, "IN_ROW", in_row)
    texts = ["abcdef", "xabc", "", "zzz", "Ünïcode abc", "ab", "aaaa", "emoji 😀 face", "new\nline"]
    needles = ["abc", "a", "zz", "ïcod", "abcdefg", "cdef", "", "aaa", "😀 f", "w\nl", "bcdef"]
    # keys that are null or repeat
    keys = [None if i % 4 == 0 else i // 2 for i in range(len(texts))]
    a = spark.createDataFrame(list(zip(keys, texts, strict=True)), "i int, s string")
    b = spark.createDataFrame(list(enumerate(needles)), "j int, p string")
    rows = contains_join(a, F.col("s"), b, F.col("p"), ["i"]).collect()
    expected = [(k, j) for k, s in zip(keys, texts, strict=True) for j, p in enumerate(needles) if p and p in s]
    assert sorted((str(r.i), r.j) for r in rows) == sorted((str(k), j) for k, j in expected)


def test_contains_join_of_long_texts_in_one_file(spark):
    """Occurrences across block borders are found once, and the texts of one partition are dealt out to more tasks."""
    texts = ["x" * k + "needle in hay" + "y" * (700 - k) for k in range(230, 290)] + ["needle " * 200, "😀" * 250 + "needle in hay"]
    a = spark.createDataFrame(list(enumerate(texts)), "i int, s string").coalesce(1)
    needles = ["needle in hay", "needle", "x" * 256, "y" * 40, "😀needle"]
    b = spark.createDataFrame(list(enumerate(needles)), "j int, p string")
    met = contains_join(a, F.col("s"), b, F.col("p"), ["i"])
    assert sorted((r.i, r.j) for r in met.collect()) == sorted((i, j) for i, s in enumerate(texts) for j, p in enumerate(needles) if p in s)
    assert "RoundRobinPartitioning" in plans.text_of(met)


def test_a_text_is_gone_through_once_whatever_the_patterns(spark):
    """No row for a place of a text, and no join with the pieces of all texts however many patterns there are."""
    a = spark.createDataFrame([(i, f"text {i} has words") for i in range(50)], "i int, s string")
    b = spark.range(60_000).selectExpr("id AS j", "concat(id, ' has') AS p")
    met = joins.containing(a, F.col("s"), b.select(F.col("p").alias("_pattern")), ["i"])
    plan = plans.text_of(met)
    assert sorted((r.i, r._pattern) for r in met.collect()) == sorted({(i, f"{str(i)[k:]} has") for i in range(50) for k in range(len(str(i))) if str(int(str(i)[k:])) == str(i)[k:]})
    assert "Generate" not in plan and "Join" not in plan and plan.count("MapInArrow") == 1


def test_needles_are_found_as_by_hand(monkeypatch):
    monkeypatch.setattr(joins, "PLACES", 7)
    rng = random.Random(2)
    for _ in range(100):
        letters = rng.choice(["ab", "abc😀é", "a", "xyz "])
        word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n))).encode()
        needles, texts = sorted({word(rng.choice([3, 12, 30])) for _ in range(30)} - {b""}), [word(60) for _ in range(12)]
        rows, which = joins._Needles(needles).pairs(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        assert list(zip(rows, which, strict=True)) == [(i, j) for i, text in enumerate(texts) for j, x in enumerate(needles) if x in text]


def test_policy_folder(spark, tmp_path):
    files = {
        "a.json": '{"id": "x", "name": "first"}',
        "b.json": '[{"id": "y"}, {"id": "x", "name": "second"}]',
        "c.json": "not json {",
        "d.yaml": '{"id": "z"}',
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows = cfg.read_policies(cfg.read_policy_files(spark, str(tmp_path))).collect()
    assert {r.policy_id: r.name for r in rows} == {"x": "second", "y": "y"}


def test_repeat_fetches_never_grow_the_evidence(spark):
    text = "\n\n".join(f"paragraph {i} " + "word " * 20 for i in range(3))
    rows = [("https://a.com/", 200, "", "", text), ("https://a.com/", 200, "", "", text + " newer"), ("https://a.com/", 0, "", "", "")]
    plan = spark.createDataFrame([("r", "https://a.com/", 0)], "run_id string, url string, pos int")
    attached = d.attach_pages(plan, pages(spark, rows))
    assert [r.markdown for r in attached.collect()] == [text + " newer"]
    found = d.extract_evidence(attached, F.current_timestamp())
    assert found.count() == 3 and d.cap_evidence(found.union(found), 5, 2).count() == 2


def test_pages_meet_the_plan_where_they_are_scanned(spark):
    rows = [(f"https://a.com/{i % 50}", 200, "", "", f"text {i} " * 30) for i in range(2000)]
    corpus = staged(pages(spark, rows), "t-pages")
    plan = spark.createDataFrame([("r", f"https://a.com/{i}", i) for i in range(40, 60)], "run_id string, url string, pos int")
    attached = d.attach_pages(plan, corpus)
    found = plans.above(attached, "markdown")
    assert found
    for ops in found:
        first = next(i for i, o in enumerate(ops) if o.startswith("BroadcastHashJoin"))
        assert not any(o.startswith(("Exchange", "Sort")) for o in ops[:first])
    got = {r.url: (r.status_code, r.markdown) for r in attached.collect()}
    longest = {f"https://a.com/{k}": max((r[4] for r in rows if r[0] == f"https://a.com/{k}"), key=len) for k in range(40, 50)}
    assert {u: len(m) for u, (_, m) in got.items() if m} == {u: len(m) for u, m in longest.items()}
    assert all(got[f"https://a.com/{k}"] == (0, "") for k in range(50, 60))


def test_unknown_policies_are_reported(spark):
    asked = requests(spark, [("r", "sleep", [], "p"), ("s", "sleep", [], "absent")])
    rows = d.unknown_policy(asked, policies(spark, '{"id": "p"}')).collect()
    assert [(r.run_id, r.message) for r in rows] == [("s", "Unknown policy: absent")]


def test_search_shuffles_no_row_for_a_query_and_page(spark, monkeypatch):
    pages = spark.createDataFrame(
        [(f"u{n}", "tea time", " ".join(["tea"] * (n % 7) + ["cup"] * (n % 3) + ["milk"] * (n % 5 == 0))) for n in range(60)] + [("u1", "", "cup cup"), (None, "tea", "cup milk")],
        "url string, title string, markdown string",
    )
    asked = d.build_queries(requests(spark, [("r", "tea", ["cup", "milk", "cup milk", "tea", "none", "--"], "p"), ("s", "--", [], "p")]))
    found = d.candidates_by_search(asked, pages, 4, staged)
    rows = sorted(map(tuple, found.collect()))
    # above the look-up in the page's terms, the first exchange is that of the ranked rows
    up = plans.text_of(d._hits_in_row(*_index_and_entry(spark))).split("Exchange")
    assert len(up) == 3 and "BroadcastExchange" in plans.text_of(d._hits_in_row(*_index_and_entry(spark)))
    monkeypatch.setattr(d, "IN_ROW", 0)
    assert rows == sorted(map(tuple, d.candidates_by_search(asked, pages, 4, staged).collect()))
    assert len(rows) == 4 * 6 and {r[3] for r in rows} <= {f"u{n}" for n in range(60)}


def _index_and_entry(spark):
    index = staged(spark.createDataFrame([("u", "tea", 1), ("u", "cup", 2), ("v", "tea", 3)], "url string, term string, tf long"), "t-index")
    return index, staged(spark.createDataFrame([("tea cup", "cup", ["tea", "cup"])], "query string, term string, terms array<string>"), "t-entry")
