import random
import re
import time

from pyspark.sql import functions as F

from sourceweave.functions import html as hx
from sourceweave.functions import json_text, text as t
from sourceweave.sources import crawl


def one(spark, column, **values):
    row = {k: v for k, v in values.items()}
    schema = ", ".join(f"{k} string" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema).select(column).first()[0]


def squeezed(s):
    return re.sub(r"\s", "", s)


def test_chunk_properties(spark):
    """No text is lost, short blocks stay whole, long ones are cut only between lines and no earlier than needed."""
    rnd = random.Random(7)
    limit = 30
    texts = ["", "\n\n", "short", "a\n\nb", "x" * 40 + "\n" + "y" * 5, "lead\n\n\n\ntail"]
    for _ in range(150):
        lines = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(1, 12))]
        texts.append("".join(line + rnd.choice(["\n", "\n\n", "\n\n\n"]) for line in lines))
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    for r in df.select("s", t.chunk(F.col("s"), limit).alias("c")).collect():
        assert squeezed("".join(r.c)) == squeezed(r.s)
        assert all(p and (len(p) <= limit or "\n" not in p) for p in r.c)
        blocks = [b.strip() for b in re.split(r"\n{2,}", r.s) if b.strip()]
        rest = list(r.c)
        for b in blocks:
            mine = [rest.pop(0)]
            while "\n".join(mine) != b:
                mine.append(rest.pop(0))
            assert len(mine) == 1 or len(b) > limit
            assert all(len(p) + 1 + len(q.split("\n")[0]) > limit for p, q in zip(mine, mine[1:]))


def test_chunk_keeps_all_text(spark):
    text = "\n".join(f"line {i} " + "z" * (i * 7 % 90) for i in range(200))
    pieces = one(spark, t.chunk(F.col("s"), 100), s=text)
    assert re.sub(r"\s", "", "".join(pieces)) == re.sub(r"\s", "", text)


def test_netloc_keeps_port_and_user(spark):
    urls = {
        "https://User@Example.GOV:443/x?y#z": "user@example.gov:443",
        "//host/path": "host",
        "no-scheme.org/x": "",
        "http://": "",
        "https://a.b?q=//c": "a.b",
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.d for r in df.select("u", t.netloc(F.col("u")).alias("d")).collect()} == urls


def test_strip_is_unicode_aware(spark):
    assert one(spark, t.strip(F.col("s")), s=" \x1c a b  \n") == "a b"


def test_html_to_text(spark):
    html = (
        "<html><head><title>A &amp; B</title><style>p{}</style></head><body><nav><a>menu</a></nav><!-- note -->"
        '<script>var t="</p>";</script><div class="ad">buy</div><p>One<br>two</p><P>5 &lt; 6</P><footer>foot</footer></body></html>'
    )
    assert one(spark, hx.html_to_text(F.col("h")), h=html) == "One\n\ntwo\n\n5 < 6"
    assert one(spark, hx.html_title(F.col("h")), h=html) == "A & B"


def page_text(spark, *pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string")
    return [r.x for r in df.select("i", hx.html_to_text(F.col("h")).alias("x")).orderBy("i").collect()]


def test_pages_of_very_many_tags(spark):
    n = 100_000
    advert, deep = '<div class="ad">' + "<p>x</p>" * n + "</div>after", '<div class="ad">' + "<div>x" * n + "</div>" * n + "</div>after"
    open_, adverts = '<div class="ad">' * n + "text", '<div class="ad">x</div>' * n + "after"
    scripts, comments, spaces = "<script>" * n + "x", "<!--" * n + "x", "a" + " " * n + "b"
    start = time.time()
    got = page_text(spark, advert, deep, open_, adverts, scripts, comments, spaces, "<nav>" * n + "x</nav>y", "<p>" * n, "a" + "\t\n" * n + "b")
    assert got == ["after", "after", "text", "after", "", "", spaces, "y", "", "a\n\nb"]
    assert time.time() - start < 60


def test_blocks_that_are_not_closed(spark):
    got = page_text(
        spark, '<div class="ad">x<p>text', "a<nav>b", "a<nav>b</nav>c<nav>d", "a<nav>b<nav>c</nav>d", "a<script>b", "a<!-- b", "a<!-- b <!-- c --> d", None, "",
        '<DIV class="ad">x<div class="ad">y</div>z</DIV>a<div>b</div><div class="ad">c</div', "a</div>b<div class=\"ad\">c</div>d",
    )
    assert got == ["x\n\ntext", "ab", "a cd", "a d", "a", "a", "a  d", None, "", "a\n\nb\n\nc</div", "a\n\nb d"]


def test_parse_iso(spark):
    cases = {"2024-01-15T00:00:00Z": True, "2024-01-15": True, "2024": False, "not a date": False, "2024-13-45": False}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r.c: r.ok for r in df.select("c", t.parse_iso(F.col("c")).isNotNull().alias("ok")).collect()} == cases


def test_citations(spark):
    text = "a [ev:ev_1] b [ev_2] c [other] d [ev:ev_3, ev:ev_4]"
    assert one(spark, t.citation_ids(F.col("s")), s=text) == ["ev_1", "ev_2", "ev_3, ev:ev_4"]
    assert one(spark, t.citation_count(F.col("s")), s=text) == 3


def test_extract_json(spark):
    cases = {
        '{"a": 1}': '{"a": 1}',
        '  {"a": 1}\r\n': '{"a": 1}',
        'text\n```json\n{"a": 1}\n```\nmore': '{"a": 1}',
        'text\n```\n{"a": 2}\n```': '{"a": 2}',
        'see {"a": {"b": 3}} end': '{"a": {"b": 3}}',
        '```json\n{"a":1}\n```\n```json\n{"b":2}\n```': None,
        '```json\nbroken {"a":1}\n```': None,
        '[{"a": 1}]': None,
        "plain words": None,
        '{"a": 1': None,
        '{"a": 1}] {}': None,
        "": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r.c: r.j for r in df.select("c", json_text.extract_json(F.col("c")).alias("j")).collect()} == cases


def test_pages_with_entities_bare_signs_and_nested_blocks(spark):
    html = (
        '<html><head><title>A &amp; B</title><meta name="author" content="Jo &eacute;"><meta content="2024-05-06T07:08:09Z" property="article:published_time"></head>'
        "<body><header>Top</header><p>Caf&eacute; &#8217;tis &#x2014; a < b and c > d &unknown; &amp;lt;</p>"
        '<div class="ad">buy <div>now</div> more</div><p>end</p></body></html>'
    )
    df = spark.createDataFrame([(html, "u")], "html string, url string")
    text = df.select(hx.html_to_text(F.col("html"))).first()[0]
    assert text == "Top\n\nCafé ’tis — a < b and c > d &unknown; &lt;\n\nend"
    row = crawl.read_crawl(crawl.pages_as_fetches(df)).first()
    assert (row.title, row.author, row.published_date) == ("A & B", "Jo é", "2024-05-06T07:08:09Z")


def test_token_counts(spark):
    df = spark.createDataFrame([("b a b A c",), ("",), (None,)], "s string")
    rows = df.select(t.token_counts(F.col("s")).alias("c")).collect()
    assert [(x.token, x.n) for x in rows[0].c] == [("a", 2), ("b", 2), ("c", 1)] and rows[1].c == [] and rows[2].c is None


def test_trimming_runs_no_pattern_and_takes_what_python_strips(spark):
    spaces = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    rows = [(x,) for c in spaces for x in (c, f"{c}a{c}b\U0001f600{c}{c}", f"\u200b{c}")] + [("",), ("\U0001f600",)]
    df = spark.createDataFrame(rows, "x string").select("x", t.strip(F.col("x")).alias("s"), t.is_blank(F.col("x")).alias("b"))
    assert all(r.s == r.x.strip() and r.b == (r.x.strip() == "") for r in df.collect())
    assert "regexp_replace" not in df._jdf.queryExecution().executedPlan().toString()
