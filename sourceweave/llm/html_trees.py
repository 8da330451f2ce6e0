"""Main text of web pages: boosted trees over page nodes, then one consistent choice for the whole tree.

A page becomes a tree of block elements. Gradient-boosted trees judge each node by tag, attribute tokens, depth,
subtree density and siblings. The decoding picks, for all nodes at once, the most likely states under which nothing
inside a dropped subtree is kept: outside, inside the main text, or cut out of it.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("head script style noscript template svg iframe object math title canvas audio video select textarea".split())
#: Start tags that leave an open head open; any other closes it, unless it stands in a silent element of the head.
HEAD_TAGS = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
IN_HEAD = SILENT - {"head"}
#: A start tag of the key closes an open tag of the value, up to the nearest of the barriers.
BLOCK_STARTS = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"}}
BARRIERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}

GOOD = frozenset("article articlebody body content entry main page post story text prose blog hentry".split())
BAD = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disqus footer form header legal login masthead menu meta modal nav navbar navigation newsletter notice pager pagination popup promo promoted recommend related reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget".split()
)
TAG_GROUPS = [{"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "ul", "ol", "dl", "dt", "dd", "menu"}, {"div", "section", "span"}, {"article", "main"}, {"nav", "aside", "footer", "form", "dialog", "button", "label", "fieldset", "search"}, {"header"}, {"table", "tr", "td", "th", "tbody"}, {"pre", "blockquote", "figure", "figcaption"}]
FEATURES = 29

PAGES, TREES, DEPTH, SEED = 240, 20, 4, 11


class Page(HTMLParser):
    """The tree of block elements of a page, with the runs of text that each holds itself."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.tokens = ["#root"], [-1], [()]
        self.open: list[tuple[str, int]] = []
        self.at, self.silent, self.links = 0, 0, 0
        self.runs: list[tuple[int, list[str]]] = []
        self.own, self.linked = [0], [0]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent and tag not in HEAD_TAGS:
            self._close_open({"head"}, IN_HEAD)
        if tag in VOID:
            if tag == "br" and self.runs and self.runs[-1][0] == self.at:
                self.runs[-1][1].append(" ")
            elif tag == "hr":
                self._break()
            return
        if tag in BLOCK_STARTS:
            self._close_open({"p"}, {"button", "table", "td", "th", "article", "section", "div", "li", "blockquote"} if tag != "p" else {"button", "td", "th"})
        if tag in CLOSES:
            self._close_open(CLOSES[tag], BARRIERS[tag])
        if tag in INLINE:
            self.links += tag == "a"
            self.open.append((tag, -1))
            return
        self.silent += tag in SILENT
        words = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role", "itemprop"))
        self.open.append((tag, len(self.tag)))
        self.tag.append(tag)
        self.parent.append(self.at)
        self.tokens.append(tuple(re.sub(r"([a-z])([A-Z])", r"\1 \2", words).lower().replace("-", " ").replace("_", " ").split()))
        self.own.append(0)
        self.linked.append(0)
        self.at = len(self.tag) - 1
        self._break()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math"):
            self._pop(len(self.open) - 1)

    def _break(self) -> None:
        self.runs.append((self.at, []))

    def _pop(self, upto: int) -> None:
        while len(self.open) > upto:
            tag, node = self.open.pop()
            if node < 0:
                self.links -= tag == "a"
            else:
                self.silent -= tag in SILENT
                self.at = self.parent[node]
                self._break()

    def _close_open(self, tags: set[str], barriers: set[str]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                self._pop(i)
                return
            if self.open[i][0] in barriers:
                return

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                # an inline end tag does not close blocks
                if tag in INLINE and any(n >= 0 for _, n in self.open[i + 1 :]):
                    self.links -= tag == "a"
                    del self.open[i]
                else:
                    self._pop(i)
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self._pop(len(self.open) - 1)
        if self.silent:
            return
        if not self.runs or self.runs[-1][0] != self.at:
            self._break()
        self.runs[-1][1].append(data)
        size = len(data) if not data.isspace() else 0
        self.own[self.at] += size
        if self.links:
            self.linked[self.at] += size

    def blocks(self) -> list[tuple[int, str]]:
        """(node, text) of each run with text, white space as one space."""
        out = ((n, " ".join("".join(parts).split())) for n, parts in self.runs if parts)
        return [(n, t) for n, t in out if t]


def features(page: Page) -> np.ndarray:
    """One row for each node of the page."""
    n = len(page.tag)
    size, link, tags, depth, kids = list(page.own), list(page.linked), [1] * n, [0] * n, [0] * n
    nth, order = [0] * n, [0] * n
    same: dict[tuple[int, str], int] = {}
    paras = [1 if t == "p" else 0 for t in page.tag]
    for i in range(1, n):
        p = page.parent[i]
        depth[i] = depth[p] + 1
        nth[i] = kids[p]
        kids[p] += 1
        same[p, page.tag[i]] = same.get((p, page.tag[i]), 0) + 1
    seen = 0
    for i in range(n):
        order[i] = seen
        seen += page.own[i]
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        size[p] += size[i]
        link[p] += link[i]
        tags[p] += tags[i]
        paras[p] += paras[i]
    total = max(1, size[0])
    out = np.zeros((n, FEATURES), np.float64)
    good, bad, section, main = [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n):
        p = max(page.parent[i], 0)
        tag = page.tag[i]
        g = sum(t in GOOD for t in page.tokens[i])
        b = sum(t in BAD for t in page.tokens[i])
        side = tag in TAG_GROUPS[5]
        good[i], bad[i] = g or good[p], b or bad[p]
        section[i], main[i] = section[p] or side, main[p] or tag in TAG_GROUPS[4]
        row = out[i]
        for j, group in enumerate(TAG_GROUPS):
            row[j] = tag in group
        rest = size[p] - size[i]
        row[9:] = (
            g, b, good[i] > 0, bad[i] > 0, section[i], main[i],
            depth[i], nth[i], kids[p], same.get((page.parent[i], tag), 0) / max(1, kids[p]),
            min(page.own[i], 2000), size[i] / total, size[i] / tags[i], link[i] / max(1, size[i]),
            link[p] / max(1, size[p]), size[p] / total, rest / max(1, kids[p] - 1), order[i] / total,
            paras[i], paras[p],
        )
    return out


def _labelled_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page laid out at random, and the blocks of its main text. All text is invented letters."""

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzéäß") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(lo, hi)))

    def say(lo: int, hi: int) -> str:
        return words(lo, hi).capitalize() + "."

    def box(kind: str) -> str:
        names = {
            "nav": ["nav", "menu", "navbar", "main-menu", "site-nav"], "header": ["header", "site-header", "masthead", "topbar"],
            "footer": ["footer", "site-footer", "copyright", "legal"], "side": ["sidebar", "widget", "related", "recommended", "side"],
            "ad": ["ad", "ads", "advert", "promo", "sponsored", "banner"], "notice": ["cookie-notice", "notice", "consent", "alert-banner"],
            "form": ["newsletter", "subscribe", "login-form", "search"], "comments": ["comments", "comment-list", "discussion", "respond"],
        }[kind]
        tag = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind, rng.choice(["div", "section"]))
        tag = tag if rng.random() < 0.6 else "div"
        attr = f' {rng.choice(["class", "id"])}="{rng.choice(names)}"' if tag in ("div", "section") or rng.random() < 0.5 else ""
        links = "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(rng.randint(2, 8)))
        inner = {
            "nav": f"<ul>{links}</ul>", "header": f"<p>{words(1, 5)}</p>" if rng.random() < 0.5 else f"<h1>{words(1, 4)}</h1><ul>{links}</ul>",
            "footer": f"&copy; {words(1, 4)} &middot; {say(3, 14)}" if rng.random() < 0.5 else f"<p>{say(3, 14)}</p><ul>{links}</ul>",
            "side": f"<h3>{words(1, 3)}</h3>" + (f"<ul>{links}</ul>" if rng.random() < 0.5 else f"<p>{say(5, 30)}</p>"),
            "ad": say(3, 25) if rng.random() < 0.5 else f"<p>{say(3, 25)}</p>", "notice": f"<p>{say(5, 30)}</p><button>{words(1, 2)}</button>",
            "form": f"<label>{words(1, 4)}</label><input name='q'><button>{words(1, 2)}</button><p>{say(3, 12)}</p>",
            "comments": f"<h3>{words(1, 2)}</h3>" + "".join(f'<div class="comment"><p>{say(4, 60)}</p></div>' if rng.random() < 0.7 else f"<p>{say(4, 60)}</p>" for _ in range(rng.randint(1, 6))),
        }[kind]
        return f"<{tag}{attr}>{inner}</{tag}>"

    main: list[str] = []

    def block(tag: str, lo: int, hi: int) -> str:
        main.append(say(lo, hi))
        text = main[-1]
        if tag == "p" and rng.random() < 0.15:
            return f"<p><b>{text}<br>"
        if rng.random() < 0.1:
            cut = text.split(" ", 1)
            text = f'<a href="/x">{cut[0]}</a> {cut[1]}' if len(cut) > 1 else text
        return f"<{tag}>{text}</{tag}>"

    parts = [block("h1", 2, 12)] if rng.random() < 0.85 else []
    for _ in range(rng.randint(1, 14)):
        r = rng.random()
        if r < 0.7:
            parts.append(block("p", 1, 120))
        elif r < 0.78:
            parts.append(block(rng.choice(["h2", "h3"]), 1, 8))
        elif r < 0.85:
            parts.append("<ul>" + "".join(block("li", 1, 25) for _ in range(rng.randint(2, 5))) + "</ul>")
        elif r < 0.9:
            parts.append(block("blockquote", 5, 40))
        elif r < 0.93:
            parts.append("<table><tr>" + "".join(block("td", 1, 6) for _ in range(3)) + "</tr></table>")
        else:
            parts.append(box(rng.choice(["ad", "form", "side", "notice"])))
    if rng.random() < 0.2:
        parts.append(box("comments"))
    shell = rng.choice(["article", "article", "main", 'div class="content"', 'div class="post-body"', 'div id="main"', 'section class="entry"', "div", "div"])
    body = f"<{shell}>{''.join(parts)}</{shell.split()[0]}>"
    if rng.random() < 0.3:
        body = f'<div class="wrap">{body}</div>'
    before = "".join(box(k) for k in ("header", "nav", "notice", "ad", "side", "form") if rng.random() < 0.5)
    after = "".join(box(k) for k in ("comments", "side", "ad", "form", "footer") if rng.random() < 0.5)
    return f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title><script>var t='</p>';</script></head><body>{before}<!-- x -->{body}{after}</body></html>", main


def labelled_nodes(n_pages: int = PAGES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes with text on ``n_pages`` laid-out pages."""
    rng = random.Random(seed)
    rows, labels = [], []
    for _ in range(n_pages):
        html, main = _labelled_page(rng)
        page, wanted = Page(html), set(main)
        x = features(page)
        for node, text in page.blocks():
            rows.append(x[node])
            labels.append(float(text in wanted))
    return np.array(rows), np.array(labels)


class Trees:
    """The boosted trees as arrays, read off the fitted model's own description."""

    def __init__(self, described: str, weights: list[float]) -> None:
        self.weights, self.trees = weights, []
        for part in re.split(r"\n\s*Tree \d+ \(weight [^)]*\):\n", described)[1:]:
            lines = [(len(x) - len(x.lstrip()), x.strip()) for x in part.splitlines() if x.strip()]
            rows: list[list[float]] = []
            self._read(lines, 0, rows)
            self.trees.append(np.array(rows))

    def _read(self, lines: list[tuple[int, str]], at: int, rows: list[list[float]]) -> int:
        """Node rows (feature or -1, threshold or value, left, right) from line ``at``; gives the next line."""
        me = len(rows)
        text = lines[at][1]
        if text.startswith("Predict"):
            rows.append([-1, float(text.split(":")[1]), 0, 0])
            return at + 1
        feature, limit = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", text).groups()
        rows.append([int(feature), float(limit), me + 1, 0])
        at = self._read(lines, at + 1, rows)
        rows[me][3] = len(rows)
        return self._read(lines, at + 1, rows)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds that a node's text is main text."""
        total, every = np.zeros(len(x)), np.arange(len(x))
        for weight, tree in zip(self.weights, self.trees, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                feature = tree[at, 0].astype(np.int64)
                left = x[every, np.maximum(feature, 0)] <= tree[at, 1]
                at = np.where(feature < 0, at, np.where(left, tree[at, 2], tree[at, 3]).astype(np.int64))
            total += weight * tree[at, 1]
        return 2 * total


def fit(spark: SparkSession, n_pages: int = PAGES, seed: int = SEED) -> Trees:
    """Trees fitted on the nodes of ``n_pages`` labelled pages, which are laid out here: the tables hold no labelled page."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors

    x, y = labelled_nodes(n_pages, seed)
    rows = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, y, strict=True)], ["label", "features"]).coalesce(1).cache()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed).fit(rows)
    rows.unpersist()
    return Trees(model.toDebugString, list(model.treeWeights))


def decode(page: Page, margin: np.ndarray, change: float = 1.0) -> np.ndarray:
    """Which nodes lie in the main text, by the best consistent states of the whole tree.

    Children of a node in the main text are in it or cut out, children of a cut node are cut, children of an outside
    node are outside or begin main text. Each beginning and cut costs ``change``.
    """
    n = len(page.tag)
    weight = np.zeros(n)
    for node, text in page.blocks():
        weight[node] += min(4.0, 1.0 + len(text) / 100)
    gain = weight * np.clip(margin, -4, 4)
    inside, outside = gain.tolist(), [0.0] * n
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        inside[p] += max(inside[i], -change)
        outside[p] += max(outside[i], inside[i] - change)
    state = np.zeros(n, np.int8)
    state[0] = 1 if inside[0] - change > outside[0] else 0
    for i in range(1, n):
        above = state[page.parent[i]]
        if above == 1:
            state[i] = 1 if inside[i] >= -change else 2
        elif above == 0:
            state[i] = 1 if inside[i] - change > outside[i] else 0
        else:
            state[i] = 2
    return state == 1


def main_text(html: str | None, trees: Trees) -> str:
    page = Page(html or "")
    if not any(page.own):
        return ""
    kept = decode(page, trees.margin(features(page)))
    return "\n".join(t for n, t in page.blocks() if kept[n])


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html, any others).

    A null or empty html, and one without main text, gives an empty text. Repeated rows repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                some = batch.slice(a, 200)
                read = [Page(h or "") for h in some["html"].to_pylist()]
                rows = [features(p) for p in read]
                margins = np.split(trees.margin(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
                texts = []
                for page, margin in zip(read, margins, strict=True):
                    kept = decode(page, margin)
                    texts.append("\n".join(t for n, t in page.blocks() if kept[n]))
                yield pa.RecordBatch.from_arrays([some["page_id"], some["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
