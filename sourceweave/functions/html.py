"""HTML expressions on whole pages.

No pattern repeats a group, since Java's matcher recurses there and a page of many tags would end the executor; blocks
are cut out by splitting at their tags instead. Every step is linear in the length of the page, unclosed blocks included.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, bind, strip, unescape

#: Elements whose content is no text: the first run to the end of the page if nothing closes them, as in browsers.
CODE, AROUND = ("script", "style"), ("head", "nav", "footer")
BLOCK_TAG = r"(?i)</?(?:p|br|h[1-6]|ul|ol|li|div|tr|table|article|section|header|blockquote)(?:\s[^>]*)?/?>"
TAG = r"<[/!]?[A-Za-z][^>]*>"
DIV, DIV_END, ADVERT = r"(?i)^<div[\s>]", r"(?i)^</div\s*>", r'(?i)^<div class="ad"'
BLANK_RUNS = rf"(?<![ \t])[ \t]*\n[{SPACE}]*\n[{SPACE}]*"
CHUNK = 256


def running(items: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Integer states of a fold over ``items`` that starts from 0, one for each item.

    A list that grows in a fold is copied at each step, so states are gathered in chunks.
    """

    def state(last: Column, done: Column) -> Column:
        return F.struct(last.cast("int").alias("last"), done.alias("done"))

    def add(acc: Column, item: Column) -> Column:
        return bind(step(acc["last"], item), lambda s: state(s, F.concat(acc["done"], F.array(s.cast("int")))))

    def add_chunk(acc: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, state(acc["last"], F.array().cast("array<int>")), add)
        return bind(inner, lambda r: state(r["last"], F.concat(acc["done"], F.array(r["done"]))))

    starts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
    chunks = F.transform(starts, lambda i: F.slice(items, i * CHUNK + 1, CHUNK))
    return F.flatten(F.aggregate(chunks, state(F.lit(0), F.array().cast("array<array<int>>")), add_chunk)["done"])


def without_comments(html: Column) -> Column:
    """Comments out; one that never ends takes the rest."""
    after = lambda p: F.coalesce(F.concat(F.lit(" "), F.get(F.split(p, "-->", 2), F.lit(1))), F.lit(""))
    return F.array_join(F.transform(F.split(html, "<!--"), lambda p, i: F.when(i == 0, p).otherwise(after(p))), "")


def without_element(html: Column, name: str, to_end: bool) -> Column:
    """Elements ``name`` out, each to the first end tag behind it. Where none follows the last one, it takes the rest of
    the page if ``to_end``, else it stays."""

    def keep(parts: Column) -> Column:
        def part(p: Column, i: Column) -> Column:
            after = F.get(F.split(p, rf"(?i)</{name}\s*>", 2), F.lit(1))
            stays = (i == F.size(parts) - 1) & F.lit(not to_end)
            return F.when(i == 0, p).when(after.isNotNull(), F.concat(F.lit(" "), after)).when(stays, F.concat(F.lit(f"<{name}"), p)).otherwise("")

        return F.array_join(F.transform(parts, part), "")

    return bind(F.split(html, rf"(?i)<{name}(?=[\s>])"), keep)


def without_adverts(html: Column) -> Column:
    """Advert blocks out, whatever is nested in them. One whose div is never closed stays."""

    def step(depth: Column, part: Column) -> Column:
        inside = depth + F.when(part.rlike(DIV), 1).when(part.rlike(DIV_END), -1).otherwise(0)
        return F.when(depth > 0, inside).when(part.rlike(ADVERT), 1).otherwise(0)

    def keep(parts: Column, depth: Column) -> Column:
        before = lambda i: F.coalesce(F.when(i > 0, F.get(depth, i - 1)), F.lit(0))
        opens = F.array_max(F.transform(depth, lambda d, i: F.when((d == 1) & (before(i) == 0), i)))
        unclosed = F.when(F.element_at(depth, -1) > 0, opens)

        def part(p: Column, i: Column) -> Column:
            now = F.get(depth, i)
            rest = F.regexp_replace(p, DIV_END, "")
            return F.when((now == 0) & (before(i) == 0), p).when(now == 0, rest).when(before(i) == 0, F.lit(" ")).otherwise("")

        closed = lambda last: F.concat(F.array_join(F.transform(F.slice(parts, 1, last), part), ""), F.array_join(F.slice(parts, last + 1, F.size(parts)), ""))
        return bind(F.coalesce(unclosed, F.size(parts)), closed)

    cut = bind(F.split(html, r"(?i)(?=<div[\s>])|(?=</div\s*>)"), lambda parts: bind(running(parts, step), lambda depth: keep(parts, depth)))
    return F.when(html.rlike(ADVERT.replace("^", "")), cut).otherwise(html)


def html_to_text(html: Column) -> Column:
    """Visible text of a page as paragraphs separated by one blank line; null for null."""
    cut = lambda name: lambda c: without_element(c, name, name in CODE)
    steps = [without_comments, *map(cut, (AROUND[0], *CODE, *AROUND[1:])), without_adverts]
    steps += [lambda c: F.regexp_replace(F.regexp_replace(c, BLOCK_TAG, "\n\n"), TAG, ""), unescape]
    text = html
    for step in steps:
        text = bind(text, step)
    return strip(F.regexp_replace(text, BLANK_RUNS, "\n\n"))


def html_title(html: Column) -> Column:
    return strip(bind(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), unescape))


def html_meta(html: Column, names: Iterable[str]) -> Column:
    """Map of ``names`` to the content of the first ``<meta>`` with that name or property; names without one are not in it."""

    def value(tags: Column, name: str) -> Column:
        own = rf"""(?is)\s(?:name|property)\s*=\s*["']?{re.escape(name)}["'\s]"""
        content = r"""(?is)\scontent\s*=\s*["']([^"'>]*)["']"""
        first = F.get(F.filter(tags, lambda m: m.rlike(own) & m.rlike(content)), F.lit(0))
        return F.nullif(strip(bind(F.regexp_extract(first, content, 1), unescape)), F.lit(""))

    def entries(tags: Column) -> Column:
        return F.filter(F.array(*[F.struct(F.lit(n).alias("key"), value(tags, n).alias("value")) for n in names]), lambda e: e["value"].isNotNull())

    return F.map_from_entries(bind(F.regexp_extract_all(html, F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0)), entries))
