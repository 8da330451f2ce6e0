"""Reading crawled pages into the crawl-result row type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as hx

# Metadata keys in order of preference.
TITLE_KEYS = ("title", "og:title")
AUTHOR_KEYS = ("author", "og:author")
DATE_KEYS = ("published_date", "article:published_time", "publishedTime")


def _first_of(metadata: Column, keys, *rest: Column) -> Column:
    picks = [F.nullif(F.try_element_at(metadata, F.lit(k)), F.lit("")) for k in keys]
    return F.coalesce(*picks, *rest, F.lit(""))


def read_crawl(raw: DataFrame) -> DataFrame:
    """Raw fetches -> crawl results.

    ``raw``: url, fetched boolean, status_code int, title, markdown, raw_html, metadata map.
    A missing response has status 0; a response without a status counts as 200. Other columns pass through.
    """
    fields = ("url", "fetched", "status_code", "title", "markdown", "raw_html", "metadata")
    more = [c for c in raw.columns if c not in fields]
    meta = F.col("metadata")
    fetched = F.coalesce(F.col("fetched"), F.lit(False))
    return raw.select(
        *more,
        "url",
        F.when(~fetched, F.lit(0)).otherwise(F.coalesce(F.nullif("status_code", F.lit(0)), F.lit(200))).cast("int").alias("status_code"),
        F.when(fetched, _first_of(meta, TITLE_KEYS, F.col("title"))).otherwise("").alias("title"),
        F.when(fetched, _first_of(meta, AUTHOR_KEYS)).otherwise("").alias("author"),
        F.when(fetched, _first_of(meta, DATE_KEYS)).otherwise("").alias("published_date"),
        F.when(fetched, F.coalesce("markdown", F.lit(""))).otherwise("").alias("markdown"),
        F.when(fetched, F.coalesce("raw_html", F.lit(""))).otherwise("").alias("raw_html"),
        F.coalesce(meta, F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def pages_as_fetches(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Pages holding HTML -> raw fetches with cleaned text and the page's metadata; pairs with :func:`read_crawl`."""
    h = F.col(html)
    return pages.select(
        F.col(url).alias("url"),
        F.lit(True).alias("fetched"),
        F.lit(None).cast("int").alias("status_code"),
        hx.html_title(h).alias("title"),
        hx.html_to_text(h).alias("markdown"),
        h.alias("raw_html"),
        hx.html_meta(h, (*TITLE_KEYS[1:], *AUTHOR_KEYS, *DATE_KEYS)).alias("metadata"),
    )


def coerce_meta(c: Column) -> Column:
    """List-valued title or author -> one comma-joined text; empty -> null."""
    return F.nullif(F.array_join(c, ", "), F.lit(""))
