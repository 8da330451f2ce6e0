"""Source-quality predicates computed from a page row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, netloc

# Marker substrings and suffixes.
PEER_REVIEW_MARKS = ("doi.org", "pubmed", "ncbi.nlm.nih.gov", "arxiv.org", "scholar.google")
PRIMARY_SUFFIXES = (".gov", ".edu", ".org")
INSTITUTION_SUFFIXES = (".gov", ".edu")
MARKETING_PHRASES = (
    "sponsored", "advertisement", "promoted", "affiliate", "buy now", "sign up free", "limited time offer",
)


def _contains_any(c: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out


def _ends_with_any(c: Column, suffixes) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | F.endswith(c, F.lit(s))
    return out


def is_peer_reviewed(url: Column) -> Column:
    return _contains_any(F.lower(url), PEER_REVIEW_MARKS)


def is_primary(url: Column) -> Column:
    return _ends_with_any(netloc(url), PRIMARY_SUFFIXES)


def reputation_tier(url: Column, trusted: Column) -> Column:
    domain = netloc(url)
    return (
        F.when(any_of(trusted, lambda t: F.contains(domain, F.lower(t))), "trusted")
        .when(_ends_with_any(domain, INSTITUTION_SUFFIXES), "institutional")
        .otherwise("unknown")
    )


def is_marketing(markdown: Column, title: Column, window: int | None = None) -> Column:
    """Whether text or title hold a marketing phrase; with ``window`` only so many leading characters are looked at."""
    seen = markdown if window is None else F.substring(markdown, 1, window)
    return _contains_any(F.lower(F.concat(seen, F.coalesce(title, F.lit("")))), MARKETING_PHRASES)


def source_quality(url: Column, markdown: Column, title: Column, trusted: Column) -> Column:
    return F.struct(
        is_peer_reviewed(url).alias("is_peer_reviewed"),
        is_primary(url).alias("is_primary_source"),
        reputation_tier(url, trusted).alias("domain_reputation"),
        is_marketing(markdown, title).alias("conflict_of_interest"),
    )
