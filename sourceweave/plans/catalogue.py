"""All named queries."""

from . import queries_discovery, queries_drafts, queries_reports  # noqa: F401
from .registry import QUERIES, SQL, run

__all__ = ["QUERIES", "SQL", "run"]
