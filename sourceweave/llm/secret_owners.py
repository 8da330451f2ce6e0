"""Secret scans: candidate spans in the row, judged by how many repositories and owners hold the same value.

Only DataFrame functions. Values travel as hashes; copies are counted by owner before they meet, and the verdict
comes back to the candidates by a join whose hot partitions are split, so a value that a third of all rows hold
burdens no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import running
from .common import staged

ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Further credential forms; their matches become spans only where the verdict is "live".
FURTHER = (
    r"gh[opsu]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}"
    r"|eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\x20\n]+"
    r"|[a-z][a-z0-9+]{1,15}://[A-Za-z0-9_.-]+:[A-Za-z0-9_.!-]{6,}@"
)
KINDS = ["assign", "access", "hex", "live"]
#: A value held by so many owners, or by so many repositories of whatever owners, is an example that people copy.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 10
#: A live-looking value has at least so many characters, so many of them different, and a digit.
LIVE_LENGTH, LIVE_DISTINCT = 16, 8


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _placed(text: Column, found: Column, pattern: str) -> Column:
    """Start of each match in code points, from the lengths of the pieces between matches."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, m: gap + F.length(m))
    return F.zip_with(running(steps, lambda at, step: at + step), found, lambda end, m: end - F.length(m))


def _spans(kind: int, starts: Column, found: Column) -> Column:
    def span(s: Column, m: Column) -> Column:
        value = F.regexp_extract(m, ASSIGN, 2) if kind == 0 else m
        return F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(m)).alias("end"), value.alias("value"))

    return F.zip_with(F.coalesce(starts, F.array().cast("array<int>")), found, span)


def find_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_found``: array of (start, kind, end, value), kinds numbered as in ``KINDS``; null text: none.

    Within a kind matches are leftmost and do not overlap; matches with a short value are dropped after matching.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    patterns = [ASSIGN, ACCESS, HEX, FURTHER]
    a = docs.withColumns({f"_m{k}": _matches(text, p) for k, p in enumerate(patterns)})
    a = a.withColumns({f"_p{k}": F.when(F.size(f"_m{k}") > 0, _placed(text, F.col(f"_m{k}"), p)) for k, p in enumerate(patterns)})
    spans = [_spans(k, F.col(f"_p{k}"), F.col(f"_m{k}")) for k in range(len(patterns))]
    found = F.filter(F.concat(*spans), lambda x: (x["kind"] != 0) | (F.length(x["value"]) >= 6))
    return a.withColumn("_found", F.sort_array(found)).drop(*[f"_{c}{k}" for c in "mp" for k in range(len(patterns))])


def ownership(candidates: DataFrame) -> DataFrame:
    """Per value hash ``_hash``: ``n_repos`` and ``n_owners``, exact, from rows (_hash, _repo, _owner)."""
    once = candidates.groupBy("_hash", "_owner", "_repo").agg(F.lit(1).alias("_one"))
    by_owner = once.groupBy("_hash", "_owner").agg(F.count(F.lit(1)).alias("_repos"))
    return by_owner.groupBy("_hash").agg(F.sum("_repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def looks_live(value: Column) -> Column:
    return (F.length(value) >= LIVE_LENGTH) & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_DISTINCT) & value.rlike("[0-9]")


def scan(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row per row of ``docs``: its columns but the text, and what was found.

    ``secrets`` is an array of (start, kind, end) in order of start, then kind: every base match, and each further
    match whose value looks live and is held by fewer than ``EXAMPLE_OWNERS`` owners and fewer than ``EXAMPLE_REPOS``
    repositories (the same repository name under two owners is two). ``n_live`` and ``n_example`` count the candidates by
    verdict. Time grows in proportion to a text's length and, but for sorting, its matches. Null text, repository or owner: no match, one empty name each. Repeated rows are
    judged each, but count once as a holder. Columns named like a result are replaced.
    """
    rows = staged(find_candidates(docs).withColumn("_row", F.monotonically_increasing_id()).drop("text"), "secret-rows")
    one = rows.select(
        "_row", F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("_repo"), F.coalesce(F.col(owner), F.lit("")).alias("_owner"), F.explode("_found").alias("f")
    ).select("_row", "_repo", "_owner", "f.start", "f.kind", "f.end", F.sha2("f.value", 256).alias("_hash"), looks_live(F.col("f.value")).alias("_looks"))
    holders = staged(ownership(one), "secret-owners")
    judged = one.join(holders, "_hash")
    example = (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repos") >= EXAMPLE_REPOS)
    live = ~example & F.col("_looks")
    mine = judged.groupBy("_row").agg(
        F.count_if(live).alias("n_live"),
        F.count_if(example).alias("n_example"),
        F.collect_list(F.when(live & (F.col("kind") == 3), F.struct("start", "kind", "end"))).alias("_live"),
    )
    joined = rows.drop("n_live", "n_example", "secrets").join(mine, "_row", "left")
    base = F.transform(F.filter("_found", lambda x: x["kind"] < 3), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    spans = F.when(F.size("_live") > 0, F.sort_array(F.concat(base, "_live"))).otherwise(base)
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_live", "n_example")}
    return joined.withColumns({"secrets": spans} | counts).drop("_row", "_found", "_live")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
