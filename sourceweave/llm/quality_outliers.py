"""Quality rules: base counts in the row, then robust multivariate outliers within each language and source.

Only DataFrame functions. The estimates are minimum-covariance-determinant ones: from two starts (medians with
quartile spreads, and shortest halves), concentration steps refit mean and scatter on the nearest half of each group
for as long as the determinant falls; the least determinant of a group wins, and a last step refits it on all that
lies near. Up to just under half of a group may be junk. Every step is one aggregation by (group, start, distance
bin), so no group is ever gathered; ties in a bin stay together, and sums are rounded so that reruns decide alike.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_GAP, rounded, staged, words

RUN = 8
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Share of (n + p + 1) rows that a concentration step fits, steps before the first test whether the determinants still
#: fall, rows that a group of its own needs.
SHARE, STEPS, OWN_ROWS = 0.5, 4, 50
#: Least relative fall of a determinant that calls for a further step.
FALL = 1e-6
#: Words of ordinary length (5) that steady the mean word length of short texts.
STEADY_WORDS = 50
#: Least standard deviations of the vector's parts: log word length, log symbols a word, share of repeated lines and words.
FLOORS = [0.03, 0.05, 0.10, 0.08]
#: Chi-square with four degrees of freedom, quantile 1 - 1e-6.
FAR = 33.38
#: Width of a bin of the start's histograms, and of log2(1 + squared distance).
VALUE_BIN, DISTANCE_BIN = 1 / 256, 1 / 16
P = len(FLOORS)
VECTOR = [f"_v{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
MODEL = [*[f"_m{i}" for i in range(P)], *[f"_l{i}_{j}" for i, j in PAIRS]]
#: Key of a model while the starts compete.
TRIAL = ["_group", "_try"]


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the five counts, ``n_lines`` (lines with a word) and ``base_failed``.

    A null text counts as empty: all counts 0, ``base_failed`` true. Columns of the input that bear one of the new
    names are replaced; repeated rows stay. The windows of a text are told apart by a 64-bit hash of its words' hashes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.withColumns({"_hashes": F.transform(words(F.col("text")), lambda w: F.xxhash64(w)), "_lines": lines})
    a = a.withColumns({"n_words": F.size("_hashes").cast("long"), "n_lines": F.size("_lines").cast("long")})
    at = lambda i, k: F.get("_hashes", i + F.lit(k))
    a = a.withColumn(
        "_runs",
        F.when(F.col("n_words") >= RUN, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - RUN), lambda i: F.xxhash64(*[at(i, k) for k in range(RUN)]))),
    )
    # only texts in which some window repeats are sorted
    repeats = F.size(F.array_distinct("_runs")) < F.size("_runs")
    pairs = F.when(repeats, F.sort_array(F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    a = a.withColumn("_sorted", pairs)
    hash_at = lambda j: F.get("_sorted", j)["h"]
    twice = F.filter(
        F.transform("_sorted", lambda x, j: F.when(F.coalesce(hash_at(j - 1) == x["h"], F.lit(False)) | F.coalesce(hash_at(j + 1) == x["h"], F.lit(False)), x["i"])),
        lambda i: i.isNotNull(),
    )
    a = a.withColumn("_starts", F.sort_array(twice))
    gaps = F.transform("_starts", lambda s, j: F.least(F.lit(RUN), F.coalesce(F.get("_starts", j + 1) - s, F.lit(RUN))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda n, g: n + g), F.lit(0).cast("long"))
    chars = F.length(F.regexp_replace(text, WORD_GAP, ""))
    a = a.withColumns(
        {
            "word_chars": chars.cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.col("n_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": covered,
        }
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return a.withColumn("base_failed", failed).drop("_hashes", "_lines", "_runs", "_sorted", "_starts")


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log((F.col("word_chars") + 5.0 * STEADY_WORDS) / (F.col("n_words") + float(STEADY_WORDS))),
        F.log1p(F.col("n_symbols") / n),
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        F.col("n_repeat_words") / n,
    ]


def _grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_group``: its language and source, or a pool of the sources (then languages) with too few rows."""
    fit = rows.where(~F.col("base_failed")).groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("_n"))
    sizes = rows.groupBy("_lang", "_source").agg(F.lit(1).alias("_one")).join(fit, ["_lang", "_source"], "left")
    rare = F.coalesce("_n", F.lit(0)) < OWN_ROWS
    pools = sizes.where(rare).groupBy("_lang").agg(F.sum(F.coalesce("_n", F.lit(0))).alias("_pool"))
    own = F.xxhash64(F.lit("source"), "_lang", "_source")
    pooled = F.when(F.col("_pool") >= OWN_ROWS, F.xxhash64(F.lit("language"), "_lang")).otherwise(F.xxhash64(F.lit("rest")))
    keys = sizes.join(pools, "_lang", "left").select("_lang", "_source", F.when(rare, pooled).otherwise(own).alias("_group"))
    return rows.join(staged(keys, "outlier-groups"), ["_lang", "_source"], "inner")


def _start(fit: DataFrame) -> DataFrame:
    """Two starts by group, from counts by value bin: medians and quartile spreads, middles and widths of shortest halves."""
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.floor(F.col(v) / VALUE_BIN).alias("bin")) for i, v in enumerate(VECTOR)]))
    counts = fit.select("_group", parts.alias("x")).groupBy("_group", "x.part", "x.bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("_group", "part")
    seen = counts.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), (F.col("bin") + 0.5) * VALUE_BIN))
    by = seen.groupBy("_group", "part").agg(quartile(0.25).alias("low"), quartile(0.5).alias("mid"), quartile(0.75).alias("high"))
    # each bin as an end and as a beginning; falling by rank, the last end seen is the first at which half the rows are met
    end, begin = F.struct(F.col("upto").alias("at"), F.lit(1).alias("end"), "bin"), F.struct((F.col("upto") - F.col("n") + F.floor(F.col("all") / 2) + 1).alias("at"), F.lit(0).alias("end"), "bin")
    both = seen.select("_group", "part", F.explode(F.array(end, begin)).alias("x")).select("_group", "part", "x.*")
    met = F.last(F.when(F.col("end") == 1, F.col("bin")), ignorenulls=True).over(w.orderBy(F.desc("at"), F.desc("end"), F.desc("bin")))
    halves = both.withColumn("width", met - F.col("bin")).where("end = 0 AND width IS NOT NULL")
    short = halves.groupBy("_group", "part").agg(F.min(F.struct("width", "bin")).alias("x")).select("_group", "part", "x.*")
    low = F.col("bin") * VALUE_BIN
    short = short.select("_group", "part", low.alias("low"), (low + (F.col("width") + 1) * VALUE_BIN / 2).alias("mid"), (low + F.col("width") * VALUE_BIN).alias("high"))
    one = lambda i, c: F.max(F.when(F.col("part") == i, c))
    means = [one(i, F.col("mid")).alias(f"_m{i}") for i in range(P)]
    spread = [one(i, F.pow((F.col("high") - F.col("low")) / 1.349, 2)).alias(f"_s{i}_{i}") for i in range(P)]
    starts = by.withColumn("_try", F.lit(0)).unionByName(short.withColumn("_try", F.lit(1)))
    wide = starts.groupBy(*TRIAL).agg(*means, *spread)
    return wide.withColumns({f"_s{i}_{j}": F.lit(0.0) for i, j in PAIRS if i != j})


def _factored(model: DataFrame, key: list[str]) -> DataFrame:
    """Mean and Cholesky factor of the scatter, its diagonal raised by the floors, and ``_det``, half the log of its determinant."""
    a = model
    for i, j in PAIRS:
        rest = F.col(f"_s{i}_{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
        for k in range(j):
            rest = rest - F.col(f"_l{i}_{k}") * F.col(f"_l{j}_{k}")
        a = a.withColumn(f"_l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 4))) if i == j else rest / F.col(f"_l{j}_{j}"))
    det = sum((F.log(F.col(f"_l{i}_{i}")) for i in range(1, P)), F.log("_l0_0"))
    return a.select(*key, *MODEL, det.alias("_det"))


def _distances(rows: DataFrame, model: DataFrame, key: list[str], how: str) -> DataFrame:
    """``rows`` with ``_d``, the squared Mahalanobis distance to the model of their key."""
    a = rows.join(model.select(*key, *MODEL), key, how)
    for i in range(P):
        rest = F.col(VECTOR[i]) - F.col(f"_m{i}")
        for k in range(i):
            rest = rest - F.col(f"_l{i}_{k}") * F.col(f"_z{k}")
        a = a.withColumn(f"_z{i}", rest / F.col(f"_l{i}_{i}"))
    total = sum((F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(1, P)), F.col("_z0") * F.col("_z0"))
    return a.withColumn("_d", total).drop(*[f"_z{i}" for i in range(P)], *MODEL)


def _refit(fit: DataFrame, model: DataFrame, key: list[str], near: bool) -> DataFrame:
    """Mean and scatter of the nearest share of each key in ``model``, or (``near``) of all rows within the limit."""
    binned = _distances(fit, model, key, "inner").withColumn("_bin", F.floor(F.log2(1 + F.col("_d")) / DISTANCE_BIN))
    sums = [F.sum(v).alias(f"_x{i}") for i, v in enumerate(VECTOR)] + [F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"_x{i}_{j}") for i, j in PAIRS]
    bins = binned.groupBy(*key, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.min("_d").alias("_least"), *sums)
    if near:
        chosen = bins.where(F.col("_least") <= FAR)
    else:
        w = Window.partitionBy(*key)
        bins = bins.withColumns({"_upto": F.sum("_n").over(w.orderBy("_bin")), "_all": F.sum("_n").over(w)})
        chosen = bins.where(F.col("_upto") - F.col("_n") < F.floor(SHARE * (F.col("_all") + P + 1)))
    total = chosen.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ["_n", *[f"_x{i}" for i in range(P)], *[f"_x{i}_{j}" for i, j in PAIRS]]])
    means = total.withColumns({f"_m{i}": F.col(f"_x{i}") / F.col("_n") for i in range(P)})
    scatter = {f"_s{i}_{j}": rounded(F.col(f"_x{i}_{j}") / F.col("_n") - F.col(f"_m{i}") * F.col(f"_m{j}"), 6) for i, j in PAIRS}
    return means.withColumns(scatter).withColumns({f"_m{i}": rounded(F.col(f"_m{i}")) for i in range(P)})


def _least(fit: DataFrame) -> DataFrame:
    """The model of least determinant by group. A trial ends when its determinant falls no more; only the others are fitted again."""
    trials = fit.withColumn("_try", F.explode(F.array(F.lit(0), F.lit(1))))
    last = staged(_factored(_start(fit), TRIAL), "outlier-start")
    steps = []
    for _ in range(STEPS):
        last = staged(_factored(_refit(trials, last, TRIAL, near=False), TRIAL), "outlier-step")
        steps.append(last)
    while not last.isEmpty():
        step = staged(_factored(_refit(trials, last, TRIAL, near=False), TRIAL), "outlier-step")
        steps.append(step)
        before = last.select(*TRIAL, F.col("_det").alias("_before"))
        last = staged(step.join(before, TRIAL).where(F.col("_det") < F.col("_before") - FALL).drop("_before"), "outlier-falling")
    every = reduce(DataFrame.unionByName, steps)
    best = every.groupBy("_group").agg(F.min(F.struct("_det", "_try", *MODEL)).alias("x"))
    return staged(best.select("_group", *[F.col(f"x.{c}").alias(c) for c in MODEL]), "outlier-least")


def with_verdicts(counted: DataFrame) -> DataFrame:
    """Rows of ``base_counts`` with ``kept``: false where ``base_failed``, else whether the row is no outlier.

    Groups are (lang, source); null and empty names are one group each. Sources with under ``OWN_ROWS`` rows that
    pass the base share a pool by language, and failing that one for all. All rows that pass the base are fitted and
    judged; texts are not needed, other columns pass through. An empty table gives an empty result. Input columns that
    bear a name used here (``kept`` and the underscored ones) are replaced.
    """
    counted = counted.drop("kept", "_group", "_d", "_n", *[c for c in counted.columns if re.fullmatch(r"_[zmlv]\d(_\d)?", c)])
    vector = dict(zip(VECTOR, _vector(), strict=True))
    keys = {"_lang": F.coalesce("lang", F.lit("")), "_source": F.coalesce("source", F.lit(""))}
    rows = staged(counted.withColumns(vector).withColumns(keys), "outlier-rows")
    grouped = _grouped(rows)
    fit = staged(grouped.where(~F.col("base_failed")).select("_group", *VECTOR, "n_words"), "outlier-fit")
    model = staged(_factored(_refit(fit, _least(fit), ["_group"], near=True), ["_group"]), "outlier-model")
    judged = _distances(grouped, model, ["_group"], "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("_d") <= FAR, F.lit(True))
    return judged.withColumn("kept", kept).drop("_group", "_lang", "_source", "_d", *VECTOR)


def quality(docs: DataFrame) -> DataFrame:
    """``docs`` with base counts and verdicts."""
    return with_verdicts(base_counts(docs))
