"""Model-free style metrics of a text column.

Per-text metrics are expressions on the row: no shuffle, no Python. Word lists are parameters because
useful ones change over time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t

# Published marker vocabulary.
MARKER_WORDS = (
    "delve", "intricate", "nuanced", "underscore", "showcasing", "comprehensive", "multifaceted", "pivotal",
    "commendable", "meticulous", "realm", "landscape", "tapestry", "crucial", "robust", "across",
    "additionally", "enhancing", "exhibited", "insights", "notably", "particularly", "within",
)
TRANSITIONS = ("furthermore", "additionally", "in conclusion", "moreover", "in addition", "overall", "notably")
CONTRAST_PATTERN = r"\bnot (?:just|only|about)\b[^.!?]*\bbut\b|\bit's not\b[^.!?]*\bit's\b"
TRIPLE_PATTERN = r"[\p{L}\p{N}]+, [\p{L}\p{N}]+,? (?:and|or|und|et|y) [\p{L}\p{N}]+"
HEDGE_PATTERN = r"\bit should be noted\b|\bthis suggests that\b|\bgenerally speaking\b|\bfrom a broader perspective\b|\bmay be\b"
MIN_BURST_WORDS = 4.0


def _per_thousand(n: Column, words: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(n.cast("double") * 1000, words), F.lit(0.0)), 6)


def marker_words(df: DataFrame, words: Sequence[str] = MARKER_WORDS, text: str = "content") -> DataFrame:
    """Occurrences of listed words, in all and per 1,000 words."""
    toks = t.tokens(F.col(text))
    n = F.size(F.filter(toks, lambda w: w.isin(*words))).cast("bigint")
    return df.withColumn("n_words", F.size(toks).cast("bigint")).withColumn("n_markers", n).withColumn(
        "markers_per_1000", _per_thousand(F.col("n_markers"), F.col("n_words"))
    )


def _mean(xs: Column) -> Column:
    total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.size(xs))


def sentence_spread(paragraph: Column) -> Column:
    """Sample standard deviation of the sentence lengths in words; null below two sentences.

    From integer sums, so that a spread that is just a limit does not fall below it by rounding.
    """
    def spread(x: Column) -> Column:
        n, zero = F.size(x).cast("bigint"), F.lit(0).cast("bigint")
        total, squares = F.aggregate(x, zero, lambda a, v: a + v), F.aggregate(x, zero, lambda a, v: a + v * v)
        return F.when(n > 1, F.sqrt((n * squares - total * total) / (n * (n - 1))))

    return t.bind(F.transform(t.sentences(paragraph), t.word_count), spread)


def burstiness(df: DataFrame, text: str = "content", flag_below: float = MIN_BURST_WORDS) -> DataFrame:
    """Mean sentence-length spread over the paragraphs, and how many paragraphs read too evenly."""
    spreads = F.filter(F.transform(t.paragraphs(F.col(text)), sentence_spread), lambda s: s.isNotNull())
    return (
        df.withColumn("_s", spreads)
        .withColumn("burstiness", F.round(_mean(F.col("_s")), 6))
        .withColumn("n_even", F.size(F.filter("_s", lambda s: s < flag_below)).cast("bigint"))
        .drop("_s")
    )


def formulaic_openings(df: DataFrame, openings: Sequence[str] = TRANSITIONS, text: str = "content") -> DataFrame:
    """Paragraphs, and those that open with a listed phrase."""
    paras = t.paragraphs(F.lower(text))

    def opens(p: Column) -> Column:
        out = F.lit(False)
        for o in openings:
            out = out | F.startswith(p, F.lit(o.lower()))
        return out

    return df.withColumn("n_paragraphs", F.size(paras).cast("bigint")).withColumn(
        "n_formulaic", F.size(F.filter(paras, opens)).cast("bigint")
    )


def type_token_ratio(df: DataFrame, text: str = "content") -> DataFrame:
    """Distinct words over all words."""
    toks = t.tokens(F.col(text))
    return df.withColumn(
        "type_token_ratio", F.round(F.try_divide(F.size(F.array_distinct(toks)).cast("double"), F.size(toks)), 6)
    )


def rhetoric_density(df: DataFrame, text: str = "content") -> DataFrame:
    """Contrast frames, triples and hedges per 1,000 words."""
    low = F.lower(text)
    n_words = F.size(t.tokens(F.col(text)))
    out = df
    for name, pattern in (("contrast", CONTRAST_PATTERN), ("triples", TRIPLE_PATTERN), ("hedges", HEDGE_PATTERN)):
        n = F.regexp_count(low, F.lit(pattern)).cast("bigint")
        out = out.withColumn(f"n_{name}", n).withColumn(f"{name}_per_1000", _per_thousand(n, n_words))
    return out


def length_class(p: Column) -> Column:
    n = t.word_count(p)
    return F.when(n < 20, "short").when(n < 60, "medium").otherwise("long")


def structure_repeat(df: DataFrame, text: str = "content") -> DataFrame:
    """Share of neighbouring paragraphs alike in opening word and length class; null with one paragraph."""
    shapes = F.transform(
        t.paragraphs(F.col(text)),
        lambda p: F.concat_ws("|", F.regexp_extract(F.lower(p), t.WORD_PATTERN, 0), length_class(p)),
    )
    n = F.size("_shapes") - 1
    same = F.size(
        F.filter(
            F.zip_with(F.slice("_shapes", 1, n), F.slice("_shapes", 2, n), lambda a, b: a == b), lambda x: x
        )
    )
    return df.withColumn("_shapes", shapes).withColumn(
        "structure_repeat", F.when(n > 0, F.round(same / n, 6))
    ).drop("_shapes")


def style_metrics(df: DataFrame, words: Sequence[str] = MARKER_WORDS, openings: Sequence[str] = TRANSITIONS) -> DataFrame:
    """All per-text metrics in one pass over ``content``."""
    return structure_repeat(rhetoric_density(type_token_ratio(formulaic_openings(burstiness(marker_words(df, words)), openings))))


def ngrams(words: Column, n: int) -> Column:
    last = F.size(words) - n + 1
    return F.when(
        last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, n), " "))
    ).otherwise(F.array().cast("array<string>"))


def repeated_ngrams(df: DataFrame, keys: list[str], n: int = 3, top: int = 5, text: str = "content") -> DataFrame:
    """Most frequent n-grams that occur more than once in a text, at most ``top`` per text, counted inside the row."""
    counted = t.counts(df.withColumn("_w", t.tokens(F.col(text))).select(*keys, ngrams(F.col("_w"), n).alias("_g")), "_g", *keys)
    again = F.filter("_counts", lambda x: x["n"] > 1)
    ranked = F.sort_array(F.transform(again, lambda x: F.struct((-x["n"]).alias("less"), x["token"].alias("ngram"))))
    rows = counted.select(*keys, F.posexplode(F.slice(ranked, 1, top)).alias("pos", "x"))
    return rows.select(*keys, F.col("x.ngram").alias("ngram"), (-F.col("x.less")).alias("n"), (F.col("pos") + 1).alias("rank"))


def excess_words(df: DataFrame, in_slice: Column, text: str = "content", min_count: int = 1) -> DataFrame:
    """Word frequency in one slice of a corpus over that in the rest: per-million rates and their ratio.

    Both counts come from one grouping; a word absent from one side counts as 0 there.
    """
    words = df.select(in_slice.alias("_in"), F.explode(t.tokens(F.col(text))).alias("word"))
    counts = words.groupBy("word").agg(F.count_if("_in").alias("n_slice"), F.count_if(~F.col("_in")).alias("n_base"))
    totals = counts.agg(F.sum("n_slice").alias("s"), F.sum("n_base").alias("b")).select(F.struct("s", "b").alias("t")).scalar()
    rate = lambda n, total: F.coalesce(F.try_divide(n.cast("double") * 1_000_000, total), F.lit(0.0))
    return (
        counts.filter((F.col("n_slice") + F.col("n_base")) >= min_count)
        .withColumn("_t", totals)
        .withColumn("slice_rate", F.round(rate(F.col("n_slice"), F.col("_t.s")), 4))
        .withColumn("base_rate", F.round(rate(F.col("n_base"), F.col("_t.b")), 4))
        .withColumn("ratio", F.round(F.try_divide(rate(F.col("n_slice"), F.col("_t.s")), rate(F.col("n_base"), F.col("_t.b"))), 4))
        .drop("_t")
    )
