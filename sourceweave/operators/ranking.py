"""Ranking excerpts by vector similarity to their run's topic.

A run's excerpts are compared with that run's topic vector only, so the pairs come from an equi join and
grow with the excerpts, not with excerpts times topics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIGITS = 6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def topic_vectors(vectors: DataFrame, by: list[str], dim: int, scale: int = 1_000_000) -> DataFrame:
    """Direction of the mean vector per group, as element-wise sums of fixed-point components.

    Whole-number sums come out the same in any order, and cosine ignores the length. A vector whose length is not
    ``dim`` is an error.
    """
    right = F.when(F.size("embedding") == dim, F.col("embedding"))
    vectors = vectors.withColumn("embedding", F.coalesce(right, F.raise_error(F.lit(f"a vector has not {dim} components")).cast("array<float>")))
    sums = [
        F.sum(F.round(F.get("embedding", F.lit(i)).cast("double") * scale).cast("bigint")).alias(f"e{i}") for i in range(dim)
    ]
    return vectors.groupBy(*by).agg(*sums).select(*by, F.array(*[F.col(f"e{i}").cast("double") for i in range(dim)]).alias("topic_vector"))


def cosine_rank(vectors: DataFrame, topics: DataFrame, by: list[str]) -> DataFrame:
    """Similarity of every excerpt vector to its run's topic vector."""
    return vectors.join(topics, by).withColumn("similarity", F.round(cosine(F.col("embedding"), F.col("topic_vector")), DIGITS)).drop(
        "topic_vector"
    )


def knn_filtered(vectors: DataFrame, topics: DataFrame, by: list[str], keep: Column, k: int, tie: str) -> DataFrame:
    """Nearest ``k`` per run among the rows that meet ``keep``; the metadata filter runs first.

    Rows leave their vectors behind and are spread by row, so that the rank can prune inside a large run.
    """
    ranked = cosine_rank(vectors.filter(keep), topics, by).drop("embedding").repartition(*by, tie)
    best = W.partitionBy(*by).orderBy(F.col("similarity").desc_nulls_last(), tie)
    return ranked.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def relevance_cap(evidence: DataFrame, similarities: DataFrame, per_run: int) -> DataFrame:
    """Keep the ``per_run`` most relevant excerpts of a run; runs without vectors go by length.

    ``evidence``: run_id, id, n_chars; ``similarities``: run_id, id, similarity.
    """
    has = similarities.select("run_id").distinct().withColumn("_has", F.lit(True))
    rows = evidence.join(similarities.select("run_id", "id", "similarity"), ["run_id", "id"], "left").join(has, "run_id", "left")
    # spread again by row, so that the rank below can prune inside a large run before it gathers
    rows = rows.repartition("run_id", "id")
    by_length = F.col("_has").isNull()
    order = W.partitionBy("run_id").orderBy(
        F.when(~by_length, F.col("similarity")).desc_nulls_last(), F.when(by_length, F.col("n_chars")).desc_nulls_last(), "id"
    )
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_run).drop("_has")
