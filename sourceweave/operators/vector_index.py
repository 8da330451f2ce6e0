"""An inverted-file index of vectors: coarse centres, every row in the list of its nearest one, exact ranking of what is probed.

The table is partitioned by metadata columns and list, so a filter on metadata and the lists of a probe decide which
files are read. Blocks of queries meet blocks of the lists they enter: a task holds one of each at a time, multiplies
them as matrices and keeps what may be nearest.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import staged
from .ranking import DIGITS, dot, norm

#: Rows of a list on average, lists at most, rows that the centres are fitted on for each list, rounds of fitting.
LIST_ROWS, MOST_LISTS, SAMPLE, ROUNDS = 4096, 4096, 64, 10
#: Rows and queries of a block, on average.
BLOCK, ASKED = 4096, 2048


@dataclass(frozen=True)
class VectorIndex:
    """``path`` holds the rows by metadata and ``_list``; ``centres`` (_list, centre) is bounded by ``MOST_LISTS`` rows."""

    spark: SparkSession
    path: str
    centres: DataFrame
    lists: int
    schema: StructType

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def build(vectors: DataFrame, path: str, dim: int, by: tuple[str, ...] = (), lists: int | None = None) -> VectorIndex:
    """Index ``vectors`` (id, embedding, the columns ``by``) at ``path``.

    Centres are fitted by cosine on at most ``SAMPLE`` rows a list, those of least checksum; every row is indexed. Null
    and zero vectors are in list -1, which only an exact search reads. Rows without id are left out; a vector of another
    length than ``dim`` is an error. A list that a third of all rows belong to is split into many files by row.
    """
    spark = vectors.sparkSession
    fits = F.col("embedding").isNull() | (F.size("embedding") == dim)
    embedding = F.when(fits, F.col("embedding").cast("array<double>")).otherwise(F.raise_error(F.lit(f"a vector has not {dim} components")))
    rows = staged(vectors.where("id IS NOT NULL").select("id", *by, embedding.alias("embedding")).withColumn("length", norm(F.col("embedding"))), "index-rows")
    some = rows.where("length > 0")
    n = some.count()
    k = lists or int(min(MOST_LISTS, max(1, n // LIST_ROWS)))
    with_vector = some.withColumn("_v", array_to_vector("embedding"))
    none = rows.where("coalesce(length, 0) = 0").withColumn("_list", F.lit(-1))
    if n and k > 1:
        sample = with_vector.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * k).select("_v")
        model = KMeans(k=k, seed=7, maxIter=ROUNDS, distanceMeasure="cosine", featuresCol="_v", predictionCol="_list").fit(sample)
        placed = model.transform(with_vector).drop("_v")
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    else:
        placed, centres = some.withColumn("_list", F.lit(0)), [(0, [1.0] * dim)]
    spread = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // (64 * LIST_ROWS)))))
    all_ = placed.unionByName(none)
    all_.repartition(*by, "_list", spread).write.partitionBy(*by, "_list").parquet(path)
    return VectorIndex(spark, path, spark.createDataFrame(centres, "_list int, centre array<double>"), len(centres), all_.schema)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, keep: Column | None = None) -> DataFrame:
    """(query, id, similarity, rank): the nearest ``k`` indexed rows to each of ``queries`` (query, embedding).

    ``probes`` is how many lists a query enters, nearest centre first; without it all lists are, which is exact. ``keep``
    filters on the metadata columns before any vector is read. Similarity is the cosine to six digits, null for null and
    zero vectors, which come last; ties go by id.
    """
    asked = queries.where("query IS NOT NULL").select("query", F.col("embedding").cast("array<double>").alias("_q"))
    asked = asked.withColumn("_qn", norm(F.col("_q")))
    if probes is None:
        wanted = F.sequence(F.lit(-1), F.lit(index.lists - 1))
    else:
        # the centres travel as one value: their number is bounded
        all_ = index.centres.agg(F.collect_list(F.struct("_list", "centre")).alias("c")).scalar()
        asked = asked.withColumn("_c", all_)
        far = F.transform("_c", lambda c: F.struct((-F.coalesce(F.try_divide(dot(c["centre"], F.col("_q")), norm(c["centre"])), F.lit(0.0))).alias("far"), c["_list"].alias("list")))
        wanted = F.transform(F.slice(F.array_sort(far), 1, probes), lambda c: c["list"])
    entered = asked.select("query", "_q", "_qn", F.explode(wanted).alias("_list"))
    held = index.rows if keep is None else index.rows.where(keep)
    blocks = staged(held.groupBy("_list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks")), "list-blocks")
    groups = -(-asked.count() // ASKED)
    side = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = held.join(blocks, "_list").select("_list", side("id", F.col("_blocks")).alias("_block"), every(F.lit(max(1, groups))).alias("_group"), "id", "embedding", "length")
    asks = entered.join(blocks, "_list").select("_list", every(F.col("_blocks")).alias("_block"), side("query", F.lit(max(1, groups))).alias("_group"), "query", "_q", "_qn")
    keys, kinds = ["_list", "_block", "_group"], [f"{n} {index.schema['id'].dataType.simpleString() if n == 'id' else asked.schema['query'].dataType.simpleString()}" for n in ("query", "id")]
    met = rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(_nearest(k), f"{', '.join(kinds)}, cosine double")
    best = W.partitionBy("query").orderBy(F.col("similarity").desc_nulls_last(), "id")
    found = met.select("query", "id", F.round("cosine", DIGITS).alias("similarity"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _matrix(column: pa.ChunkedArray, usable: np.ndarray) -> np.ndarray:
    """The vectors told by ``usable``, one a row."""
    lists = column.combine_chunks().filter(pa.array(usable))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.empty((0, 0))


def _rounded(x: np.ndarray) -> np.ndarray:
    """``x`` in units of the last digit kept, halves away from zero in the shortest decimal form, as Spark rounds."""
    scaled = np.abs(x) * 10**DIGITS
    out = np.floor(scaled + 0.5)
    near = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6
    if near.any():
        values, at = np.unique(np.abs(x[near]), return_inverse=True)
        out[near] = np.array([float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-DIGITS), ROUND_HALF_UP).scaleb(DIGITS)) for v in values])[at]
    return np.copysign(out, x)


def _nearest(k: int):
    """Of a block of rows, the ``k`` nearest to each query of a block: product of matrices, then exact sums for what is near the k-th."""

    def search(rows: pa.Table, asks: pa.Table) -> pa.Table:
        query, other, cosine = [], [], []
        ids = rows["id"].to_pylist()
        order = np.argsort(np.array(ids), kind="stable") if ids else np.empty(0, np.int64)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        length, asked = (c.to_numpy(zero_copy_only=False).astype(float) for c in (rows["length"], asks["_qn"]))
        usable, able = (np.array(c.is_valid()) & ~(n <= 0) for c, n in ((rows["length"], length), (asks["_qn"], asked)))
        mine, x = np.flatnonzero(usable), _matrix(rows["embedding"], usable)
        if len(mine):  # a query of another length has no similarity either
            able &= np.array([v is not None and len(v) == x.shape[1] for v in asks["_q"]], bool)
        # rows and queries without a direction have no similarity: they follow by id
        none = [i for i in order if not usable[i]][:k]
        names = asks["query"].to_pylist()
        for q in np.flatnonzero(~able):
            few = order[:k]
            query += [names[q]] * len(few)
            other += [ids[i] for i in few]
            cosine += [None] * len(few)
        for q in np.flatnonzero(able):
            query += [names[q]] * len(none)
            other += [ids[i] for i in none]
            cosine += [None] * len(none)
        if len(mine) and able.any():
            who, y = np.flatnonzero(able), _matrix(asks["_q"], able)
            for start in range(0, len(who), 256):
                part, z = who[start : start + 256], y[start : start + 256]
                with np.errstate(all="ignore"):
                    near = (z @ x.T) / (asked[part][:, None] * length[mine])
                near[np.isnan(near)] = np.inf  # NaN comes first, as Spark orders it
                at = min(k, len(mine))
                least = np.partition(near, len(mine) - at, axis=1)[:, len(mine) - at] - 2 * 10.0**-DIGITS
                a, b = np.nonzero(near >= least[:, None])
                total = np.zeros(len(a))
                with np.errstate(all="ignore"):
                    for i in range(x.shape[1]):
                        total += x[b, i] * z[a, i]
                    exact = total / (length[mine][b] * asked[part][a])
                ranked = np.lexsort((place[mine[b]], -_rounded(np.where(np.isnan(exact), np.inf, exact)), a))
                first = np.searchsorted(a[ranked], np.arange(len(part)))
                chosen = ranked[np.arange(len(ranked)) - first[a[ranked]] < k]
                query += [names[part[i]] for i in a[chosen]]
                other += [ids[mine[i]] for i in b[chosen]]
                cosine += exact[chosen].tolist()
        return pa.table({"query": pa.array(query, asks["query"].type), "id": pa.array(other, rows["id"].type), "cosine": pa.array(cosine, pa.float64())})

    return search
