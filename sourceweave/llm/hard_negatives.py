"""Hard negatives of anchor vectors by an inverted multi-index, exactly.

Two codebooks, one for each half of the components, form cells. For an anchor, a half-score bound of a codeword is its
inner product with that half plus the half's length times the codeword's radius (the farthest member). A heap over both
codebooks, each sorted by bound, visits the cells by falling sum of the two bounds, so that the sum at the heap's top
bounds every score in the cells not visited yet.

A search asks for the best rows of one or more score windows. It ends for an anchor when each window is certified: it
has its rows and the last of them lies above the next bound, or the whole window does. Anchors that are not certified
go on in a further round with more cells. Cells come in blocks, and the anchors that visit a cell in groups, so no task
holds more than one of either at a time, however common a vector is.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, stored
from .vectors import matrix, scaled, usable, width

#: Rows that the codebooks are fitted on, at most; every row is indexed.
SAMPLE = 8192
#: Rows of a cell on average, codewords of a half at most, rows of a block, anchors that visit a block at a time.
CELL, MOST_CODEWORDS, BLOCK, GROUP = 1024, 256, 4096, 1024
#: Cells that an anchor visits until the end of the first round, and how that grows.
FIRST, GROWTH = 16, 8


@dataclass(frozen=True)
class Rule:
    """``low`` and ``high`` are hundredths of the positive's score; anchors are the ids that ``every`` divides."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    every: int = 50
    factor: int = 256


@dataclass
class Directory:
    """Codebooks by half, and of each cell, by number (first * codewords + second), its rows and radii."""

    books: list[np.ndarray]
    rows: np.ndarray
    radii: np.ndarray  # cells x 3: first half, second half, whole
    split: int

    def walk(self, anchor: np.ndarray, start: int, stop: int) -> tuple[list[tuple[int, float, float]], float]:
        """Cells from the ``start``-th to before the ``stop``-th, each with an upper and a lower bound; the bound of the rest."""
        k = len(self.books[0])
        halves = (anchor[: self.split], anchor[self.split :])
        inner = [b @ h for b, h in zip(self.books, halves, strict=True)]
        long = [np.sqrt(h @ h) for h in halves]
        by_word = (self.radii[:, 0].reshape(k, k).max(1), self.radii[:, 1].reshape(k, k).max(0))
        bound = [i + n * r for i, n, r in zip(inner, long, by_word, strict=True)]
        first, second = (np.argsort(-b, kind="stable") for b in bound)
        one, two = bound[0][first], bound[1][second]
        length = np.sqrt(anchor @ anchor)
        slack = 1e-9 * (1 + length * (abs(one).max() + abs(two).max()))
        heap, seen, out = [(-(one[0] + two[0]), 0, 0)], 0, []
        while heap and seen < stop:
            _, a, b = heapq.heappop(heap)
            if b + 1 < k:
                heapq.heappush(heap, (-(one[a] + two[b + 1]), a, b + 1))
            if b == 0 and a + 1 < k:
                heapq.heappush(heap, (-(one[a + 1] + two[0]), a + 1, 0))
            cell = first[a] * k + second[b]
            if seen >= start and self.rows[cell]:
                i, j, r = inner[0][first[a]], inner[1][second[b]], self.radii[cell]
                spread = min(long[0] * r[0] + long[1] * r[1], length * r[2]) + slack
                out.append((int(cell), i + j + spread, i + j - spread))
            seen += 1
        return out, -heap[0][0] + slack if heap else -np.inf


def _codebook(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` centres of ``rows`` after ten rounds; an empty one stays."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), k, replace=len(rows) < k)].astype(float)
    for _ in range(10):
        near = _nearest(rows, centres)
        for c in range(k):
            if (near == c).any():
                centres[c] = rows[near == c].mean(0)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2.0 * rows @ centres.T).argmin(1)


def build(rows: DataFrame, wide: int) -> tuple[DataFrame, Directory]:
    """Index of ``rows`` (row, id, label, x): the same with ``cell`` and ``block``, written, and its directory.

    The directory has at most ``MOST_CODEWORDS`` squared cells, whatever the input, and is held by the driver.
    """
    n = rows.count()
    k = int(min(MOST_CODEWORDS, max(2, np.ceil(np.sqrt(n / CELL)))))
    split = (wide + 1) // 2
    sample = matrix(pa.array(rows.orderBy(F.xxhash64("x"), "row").limit(SAMPLE).toPandas()["x"].tolist(), pa.list_(pa.int32())), wide)
    books = [_codebook(h, k, s) for s, h in enumerate((sample[:, :split], sample[:, split:]))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["x"], wide)
            halves = (x[:, :split], x[:, split:])
            word = [_nearest(h, b) for h, b in zip(halves, books, strict=True)]
            far = [((h - b[w]) ** 2).sum(1) for h, b, w in zip(halves, books, word, strict=True)]
            radii = [np.sqrt(far[0]), np.sqrt(far[1]), np.sqrt(far[0] + far[1])]
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in ("row", "id", "label", "x")], pa.array(word[0] * k + word[1], pa.int64()), *map(pa.array, radii)], ["row", "id", "label", "x", "cell", "r1", "r2", "r"]
            )

    kind = rows.schema["label"].dataType.simpleString()
    placed = stored(rows.mapInArrow(place, f"row long, id long, label {kind}, x array<int>, cell long, r1 double, r2 double, r double"), "cells")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in ("r1", "r2", "r")])
    cells = staged(cells.withColumn("blocks", F.ceil(F.col("n") / BLOCK)), "directory")
    count, radii = np.zeros(k * k, np.int64), np.zeros((k * k, 3))
    for c in cells.collect():
        count[c.cell], radii[c.cell] = c.n, (c.r1, c.r2, c.r)
    radii *= 1 + 1e-9
    index = placed.select("row", "id", "label", "x", "cell").join(cells.select("cell", "blocks"), "cell")
    return index.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))), Directory(books, count, radii, split)


VISIT = "row long, label {}, x array<int>, windows array<struct<w:int,lo:long,hi:long>>, same boolean, cell long, next double"


def _visits(open_: DataFrame, directory: Directory, wide: int, start: int, stop: int) -> DataFrame:
    """A row for each cell that an open anchor goes to in this round, and one without a cell for the bound of the rest."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["x"], wide).astype(float)
            lowest, highest = (batch[c].to_numpy(zero_copy_only=False) for c in ("lowest", "highest"))
            take, cell, bound = [], [], []
            for i in range(len(x)):
                cells, rest = directory.walk(x[i], start, stop)
                for c, upper, lower in cells:
                    if upper >= lowest[i] and lower <= highest[i]:
                        take.append(i), cell.append(c), bound.append(None)
                take.append(i), cell.append(None), bound.append(rest)
            rows = batch.select(["row", "label", "x", "windows", "same"]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell, pa.int64()), pa.array(bound, pa.float64())], ["row", "label", "x", "windows", "same", "cell", "next"])

    return open_.mapInArrow(go, VISIT.format(open_.schema["label"].dataType.simpleString()))


HIT = "row long, w int, score long, id long, other long"


def _meet(wide: int, keep: int):
    """Best ``keep`` rows of a block for each window of each anchor of a group."""

    def meet(anchors: pa.Table, block: pa.Table) -> pa.Table:
        if not len(anchors) or not len(block):
            return pa.table({c: pa.array([], pa.int32() if c == "w" else pa.int64()) for c in ("row", "w", "score", "id", "other")})
        block = block.combine_chunks().sort_by([("id", "ascending"), ("row", "ascending")])  # nulls come last
        mine, label = block["row"].to_numpy(), block["label"].to_numpy(zero_copy_only=False)
        scores = (matrix(anchors["x"].combine_chunks(), wide).astype(float) @ matrix(block["x"].combine_chunks(), wide).astype(float).T).astype(np.int64)
        row, own, same = anchors["row"].to_numpy(), anchors["label"].to_numpy(zero_copy_only=False), anchors["same"].to_pylist()
        out: list[list] = [[], [], [], []]
        for i, windows in enumerate(anchors["windows"].to_pylist()):
            fits = np.flatnonzero(((label == own[i]) == same[i]) & (mine != row[i]))
            s = scores[i, fits]
            for w in windows:
                at = np.flatnonzero((s >= w["lo"]) & (s <= w["hi"]))
                if len(at) > keep:  # all that tie with the last one stay until the ids decide
                    at = at[s[at] >= -np.partition(-s[at], keep - 1)[keep - 1]]
                at = at[np.argsort(-s[at], kind="stable")[:keep]]
                for column, values in zip(out, ([row[i]] * len(at), [w["w"]] * len(at), s[at].tolist(), fits[at].tolist()), strict=True):
                    column += values
        who = pa.array(out[3], pa.int64())
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), block["id"].take(who), block["row"].take(who)], ["row", "w", "score", "id", "other"])

    return meet


def search(index: DataFrame, directory: Directory, anchors: DataFrame, keep: int, wide: int) -> DataFrame:
    """(row, w, score, id, other, rank): the best ``keep`` rows of ``index`` in each score window of each anchor.

    ``anchors`` has (row, label, x, windows, same): windows (w, lo, hi) of scores, and whether rows of the anchor's label
    or of all others are sought; never the anchor itself. Best are high scores, then low ids, null ids last.
    """
    best = None
    # widest bounds of the windows that are still open
    open_ = anchors.where(F.size("windows") > 0)
    edges = {"lowest": F.array_min(F.transform("windows", lambda w: w["lo"])), "highest": F.array_max(F.transform("windows", lambda w: w["hi"]))}
    start, stop = 0, FIRST
    order = Window.partitionBy("row", "w").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "other")
    while True:
        visits = staged(_visits(open_.withColumns(edges), directory, wide, start, stop), "visits")
        going = visits.where("cell IS NOT NULL").drop("next")
        groups = going.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
        groups = staged(groups.join(index.select("cell", "blocks").distinct(), "cell"), "groups")
        left = going.join(groups, "cell").withColumn("group", F.pmod(F.xxhash64("row"), F.col("groups"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        right = index.join(groups.select(F.col("cell"), F.col("groups").alias("all_groups")), "cell").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all_groups") - 1)))
        right = right.toDF(*right.columns)
        key = ["cell", "block", "group"]
        hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_meet(wide, keep), HIT)
        hits = hits if best is None else best.select(hits.columns).union(hits)
        best = staged(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep), "best")
        if stop >= len(directory.rows):
            return best
        # a window is certified by its last row, or by lying above the bound of what is left
        last = best.where(F.col("rank") == keep).select("row", "w", "score")
        rest = visits.where("cell IS NULL").select("row", "label", "x", "same", "next", F.explode("windows").alias("window"))
        fails = rest.join(last, (rest["row"] == last["row"]) & (rest["window.w"] == last["w"]), "left").drop(last["row"]).where((F.col("window.lo") <= F.col("next")) & ~F.coalesce(F.col("score") > F.col("next"), F.lit(False)))
        # rows below the last one found are of no use
        window = F.struct(F.col("window.w").alias("w"), F.greatest("window.lo", F.coalesce("score", "window.lo")).alias("lo"), F.col("window.hi").alias("hi"))
        open_ = fails.groupBy("row").agg(F.first("label").alias("label"), F.first("x").alias("x"), F.collect_list(window).alias("windows"), F.first("same").alias("same"))
        open_ = staged(open_, "open-anchors")
        if open_.isEmpty():
            return best
        start, stop = stop, stop * GROWTH


def mine(vectors: DataFrame, rule: Rule | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, embedding, label, any others).

    Components become floor(factor * x), a score is an inner product. An anchor's positives are its best other rows of
    the same label; for each, the best rows of other labels follow whose score lies between ``low`` and ``high``
    hundredths of the positive's. Rows with a null label or vector, or null or non-finite components, take no part; a row
    with a null id is no anchor and comes after all ids among equal scores. Repeated rows count each. Vectors shorter
    than the longest are filled up with zeros. An empty table gives no rows. Other columns are not looked at.
    """
    rule = rule or Rule()
    rows = vectors.where(usable(F.col("embedding")) & F.col("label").isNotNull())
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), "label", scaled(F.col("embedding"), rule.factor).alias("x"))
    rows = stored(rows, "miner-vectors")
    wide = width(rows, "x")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not wide and rows.isEmpty():
        return rows.sparkSession.createDataFrame([], schema)
    index, directory = build(rows, wide)
    index = stored(index, "blocks")
    anchors = index.where(F.col("id") % rule.every == 0).select("row", F.col("id").alias("anchor_id"), "label", "x")
    all_scores = F.array(F.struct(F.lit(0).alias("w"), F.lit(-(2**62)).alias("lo"), F.lit(2**62).alias("hi")))
    found = search(index, directory, anchors.drop("anchor_id").withColumns({"windows": all_scores, "same": F.lit(True)}), rule.positives, wide)
    positives = staged(found.select("row", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    edge = lambda share: F.col("positive_score") * share / 100
    window = F.struct("w", F.ceil(edge(rule.low)).alias("lo"), F.floor(edge(rule.high)).alias("hi"))
    windows = positives.where("positive_score >= 0").groupBy("row").agg(F.collect_list(window).alias("windows"))
    negatives = search(index, directory, anchors.drop("anchor_id").join(windows, "row").withColumn("same", F.lit(False)), rule.negatives, wide)
    negatives = negatives.select("row", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(negatives, ["row", "w"]).join(anchors.select("row", "anchor_id"), "row").select(*[x.split()[0] for x in schema.split(", ")])
