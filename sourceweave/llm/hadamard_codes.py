"""Product codes of vectors, searched exactly in the integer Walsh-Hadamard domain.

A vector is cut into parts, each with a codebook of its own. Parts and entries, filled up with zeros to a power of two
m, are transformed; squared distances are then m times the plain ones. They are summed coefficient by coefficient in
sequency order (slow changes first). A partial sum only grows, so an entry goes as soon as it exceeds the full distance
of the entry that led after the first coefficient. All arithmetic is on 64-bit integers.

Codebooks are learned by rounds of assignment: each task sums the parts of each entry, and only these sums (parts x
entries x components, whatever the input) are shuffled and reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import matrix, scaled, usable, width


@dataclass(frozen=True)
class Rule:
    """``factor`` scales components before they are floored."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    factor: int = 4096


def sequency_transform(x: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard transform of each row, filled up to a power of two, in order of sign changes."""
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    out = np.zeros((len(x), size), np.int64)
    out[:, : x.shape[1]] = x
    signs = np.ones((1, 1), np.int64)
    half = 1
    while half < size:
        pairs = out.reshape(len(x), size // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), size)
        signs = np.block([[signs, signs], [signs, -signs]])
        half *= 2
    changes = (signs[:, 1:] != signs[:, :-1]).sum(1)
    return out[:, np.argsort(changes, kind="stable")]


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row (ties: the lower one) and the scaled squared distance; all transformed."""
    partial = (rows[:, :1] - entries[None, :, 0]) ** 2
    guess = partial.argmin(1)
    bound = ((rows - entries[guess]) ** 2).sum(1)

    def open_(total, i, j):
        return (total < bound[i]) | ((total == bound[i]) & (j <= guess[i]))

    i, j = (x.ravel() for x in np.indices(partial.shape))
    total = partial.ravel()
    for q in range(1, rows.shape[1] + 1):
        stays = open_(total, i, j)
        i, j, total = i[stays], j[stays], total[stays]
        if q < rows.shape[1]:
            total = total + (rows[i, q] - entries[j, q]) ** 2
    order = np.lexsort((j, total, i))
    first = order[np.searchsorted(i[order], np.arange(len(rows)))]
    return j[first], total[first]


def _cut(column: pa.Array, parts: int, wide: int) -> list[np.ndarray]:
    """The parts of each row, each ``wide`` components."""
    whole = matrix(column, parts * wide)
    return [whole[:, p * wide : (p + 1) * wide] for p in range(parts)]


def _assign(parts: list[np.ndarray], books: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for rows, book in zip(parts, books, strict=True):
        index, far = nearest(sequency_transform(rows), sequency_transform(book))
        yield index, far // (1 << max(0, rows.shape[1] - 1).bit_length())


def _learn(kept: DataFrame, books: list[np.ndarray], wide: int) -> list[np.ndarray]:
    """One round: each entry becomes the floored mean of its parts."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), wide + 1), np.int64) for b in books]  # the last is the count
        for batch in batches:
            parts = _cut(batch["x"], len(books), wide)
            for rows, (index, _), at in zip(parts, _assign(parts, books), total, strict=True):
                np.add.at(at, index, np.column_stack([rows, np.ones(len(rows), np.int64)]))
        part, entry = np.indices((len(books), len(books[0]))).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array([r.tolist() for t in total for r in t], pa.list_(pa.int64()))], ["part", "entry", "sums"])

    each = kept.select("x").mapInArrow(sums, "part long, entry long, sums array<long>").select("part", "entry", F.posexplode("sums").alias("i", "v"))
    at = {(r.part, r.entry, r.i): r.v for r in each.groupBy("part", "entry", "i").agg(F.sum("v").alias("v")).collect()}
    out = [b.copy() for b in books]
    for p, book in enumerate(out):
        for e in range(len(book)):
            if n := at.get((p, e, wide), 0):
                book[e] = [at[p, e, i] // n for i in range(wide)]
    return out


def codebook_text(books: list[np.ndarray]) -> str:
    return ",".join(str(v) for b in books for v in b.ravel().tolist())


def compress(vectors: DataFrame, rule: Rule | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error), codebooks by part) of ``vectors`` (vec_id, embedding, label, any others).

    Rows whose vector is null or holds null or non-finite components go. ``code`` has two hexadecimal digits a part,
    ``error`` is the squared distance summed over parts. Codebooks start from the least ids (of a repeated id, its
    least vector; null ids come last); with fewer ids than entries they have that many. Vectors shorter than the longest,
    and lengths that the parts do not divide, are filled up with zeros. Repeated rows are coded each. An empty table
    gives no rows and no codebooks. Other columns are not looked at.
    """
    rule = rule or Rule()
    kept = vectors.where(usable(F.col("embedding"))).select("vec_id", "label", scaled(F.col("embedding"), rule.factor).alias("x"))
    kept = stored(kept, "code-vectors")
    spark = kept.sparkSession
    longest = width(kept, "x")
    wide = max(1, -(-longest // rule.parts))
    least = kept.groupBy("vec_id").agg(F.min("x").alias("x")).orderBy(F.col("vec_id").asc_nulls_last()).limit(rule.entries).collect()
    schema = "vec_id long, label {}, code string, error long".format(kept.schema["label"].dataType.simpleString())
    if not least:
        return spark.createDataFrame([], schema), []
    start = np.zeros((len(least), rule.parts * wide), np.int64)
    for row, r in zip(start, least, strict=True):
        row[: len(r.x)] = r.x
    books = [start[:, p * wide : (p + 1) * wide].copy() for p in range(rule.parts)]
    for _ in range(rule.rounds):
        books = _learn(kept, books, wide)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_assign(_cut(batch["x"], rule.parts, wide), books))
            digits = np.array([f"{e:02x}" for e in range(rule.entries)])
            text = digits[found[0][0]]
            for index, _ in found[1:]:
                text = np.char.add(text, digits[index])
            error = sum(far for _, far in found)
            yield pa.RecordBatch.from_arrays([batch["vec_id"].cast(pa.int64()), batch["label"], pa.array(text.tolist(), pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return kept.mapInArrow(code, schema), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the errors summed over rows of equal label (nulls are one label)."""
    codes = stored(codes, "codes")
    totals = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(totals, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(codebook_text(books).encode()).hexdigest()
