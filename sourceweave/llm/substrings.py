"""Substring dedup: word windows that occur twice anywhere, found over difference-cover anchors.

Anchors are short windows at positions that belong to a difference cover modulo a period. Any two equal windows of the
full length contain two equal anchors at the same offset, so windows near no repeated anchor are unique and never
leave their task. The others are extended to the full window and matched by a 96-bit or longer hash. Three passes:

1. each scan task sends its anchors, packed by hash bucket; a bucket tells each block of documents which repeat;
2. blocks of documents (dealt by row hash, so a pass can be run again) send the full windows about repeated anchors;
3. blocks take out the words that repeated windows cover.

A bucket holds part of the hash range, not of the documents: a passage in a third of all rows adds rows to its
bucket, each of 8 bytes, and no pair is ever formed. Blocks and buckets grow in number with the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .word_hashes import WordHashes, as_bytes, mix64, pieces

WINDOW = 35
#: Perfect difference sets: every shift modulo the period is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 6, 8, 18)}
#: Characters of text in a block, and in the range of a bucket.
BLOCK_CHARS, BUCKET_CHARS, LEAST_BLOCKS, LEAST_BUCKETS = 8_000_000, 20_000_000, 64, 256
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))


def period_for(window: int) -> int:
    """The longest period that leaves anchors of at least three eighths of the window."""
    return max(v for v in COVERS if window - v + 1 >= max(1, window * 3 // 8))


class Words:
    """Words of some texts, end to end, with the hash of every window."""

    def __init__(self, texts: list[bytes], known: WordHashes) -> None:
        self.parts = [t.split() for t in texts]
        self.sizes = np.array([len(p) for p in self.parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.hashes = known.of([w for p in self.parts for w in p])

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word, its place in its text and the number of words from it to the end."""
        n = len(self.hashes)
        place = np.arange(n) - np.repeat(self.starts[:-1], self.sizes)
        return place, np.repeat(self.sizes, self.sizes) - place

    def windows(self, width: int, which: int = 0) -> np.ndarray:
        """Hash of the ``width`` words from each place (of no meaning where fewer are left)."""
        h = self.hashes if which == 0 else mix64(self.hashes + np.uint64(which))
        n = len(h)
        if n < width:
            return np.zeros(n, np.uint64)
        power = np.full(n, BASES[which])
        power[0] = 1
        power = np.multiply.accumulate(power)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power, dtype=np.uint64)])
        inverse = np.full(n, np.uint64(pow(int(BASES[which]), -1, 2**64)))
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        out = np.zeros(n, np.uint64)
        out[: n - width + 1] = (upto[width:] - upto[:-width]) * inverse[: n - width + 1]
        return mix64(out)


def _anchors(w: Words, window: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors and their keys, bucket in the upper and 32 bits of hash in the lower half."""
    period = period_for(window)
    place, left = w.rest()
    width = window - period + 1
    at = np.flatnonzero(np.isin(place % period, COVERS[period]) & (left >= width) & (place + left >= window))
    h = w.windows(width)[at]
    return at, ((h >> np.uint64(32)) % np.uint64(n_buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def _send_anchors(window: int, n_buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            texts, blocks = as_bytes(batch["text"]), batch["block"].to_numpy()
            for part in pieces(texts):
                w = Words(texts[part], known)
                at, keys = _anchors(w, window, n_buckets)
                owner = np.repeat(blocks[part].astype(np.uint32), w.sizes)[at]
                order = np.argsort(keys, kind="stable")
                keys, owner = keys[order], owner[order]
                # a key needs to be sent twice at most for each block
                same = np.zeros(len(keys), bool)
                same[2:] = (keys[2:] == keys[:-2]) & (owner[2:] == owner[:-2]) & (owner[2:] == owner[1:-1])
                keys, owner = keys[~same], owner[~same]
                packed = np.empty(len(keys), [("value", "<u4"), ("block", "<u4")])
                packed["value"], packed["block"] = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), owner
                yield from _by_bucket((keys >> np.uint64(32)).astype(np.int64), packed, {})

    return send


def _by_bucket(bucket: np.ndarray, values: np.ndarray, more: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket of the sorted ``bucket``, its values packed."""
    names, first = np.unique(bucket, return_index=True)
    ends = np.append(first[1:], len(bucket))
    data = [values[a:b].tobytes() for a, b in zip(first, ends, strict=True)]
    columns = {"bucket": pa.array(names, pa.int64())} | {k: pa.array(np.full(len(names), v), pa.int64()) for k, v in more.items()}
    if data:
        yield pa.RecordBatch.from_pydict(columns | {"data": pa.array(data, pa.binary())})


def _repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def _answer(values: np.ndarray, blocks: np.ndarray, kind: int) -> pa.Table:
    """A row for each block that holds a repeated value: those values, sorted."""
    again = _repeated(values)
    values, blocks = values[again], blocks[again]
    order = np.lexsort((values, blocks))
    values, blocks = values[order], blocks[order]
    names, first = np.unique(blocks, return_index=True)
    parts = [np.unique(p).tobytes() for p in np.split(values, first[1:])] if len(names) else []
    return pa.table({"block": pa.array(names.astype(np.int64)), "kind": pa.array(np.full(len(names), kind), pa.int32()), "data": pa.array(parts, pa.binary())})


def _answer_anchors(table: pa.Table) -> pa.Table:
    packed = np.frombuffer(b"".join(table["data"].to_pylist()), [("value", "<u4"), ("block", "<u4")])
    bucket = np.uint64(table["bucket"][0].as_py() << 32)
    return _answer(packed["value"].astype(np.uint64) | bucket, packed["block"], 0)


def _answer_windows(table: pa.Table) -> pa.Table:
    parts = table["data"].to_pylist()
    blocks = np.repeat(table["block"].to_numpy(), [len(p) // 8 for p in parts])
    return _answer(np.frombuffer(b"".join(parts), "<u8"), blocks, 1)


def _sorted(table: pa.Table) -> pa.Table:
    """The rows of a block in an order that every pass repeats."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _told(answers: pa.Table, kind: int) -> np.ndarray:
    return np.frombuffer(b"".join(d for d, k in zip(answers["data"].to_pylist(), answers["kind"].to_pylist(), strict=True) if k == kind), "<u8")


def _near_anchors(w: Words, answers: pa.Table, window: int, n_buckets: int) -> np.ndarray:
    """Places from which a full window holds a repeated anchor."""
    at, keys = _anchors(w, window, n_buckets)
    at = at[np.isin(keys, _told(answers, 0))]
    place, left = w.rest()
    change = np.zeros(len(place) + 1, np.int64)
    np.add.at(change, at - np.minimum(place[at], period_for(window) - 1), 1)
    np.add.at(change, at + 1, -1)
    return np.flatnonzero((np.cumsum(change[:-1]) > 0) & (left >= window))


def _send_windows(window: int, n_buckets: int):
    def send(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and answers.num_rows:
            rows, known = _sorted(rows), WordHashes()
            texts, told = as_bytes(rows["text"]), []
            for part in pieces(texts):
                w = Words(texts[part], known)
                at = _near_anchors(w, answers, window, n_buckets)
                told.append(np.stack([w.windows(window, 1)[at] % np.uint64(n_buckets), w.windows(window)[at]]))
            bucket, values = np.concatenate(told, axis=1)
            order = np.lexsort((values, bucket))
            bucket, values = bucket[order], values[order]
            extra = np.zeros(len(values), bool)
            extra[2:] = (values[2:] == values[:-2]) & (bucket[2:] == bucket[:-2])
            block = rows["block"][0].as_py()
            out = list(_by_bucket(bucket[~extra].astype(np.int64), values[~extra], {"block": block}))
        schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])
        return pa.Table.from_batches(out, schema)

    return send


def _cut(window: int, n_buckets: int):
    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows, known = _sorted(rows), WordHashes()
        texts, repeated = as_bytes(rows["text"]), np.sort(_told(answers, 1))
        n_words, n_removed, kept = [], [], []
        for part in pieces(texts):
            w = Words(texts[part], known)
            n = len(w.hashes)
            change = np.zeros(n + 1, np.int64)
            if len(repeated):
                at = _near_anchors(w, answers, window, n_buckets)
                at = at[np.isin(w.windows(window)[at], repeated)]
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
            gone = np.cumsum(change[:-1]) > 0
            for i, parts in enumerate(w.parts):
                mine = gone[w.starts[i] : w.starts[i + 1]]
                n_words.append(len(parts))
                n_removed.append(int(mine.sum()))
                kept.append(b" ".join(p for p, g in zip(parts, mine, strict=True) if not g) if n_removed[-1] else b" ".join(parts))
        return pa.table({"doc_id": rows["doc_id"].cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return cut


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of ``docs`` (doc_id, text, any others).

    A word goes if a window of ``window`` words that covers it has the same words as another window anywhere,
    in the same text or another; all windows are judged on the input. ``kept`` is the rest, joined by one space. A null
    text has no words. Repeated rows repeat each other and lose all windows; texts shorter than a window stay whole.
    """
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks, n_buckets = max(LEAST_BLOCKS, -(-total // BLOCK_CHARS)), max(LEAST_BUCKETS, -(-total // BUCKET_CHARS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)))

    answer = "block long, kind int, data binary"
    anchors = rows.select("text", "block").mapInArrow(_send_anchors(window, n_buckets), "bucket long, data binary")
    near = staged(anchors.groupBy("bucket").applyInArrow(_answer_anchors, answer), "repeated-anchors")
    by_block = rows.groupBy("block")
    windows = by_block.cogroup(near.groupBy("block")).applyInArrow(_send_windows(window, n_buckets), "bucket long, block long, data binary")
    full = staged(windows.groupBy("bucket").applyInArrow(_answer_windows, answer), "repeated-windows")
    both = near.union(full)
    return by_block.cogroup(both.groupBy("block")).applyInArrow(_cut(window, n_buckets), "doc_id long, n_words long, n_removed long, kept string")
