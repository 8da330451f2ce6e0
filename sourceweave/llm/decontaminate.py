"""Benchmark decontamination: benchmark items found in texts with a few edits.

Pigeonhole: an item with at most k edits, cut into k + 1 pieces, leaves one piece whole. All pieces of a block of items
form one automaton; where a piece is hit, the item is compared with the text around it by Myers' bit-parallel distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed for each character of an item.
RATE = 0.06
#: Bytes of items that one block may hold; more items are scanned in several blocks.
BLOCK_BYTES = 8_000_000


def folded(text: str | None) -> str:
    """Lower case, white space runs as one space."""
    return " ".join((text or "").lower().split())


def _masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_end(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least distance of the item to any part of ``text``, and the (last-first) end where it is reached."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(across | plus)
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        if score < best:
            best, end = score, at
    return best, end


class Block:
    """A block of items ready to be searched for."""

    def __init__(self, items: list[tuple[object, str]], rate: float) -> None:
        self.items = [(key, text, max(0, int(len(text) * rate))) for key, text in ((k, folded(t)) for k, t in items) if text]
        self.masks = [(_masks(t), _masks(t[::-1])) for _, t, _ in self.items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.items):
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                places.setdefault(text[a:b], []).append((n, a))
        self.found = ahocorasick.Automaton()
        for piece, at in places.items():
            self.found.add_word(piece, (len(piece), at))
        self.any = bool(places)
        if self.any:
            self.found.make_automaton()

    def search(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item, distance, start, end) of the best place of each item found in the folded text."""
        if not self.any or not text:
            return []
        starts: dict[int, list[int]] = {}
        for last, (size, places) in self.found.iter(text):
            for n, offset in places:
                starts.setdefault(n, []).append(last + 1 - size - offset)
        out = []
        for n, at in starts.items():
            key, item, k = self.items[n]
            best = None
            for a, b in _windows(sorted(set(at)), len(item), k, len(text)):
                distance, end = best_end(self.masks[n][0], len(item), text[a:b])
                if distance <= k and (best is None or distance < best[0]):
                    back = best_end(self.masks[n][1], len(item), text[a : a + end][::-1])[1]
                    best = (distance, a + end - back, a + end)
            if best:
                out.append((key, *best))
        return out


def _windows(starts: list[int], m: int, k: int, size: int) -> Iterator[tuple[int, int]]:
    """Parts of the text around the starts, joined where they overlap."""
    a = b = None
    for s in starts:
        lo, hi = max(0, s - k), min(size, s + m + k)
        if b is not None and lo <= b:
            b = hi
            continue
        if b is not None:
            yield a, b
        a, b = lo, hi
    if b is not None:
        yield a, b


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of bounded size; each is collected by itself."""
    rows = items.select("item_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    for b in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]


def leaks(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, start, end): each item found in each row, at its best place.

    Positions are code points of the folded text, end exclusive. At most ``rate`` edits a character. Null and empty
    texts hold nothing, null and empty items are found nowhere; repeated rows and items are reported each.
    """
    kind = dict(items.dtypes)["item_id"]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {kind}, distance int, start int, end int"
    out = None
    for block in _blocks(items):

        def search(batches, block=block):
            ready = Block(block, rate)
            for batch in batches:
                rows = [(i, *hit) for i, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True) for hit in ready.search(folded(text.as_py()))]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                types = [batch.schema.field("doc_id").type, items_type, pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "distance", "start", "end"])

        items_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
        found = docs.select("doc_id", "text").mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """Rows of ``docs``, with all their columns, in whose text no item is found."""
    out = docs
    for block in _blocks(items):

        def clean(batches, block=block):
            ready = Block(block, rate)
            for batch in batches:
                keep = np.array([not ready.search(folded(t.as_py())) for t in batch["text"]], bool)
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(clean, docs.schema)
    return out
