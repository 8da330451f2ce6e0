"""Training-order materialisation: token sequences at permuted slots in fixed-stride shards.

Sequences get a dense number from the scan, a keyed Feistel network with cycle-walking turns the number into a slot,
and each range of slots becomes one shard of equally long records, so the training order is read from front to back and
taken up again at any slot by arithmetic.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, stored

#: Tokens of a sequence, sequences of a shard, sequences of one stored block.
LENGTH, PER_SHARD, PER_BLOCK = 512, 1024, 128
#: Shards of a task, at least and at most (about a megabyte each).
LEAST_SHARDS, MOST_SHARDS = 8, 256
ROUNDS = 4
#: Before the tokens of a record: doc_id, part of the document, tokens used.
HEAD = np.dtype([("doc_id", "<i8"), ("part", "<i4"), ("n", "<i4")])
TOKENS = "doc_id long, chunk string, at long, part int, n int, data binary"


@dataclass(frozen=True)
class Tokenizer:
    """A byte-pair vocabulary of ranks, with the id that ends a document."""

    ranks: dict[bytes, int]
    pattern: str
    end: int

    def encoding(self):
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})


def load_tokenizer(path: str | None = None, pattern: str | None = None) -> Tokenizer:
    """Read a ranks file; by default that of the installed public tokenizers. The first free id ends documents."""
    if path is None:
        import public_tokenizers

        path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return Tokenizer(ranks, pattern, max(ranks.values()) + 1)


def record_type(end: int, length: int) -> np.dtype:
    """A record: head and ``length`` ids of two bytes (four in large vocabularies), of one stride throughout."""
    return np.dtype([*HEAD.descr, ("ids", "<u2" if end < 65_536 else "<u4", (length,))])


def _tokenize(tokenizer: Tokenizer, length: int):
    kind = record_type(tokenizer.end, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, pack = tokenizer.encoding(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            chunk, at = uuid.uuid4().hex, 0
            texts, doc_ids = batch["text"].to_pylist(), batch["doc_id"].to_pylist()
            for a in range(0, len(texts), 500):
                rows: list[tuple] = []
                for doc_id, text in zip(doc_ids[a : a + 500], texts[a : a + 500], strict=True):
                    ids = np.array([*encoding.encode_ordinary(text or ""), tokenizer.end], kind["ids"].base)
                    for part, start in enumerate(range(0, len(ids), length)):
                        some = ids[start : start + length]
                        rows.append((doc_id, chunk, at, part, len(some), pack.compress(some.tobytes())))
                        at += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()], strict=True)],
                    ["doc_id", "chunk", "at", "part", "n", "data"],
                )

    return run


def slots(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of each number below ``n``: a permutation of 0..n-1 that ``key`` picks."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(xxhash.xxh3_64_intdigest(f"{key}:{r}".encode())) for r in range(ROUNDS)]

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return left << np.uint64(half) | right

    out = network(index.astype(np.uint64))
    while (outside := np.flatnonzero(out >= np.uint64(n))).size:  # the domain is at most four times n
        out[outside] = network(out[outside])
    return out.astype(np.int64)


def sequences(docs: DataFrame, tokenizer: Tokenizer, length: int = LENGTH) -> DataFrame:
    """(doc_id, part, n, data, index): token sequences of ``docs`` (doc_id, text, any others), written, densely numbered.

    Each document ends with the end id and starts a new sequence; a null or empty text is the end id alone. Repeated
    rows are documents each; a null doc_id is stored as the least long. ``index`` follows the chunks of
    the scan, in order of their least id (and what its sequence holds), so the same files give the same order.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), "text")
    tokens = stored(rows.mapInArrow(_tokenize(tokenizer, length), TOKENS), "tokens")
    chunks = tokens.groupBy("chunk").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("doc_id", "at", F.xxhash64("data"))).alias("first"))
    order = Window.orderBy("first", "size", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each batch of the scan
    starts = staged(chunks.select("chunk", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("start")), "chunk-starts")
    return tokens.join(starts, "chunk").select("doc_id", "part", "n", "data", (F.col("start") + F.col("at")).alias("index"))


def write_shards(numbered: DataFrame, n: int, tokenizer: Tokenizer, key: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """(shard, first_slot, records, data): the written shards of ``n`` numbered sequences, blocks in order of slots.

    Tasks take ranges of neighbouring shards, ``LEAST_SHARDS`` to ``MOST_SHARDS`` of them, so that the number of tasks
    grows with the data and a task does not; its rows are sorted by slot with spilling and pass one block at a time.

    ``data`` holds whole records of one stride; slot s lies in shard s // per_shard, block (s % per_shard) //
    PER_BLOCK, at stride * (s % PER_BLOCK) of its data. Ids after the last used one are the end id.
    """
    kind = record_type(tokenizer.end, length)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = slots(batch["index"].to_numpy(), n, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard), pa.array(slot), *(batch[c] for c in ("doc_id", "part", "n", "data"))], ["shard", "slot", "doc_id", "part", "n", "data"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        block, first = np.empty(PER_BLOCK, kind), None

        def out(count: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"shard": [first // per_shard], "first_slot": [first], "records": pa.array([count], pa.int32()), "data": [block[:count].tobytes()]})

        held = 0
        for batch in batches:
            for slot, doc_id, part, used, data in zip(*(batch[c].to_pylist() for c in ("slot", "doc_id", "part", "n", "data")), strict=True):
                if held and slot // PER_BLOCK != first // PER_BLOCK:
                    yield out(held)
                    held = 0
                if not held:
                    first = slot
                row = block[held]
                row["doc_id"], row["part"], row["n"] = doc_id, part, used
                row["ids"][:used] = np.frombuffer(unpack.decompress(data), kind["ids"].base)
                row["ids"][used:] = tokenizer.end
                held += 1
        if held:
            yield out(held)

    placed = numbered.select("index", "doc_id", "part", "n", "data").mapInArrow(place, "shard long, slot long, doc_id long, part int, n int, data binary")
    # slots are dense, so the bounds of the ranges are known: task t takes the shards from t * run on, and files follow the slots
    shards = max(1, -(-n // per_shard))
    run = min(MOST_SHARDS, max(LEAST_SHARDS, -(-shards // (4 * numbered.sparkSession.sparkContext.defaultParallelism))))
    ranged = placed.repartitionById(-(-shards // run), F.expr(f"cast(shard div {run} AS int)")).sortWithinPartitions("slot")
    return stored(ranged.mapInArrow(fill, "shard long, first_slot long, records int, data binary"), "shards")


def read_records(shards: DataFrame, tokenizer: Tokenizer, length: int = LENGTH, start: int = 0) -> DataFrame:
    """(slot, doc_id, part, n, ids) of all records from slot ``start`` on; blocks before it are not read."""
    kind = record_type(tokenizer.end, length)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch["first_slot"].to_pylist(), batch["data"], strict=True):
                records = np.frombuffer(data.as_buffer(), kind)
                slot = np.arange(first, first + len(records))
                keep = slot >= start
                records, slot = records[keep], slot[keep]
                used = records["n"].astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(used)]).astype(np.int32)
                flat = records["ids"][np.arange(length) < used[:, None]].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), pa.array(records["doc_id"]), pa.array(records["part"]), pa.array(records["n"]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    ["slot", "doc_id", "part", "n", "ids"],
                )

    wanted = shards.where(F.col("first_slot") > start - PER_BLOCK).select("first_slot", "data")
    return wanted.mapInArrow(read, "slot long, doc_id long, part int, n int, ids array<int>")


def materialise(docs: DataFrame, tokenizer: Tokenizer, key: int = 1, length: int = LENGTH) -> DataFrame:
    """The shards of ``docs`` in the training order that ``key`` picks; an empty table gives none."""
    numbered = sequences(docs, tokenizer, length)
    return write_shards(numbered, numbered.count(), tokenizer, key, length)
