"""Interpolated modified Kneser-Ney word-pair model, counted and applied in Spark.

Texts are cut into pieces of some megabytes. A piece is tokenised once and written as word numbers with a list of its
distinct word hashes; all later steps read that. Of each piece, the distinct pairs go as sorted hashes, delta-coded, to
the shard of their hash range. A shard adds up the training counts, stores them as sorted hash arrays (``Model.shards``),
and answers every piece: it maps its arrays into memory from a file and finds the piece's hashes by binary search. So a
pair that stands in very many texts travels once a piece, whatever its number, and no worker needs more than a shard.

What depends on single words (plain and continuation counts, context totals by count class) goes the same way: pieces
send sums by word hash, shards add them up, store them and answer. A pair's count enters these sums through the first
piece that holds it, which the pair's shard names.

Discounts follow counts of counts: Y = n1 / (n1 + 2 n2), D_k = k - (k + 1) Y n_(k+1) / n_k for k = 1, 2, 3 and more, and
k / 2 where these counts allow none. A pair's probability is its discounted share of the context's count, plus the
context's freed mass times the word's probability; that is the same over continuation counts, with the rest spread
evenly over the vocabulary and one unknown word. A context that was never seen leaves the word's probability.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, staged
from .word_hashes import WordHashes, as_bytes, mix64
from .word_hashes import pieces as cut

#: Bytes of text in a piece, and tokens for each shard, about.
PIECE_BYTES, SHARD_TOKENS = 8_000_000, 2_000_000
#: Words whose hashes a task remembers.
REMEMBERED = 150_000
#: Bits of a pair's hash. Two pairs of 10**9 share one with chance 1e-8 each.
BITS = 56
END, START = np.uint64(0x9D3B5F8A6C21E407), np.uint64(0x51E0C7B4A9D2F683)


@dataclass
class Model:
    """Sorted hash arrays of pairs and of words by shard (shard, body), the sums over them, and how many shards there are."""

    pairs: DataFrame
    words: DataFrame
    totals: dict[str, int]
    n: int


# --- arrays in binary columns


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative numbers, each by byte planes of the least width."""
    parts = []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        size = next(s for s in (1, 2, 3, 4, 5, 6, 7, 8) if top < 1 << 8 * s)
        planes = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size].T
        parts += [np.array([len(a), size], "<u8").tobytes(), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(body: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(body), 0, []
    while at < len(data):
        n, size = np.frombuffer(data, "<u8", 2, at).astype(int)
        planes = np.frombuffer(data, np.uint8, n * size, at + 16).reshape(size, n)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :size] = planes.T
        out.append(wide.view("<u8").ravel())
        at += 16 + n * size
    return out


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.uint64(0))


def mapped(values: np.ndarray) -> np.ndarray:
    """``values`` in a memory-mapped file, which has no name and goes with its last reader."""
    if not len(values):
        return values
    with tempfile.TemporaryFile() as f:
        f.write(values.tobytes())
        f.flush()
        return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), values.dtype)


# --- pieces


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        texts = as_bytes(batch["text"])
        for part in cut(texts, PIECE_BYTES):
            streams = [np.append(known.of(t.split()), END) for t in texts[part]]
            if len(known) > REMEMBERED:
                known.clear()
            words, numbers = np.unique(np.concatenate(streams), return_inverse=True)
            length = np.array([len(s) for s in streams], np.uint64)
            held = batch["held_out"][part.start : part.stop].to_numpy(zero_copy_only=False).astype(np.uint64)
            body = pack(_steps(words), numbers.astype(np.uint64), length, held)
            ids = batch["doc_id"][part.start : part.stop]
            yield pa.RecordBatch.from_arrays([pa.array([body], pa.binary()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([len(numbers)])], ["body", "ids", "n"])


@dataclass
class Piece:
    """``context`` of a token is the number of the word before it, one past the last number at a text's start."""

    words: np.ndarray
    token: np.ndarray
    context: np.ndarray
    text: np.ndarray
    held: np.ndarray
    trains: np.ndarray

    @classmethod
    def of(cls, body: bytes) -> Piece:
        steps, token, length, held = unpack(body)
        words, token = np.cumsum(steps, dtype=np.uint64), token.astype(np.int64)
        length = length.astype(np.int64)
        context = np.roll(token, 1)
        context[np.cumsum(length) - length] = len(words)
        text = np.repeat(np.arange(len(length)), length)
        return cls(words, token, context, text, held.astype(bool), ~held.astype(bool)[text])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs by hash: hash, context, word, and for each token its pair."""
        n = len(self.words) + 1
        pair, of_token = np.unique(self.context * n + self.token, return_inverse=True)
        context, word = np.divmod(pair, n)
        named = np.append(self.words, START)
        h = mix64(mix64(named[context]) * np.uint64(0x9E3779B97F4A7C15) + named[word]) >> np.uint64(64 - BITS)
        order = np.argsort(h)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return h[order], context[order], word[order], place[of_token]


def read_pieces(docs: DataFrame) -> DataFrame:
    """(piece, body, ids, n), written, of ``docs`` (doc_id, text, held_out)."""
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower_ascii(F.coalesce("text", F.lit(""))).alias("text"), "held_out")
    found = ready.mapInArrow(_tokenise, "body binary, ids array<long>, n long")
    return staged(found.withColumn("piece", F.monotonically_increasing_id()), "pieces")


def _split(number: int, hashes: np.ndarray, columns: list[np.ndarray], shards: int, bits: int) -> list[tuple[int, int, bytes]]:
    """(piece, shard, body) of the sorted hashes and their columns by range of hash."""
    borders = np.array([(s << bits) // shards for s in range(1, shards)], np.uint64)
    ends = [0, *np.searchsorted(hashes, borders).tolist(), len(hashes)]
    return [(number, s, pack(_steps(hashes[a:b]), *(c[a:b] for c in columns))) for s, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]


def _columns(rows: list[tuple[int, int, bytes]]) -> list[pa.Array]:
    piece, shard, body = zip(*rows, strict=True) if rows else ((), (), ())
    return [pa.array(piece, pa.int64()), pa.array(shard, pa.int64()), pa.array(body, pa.binary())]


ROW = "piece long, shard long, body binary"
NAMES = ["piece", "shard", "body"]


def _asker(shards: int):
    """Pairs of each piece by shard: hashes and training counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch["piece"].to_pylist(), batch["body"], strict=True):
                piece = Piece.of(body.as_py())
                h, _, _, of_token = piece.pairs()
                count = np.bincount(of_token[piece.trains], minlength=len(h))
                yield pa.RecordBatch.from_arrays(_columns(_split(number, h, [count], shards, BITS)), NAMES)

    return ask


# --- shards


def _read(group: pa.Table) -> tuple[int, list[int], list[np.ndarray], list[list[np.ndarray]]]:
    """Shard, pieces, and of each piece the hashes and the columns, in order of pieces."""
    group = group.sort_by("piece")
    bodies = [unpack(b.as_py()) for b in group["body"]]
    return group["shard"][0].as_py(), group["piece"].to_pylist(), [np.cumsum(b[0], dtype=np.uint64) for b in bodies], [b[1:] for b in bodies]


def _answers(hashes: np.ndarray, columns: list[np.ndarray], asked: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """For each list of hashes, their values in each column (0 where absent), by binary search in the mapped arrays."""
    hashes, columns = mapped(hashes), [mapped(c.astype(np.uint64)) for c in columns]
    for h in asked:
        at = np.searchsorted(hashes, h)
        at[at == len(hashes)] = 0
        yield [np.where(hashes[at] == h, c[at], 0) if len(hashes) else np.zeros(len(h), np.uint64) for c in columns]


def _merge_pairs(group: pa.Table) -> pa.Table:
    """A shard's sorted arrays (as piece -1), and for each piece the counts of its pairs and which of them it is the first to hold."""
    shard, pieces, asked, given = _read(group)
    every = np.concatenate(asked)
    hashes, first, where = np.unique(every, return_index=True, return_inverse=True)
    counts = np.bincount(where, np.concatenate([g[0] for g in given]).astype(float)).astype(np.uint64)
    leads = np.zeros(len(every), np.uint64)
    leads[first] = 1
    seen = counts > 0
    hashes, counts = hashes[seen], counts[seen]
    rows = [(-1, shard, pack(_steps(hashes), counts))]
    ends = np.cumsum([len(a) for a in asked])
    for piece, end, h, (found,) in zip(pieces, ends, asked, _answers(hashes, [counts], asked), strict=True):
        rows.append((piece, shard, pack(found, leads[end - len(h) : end])))
    return pa.table(_columns(rows), NAMES)


def _merge_words(group: pa.Table) -> pa.Table:
    """As for pairs: the sums of each word, all of them for each piece that holds it; with piece -1 also what they come to."""
    shard, pieces, asked, given = _read(group)
    hashes, where = np.unique(np.concatenate(asked), return_inverse=True)
    sums = [np.bincount(where, np.concatenate([g[i] for g in given]).astype(float)).astype(np.int64) for i in range(len(WORD))]
    plain, joins = sums[0], sums[1]
    of = [plain.sum(), joins.sum(), *[s.sum() for s in sums[3:]], *[(joins == i).sum() for i in (1, 2, 3, 4)], (plain > 0).sum(), (joins > 0).sum()]
    rows = [(-1, shard, pack(_steps(hashes), *sums))]
    rows += [(piece, shard, pack(*found)) for piece, found in zip(pieces, _answers(hashes, sums, asked), strict=True)]
    nothing = [[]] * len(pieces)
    return pa.table([*_columns(rows), pa.array([[int(x) for x in of], *nothing], pa.list_(pa.int64()))], [*NAMES, "sums"])


def _look_up(model: pa.Table, group: pa.Table) -> pa.Table:
    """Answers of a stored shard; no piece leads."""
    if not len(group):
        return pa.table(_columns([]), NAMES)
    shard, pieces, asked, given = _read(group)
    steps, *columns = unpack(model["body"][0].as_py()) if len(model) else [np.empty(0, np.uint64)] * (1 + len(given[0]))
    found = _answers(np.cumsum(steps, dtype=np.uint64), columns, asked)
    return pa.table(_columns([(p, shard, pack(*f, *[np.zeros(len(f[0]), np.uint64)] * (len(f) == 1))) for p, f in zip(pieces, found, strict=True)]), NAMES)


# --- words

CLASSES = [f"n{i}" for i in range(1, 6)]
#: Sums of a word: plain count, words before it, and as a context its count and the pairs of each count class.
WORD = ["plain", "joins", "total", *CLASSES]
TOTALS = ["tokens", "pairs", *CLASSES, "j1", "j2", "j3", "j4", "vocabulary", "seen"]
PIECE, PAIRS, WORDS = 0, 1, 2


def _gather(group: pa.Table, kind: int, n: int) -> list[np.ndarray]:
    """Answers of all shards to a piece, put together."""
    rows = group.filter(pa.compute.equal(group["kind"], kind)).sort_by("shard")
    parts = [unpack(b.as_py()) for b in rows["body"]]
    return [np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(n)]


def _named(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a piece's words and of the start, sorted, and their numbers in the piece."""
    named = np.append(piece.words, START)
    order = np.argsort(named)
    return named[order], order


def _word_asker(shards: int):
    """What a piece adds to the sums of each of its words, and of the text's start."""

    def ask(group: pa.Table) -> pa.Table:
        whole = group.filter(pa.compute.equal(group["kind"], PIECE))
        piece = Piece.of(whole["body"][0].as_py())
        counts, leads = _gather(group, PAIRS, 2)
        _, context, word, _ = piece.pairs()
        n, mine = len(piece.words) + 1, (leads > 0) & (counts > 0)
        context, word, counts = context[mine], word[mine], counts[mine]
        sums = [np.bincount(piece.token[piece.trains], minlength=n), np.bincount(word, minlength=n), np.bincount(context, counts, n)]
        sums += [np.bincount(context[counts == i] if i < 5 else context[counts >= 5], minlength=n) for i in range(1, 6)]
        hashes, order = _named(piece)
        return pa.table(_columns(_split(whole["piece"][0].as_py(), hashes, [s[order].astype(np.uint64) for s in sums], shards, 64)), NAMES)

    return ask


def discounts(n: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and more, from how many items have counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0
    found = [k - (k + 1) * y * n[k] / n[k - 1] if y and n[k - 1] else k / 2 for k in (1, 2, 3)]
    return [d if 0 < d < k else k / 2 for k, d in zip((1, 2, 3), found, strict=True)]


def _cut_off(count: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3)]


def _scorer(t: dict[str, int]):
    """Scores of a piece's texts, from its pairs' counts and its words' sums."""
    pair_d, word_d = discounts([t[f"n{i}"] for i in (1, 2, 3, 4)]), discounts([t[f"j{i}"] for i in (1, 2, 3, 4)])
    freed = word_d[0] * t["j1"] + word_d[1] * t["j2"] + word_d[2] * (t["seen"] - t["j1"] - t["j2"])

    def score(group: pa.Table) -> pa.Table:
        whole = group.filter(pa.compute.equal(group["kind"], PIECE))
        piece = Piece.of(whole["body"][0].as_py())
        counts = _gather(group, PAIRS, 1)[0]
        _, context, word, of_token = piece.pairs()
        v = {}
        for name, values in zip(WORD, _gather(group, WORDS, len(WORD)), strict=True):
            v[name] = np.empty(len(values), np.int64)
            v[name][_named(piece)[1]] = values
        even = 1 / (t["vocabulary"] + 1)
        share = np.full(len(v["plain"]), even)
        if t["pairs"]:
            share = (v["joins"] - _cut_off(v["joins"], word_d) + freed * even) / t["pairs"]
        known = v["total"] > 0
        total = np.where(known, v["total"], 1)
        rest = np.where(known, (pair_d[0] * v["n1"] + pair_d[1] * v["n2"] + pair_d[2] * (v["n3"] + v["n4"] + v["n5"])) / total, 1.0)
        p = (counts - _cut_off(counts, pair_d)) / total[context] + rest[context] * share[word]
        base = np.log10((v["plain"] + 1) / (t["tokens"] + t["vocabulary"] + 1))
        n = len(piece.held)
        of = lambda x: np.bincount(piece.text, x, n)
        columns = [of(np.ones(len(piece.token))).astype(np.int64), of((v["plain"] > 0)[piece.token].astype(float)).astype(np.int64), of(base[piece.token]), of(np.log10(p)[of_token])]
        return pa.table([whole["ids"].combine_chunks().flatten(), pa.array(piece.held), *map(pa.array, columns)], RESULT)

    return score


RESULT = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _shards(pieces: DataFrame) -> int:
    return max(1, (pieces.agg(F.sum("n")).first()[0] or 0) // SHARD_TOKENS)


def _with_answers(pieces: DataFrame, pairs: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Pieces and the answers to them in one table, told apart by ``kind``."""
    all_ = pieces.select("piece", F.lit(-1).cast("long").alias("shard"), "body", "ids", F.lit(PIECE).alias("kind"))
    for kind, rows in ((PAIRS, pairs), (WORDS, words)):
        if rows is not None:
            all_ = all_.union(rows.select(*NAMES, F.lit(None).cast("array<long>").alias("ids"), F.lit(kind).alias("kind")))
    return all_


def _fit(pieces: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the training texts of ``pieces``, and what it answers to these: pairs and words."""
    n = _shards(pieces)
    asked = pieces.select("piece", "body").mapInArrow(_asker(n), ROW)
    pairs = staged(asked.groupBy("shard").applyInArrow(_merge_pairs, ROW), "pair-counts")
    mine = pairs.where("piece >= 0")
    asked = _with_answers(pieces, mine).groupBy("piece").applyInArrow(_word_asker(n), ROW)
    words = staged(asked.groupBy("shard").applyInArrow(_merge_words, ROW + ", sums array<long>"), "word-counts")
    sums = words.where("piece < 0").select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    totals = dict.fromkeys(TOTALS, 0) | {TOTALS[r.i]: r.v for r in sums}
    stored = lambda df: df.where("piece < 0").select("shard", "body")
    return Model(stored(pairs), stored(words), totals, n), mine, words.where("piece >= 0").select(*NAMES)


def _scores(pieces: DataFrame, pairs: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    found = _with_answers(pieces, pairs, words).groupBy("piece").applyInArrow(_scorer(model.totals), SCORES)
    return found.withColumn("train_tokens", F.lit(model.totals["tokens"]).cast("long"))


def held_out(doc_id, parts: int = 7, part: int = 2):
    """Whether a document is kept from training, by the checksum of its id; a null id trains."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """A model of all rows of ``docs`` (doc_id, text); null and empty texts are one end each."""
    return _fit(read_pieces(docs.select("doc_id", "text", F.lit(False).alias("held_out"))))[0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score, train_tokens) of other texts under ``model``; held_out is true."""
    pieces = read_pieces(docs.select("doc_id", "text", F.lit(True).alias("held_out")))

    def answers(asked: DataFrame, shards: DataFrame) -> DataFrame:
        return staged(shards.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_look_up, ROW), "answers")

    pairs = answers(pieces.select("piece", "body").mapInArrow(_asker(model.n), ROW), model.pairs)
    words = answers(_with_answers(pieces, pairs).groupBy("piece").applyInArrow(_word_asker(model.n), ROW), model.words)
    return _scores(pieces, pairs, words, model)


def score_corpus(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, any others) scored by a model of those that ``held_out`` leaves, in one pass over the texts.

    Per row: doc_id, held_out, n_tokens (words and one end), n_known (of them known from training), train_tokens,
    base_score (add-one unigram) and score (this model), both the log10 probability of the text. Letters A-Z are
    lower-cased. Null and empty texts are one end; repeated rows count and are scored each. An empty table gives no rows.
    Other columns are not looked at.
    """
    pieces = read_pieces(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")))
    model, answers, words = _fit(pieces)
    return _scores(pieces, answers, words, model)
