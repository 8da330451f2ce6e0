"""SentencePiece encoding and decoding over shared prefixes.

Texts are cut into marked words; the distinct words of a batch are sorted, which walks their trie depth first, and the
forward state of every prefix is kept on a stack, so a prefix that many words share is worked out once.

A unigram model takes the classic Viterbi state, the best score of each prefix. In a BPE model scores are merge ranks
whose best sum is not the model's encoding, so there the state of a prefix is the last piece of its encoding: of the
pieces that end there, the one whose seam with the piece before it no earlier merge would have crossed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
#: Encoded words, and seams, that a task keeps from one part of its texts to the next.
KNOWN_WORDS = 500_000
#: Characters of text encoded at a time.
PIECE_CHARS = 12_000_000


def default_model() -> str:
    """Model file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    """What encoding needs of a model; its size is bounded by the model's."""

    pieces: list[str]
    ranks: dict[str, float]
    ids: dict[str, int]
    bytes_from: int
    unknown: int
    bpe: bool
    prefix: bool
    spines: dict[str, tuple[list[str], list[str]]]

    @property
    def longest(self) -> int:
        return max(map(len, self.ids))


def load(path: str) -> Vocabulary:
    """Read a model file (unigram or BPE, no normalisation rules, white space kept)."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
    if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("models that normalise texts are not supported")
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    usual = {i: p for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
    first_byte = next((i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE), -1)
    unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
    ids = {p.piece: i for i, p in usual.items()}
    if any(MARK in p.lstrip(MARK) for p in ids):
        raise ValueError("models with the mark inside a piece are not supported")
    bpe = proto.trainer_spec.model_type == 2
    ranks = {p.piece: -p.score if bpe else p.score for p in usual.values()}
    spines = {}
    if bpe:
        spines = {p: s for p in ids if (s := _spines(p, ranks)) is not None}
        ids = {p: i for p, i in ids.items() if p in spines}
    return Vocabulary([p.piece for p in proto.pieces], ranks, ids, first_byte, unknown, bpe, proto.normalizer_spec.add_dummy_prefix, spines)


def _spines(piece: str, ranks: dict[str, float]) -> tuple[list[str], list[str]] | None:
    """The pieces at the left and at the right edge while merges build ``piece``; None if they do not."""
    parts = list(piece)
    left, right = [parts[0]], [parts[-1]]
    while len(parts) > 1:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            return None
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if i == 0:
            left.append(parts[0])
        if i == len(parts) - 1:
            right.append(parts[-1])
    return left, right


class Encoder:
    """Encodes distinct marked words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.longest = vocabulary.longest
        self.seams: dict[tuple[str, str], bool] = {}
        self.worst = min(vocabulary.ranks.values(), default=0.0) - 10.0

    def _holds(self, before: str, piece: str) -> bool:
        """Whether the seam between two pieces outlives the merges that build them."""
        key = (before, piece)
        known = self.seams.get(key)
        if known is None:
            if len(self.seams) > KNOWN_WORDS:
                self.seams.clear()
            known = self.seams[key] = self._outlives(before, piece)
        return known

    def _outlives(self, before: str, piece: str) -> bool:
        spines, ranks = self.v.spines, self.v.ranks
        if before not in spines or piece not in spines:
            return True  # a character that is in no piece
        a, b = spines[before][1], spines[piece][0]
        i = j = 0
        never = float("inf")
        while True:
            next_a = ranks[a[i + 1]] if i + 1 < len(a) else never
            next_b = ranks[b[j + 1]] if j + 1 < len(b) else never
            across = ranks.get(a[i] + b[j], never)
            # of equal merges the one further left comes first
            if across < next_a and across <= next_b and across < never:
                return False
            if next_a == next_b == never:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def encode(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each of the sorted distinct ``words``."""
        ids, out, longest = self.v.ids, {}, self.longest
        bpe, ranks, seams = self.v.bpe, self.v.ranks, self.seams
        last: list[str] = [""]
        score: list[float] = [0.0]
        previous = ""
        for word in words:
            shared, most = 0, min(len(word), len(previous))
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            del last[shared + 1 :], score[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                pick, best = None, self.worst * (len(word) + 2)
                for size in range(1, min(longest, end) + 1):
                    piece = word[end - size : end]
                    if piece not in ids:
                        continue
                    if bpe:
                        if size == end:
                            pick = piece
                            break
                        holds = seams.get((last[end - size], piece))
                        if self._holds(last[end - size], piece) if holds is None else holds:
                            pick = piece
                            break
                    elif score[end - size] + ranks[piece] > best:
                        pick, best = piece, score[end - size] + ranks[piece]
                if pick is None:
                    pick, best = word[end - 1], score[end - 1] + self.worst
                last.append(pick)
                score.append(best)
            previous = word
            found: list[int] = []
            end = len(word)
            while end:
                piece = last[end]
                found[:0] = (ids[piece],) if piece in ids else self._unknown(piece)
                end -= len(piece)
            out[word] = tuple(found)
        return out

    def _unknown(self, char: str) -> tuple[int, ...]:
        if self.v.bytes_from < 0:
            return (self.v.unknown,)
        return tuple(self.v.bytes_from + b for b in char.encode())


_UNITS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+(?=\n|$)|\n")


def marked_words(text: str, v: Vocabulary) -> list[str]:
    """The words of ``text`` with their marks, which put together are the marked text. A line feed is a word of its own."""
    if not text:
        return []
    return _UNITS.findall((MARK if v.prefix else "") + text.replace(" ", MARK))


class TextEncoder:
    """Encodes texts part by part; every distinct word is encoded once and then looked up by number."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.words = v, Encoder(v)
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where those of each text start and end."""
        if len(self.numbers) > KNOWN_WORDS:
            self._forget()
        numbers, known = self.numbers, len(self.numbers)
        rows = []
        for text in texts:
            words = marked_words(text, self.v)
            rows.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
        new = list(numbers)[known:]
        found = self.words.encode(sorted(new))
        self.sizes = np.concatenate([self.sizes, np.fromiter((len(found[w]) for w in new), np.int64, len(new))])
        self.flat = np.concatenate([self.flat, np.fromiter((i for w in new for i in found[w]), np.int32)])
        starts = np.cumsum(self.sizes) - self.sizes
        words = np.concatenate(rows) if rows else np.empty(0, np.int32)
        sizes = self.sizes[words]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(starts[words] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)]
        return ids, upto.astype(np.int32)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with about ``PIECE_CHARS`` characters, and their texts."""
    sizes = np.cumsum(pa.compute.fill_null(pa.compute.utf8_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + PIECE_CHARS, "right")))
        part = batch.slice(start, stop - start)
        yield part, [t or "" for t in part["text"].to_pylist()]
        start = stop


def _lists(ids: np.ndarray, upto: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(upto), pa.array(ids))


def _encode_batches(v: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(v)
        for batch in batches:
            for part, texts in _parts(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(*encoder.encode(texts))], [*batch.schema.names, "ids"])

    return run


class TextDecoder:
    def __init__(self, v: Vocabulary) -> None:
        self.prefix = v.prefix
        self.table = [p.encode() for p in v.pieces]
        if v.bytes_from >= 0:
            self.table[v.bytes_from : v.bytes_from + 256] = [bytes([b]) for b in range(256)]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _decode_batches(v: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = TextDecoder(v)
        for batch in batches:
            texts = [decoder.decode(ids.values.to_pylist() if ids.values is not None else []) for ids in batch["ids"]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def _check_batches(v: Vocabulary):
    """Encodes and decodes in one task, and hands on the ids without the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = TextEncoder(v), TextDecoder(v)
        for batch in batches:
            for part, texts in _parts(batch):
                ids, upto = encoder.encode(texts)
                same = [decoder.decode(ids[a:b].tolist()) == t.replace(MARK, " ") for a, b, t in zip(upto[:-1], upto[1:], texts, strict=True)]
                rest = part.drop_columns(["text"])
                more = [_lists(ids, upto), pa.array(np.diff(upto).astype(np.int64)), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*rest.columns, *more], [*rest.schema.names, "ids", "n_pieces", "round_trip"])

    return run


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """``docs`` with ``ids``: array of the piece ids of ``text``. Null and empty texts have none.

    Characters in no piece become their bytes, or the unknown piece in a model without byte pieces. A column ``ids`` of the input is replaced.
    """
    rows = docs.drop("ids")
    return rows.mapInArrow(_encode_batches(v), T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, v: Vocabulary) -> DataFrame:
    """``encoded`` with ``decoded``: the text that ``ids`` stand for; null and no ids: empty.

    It equals the encoded text but for the mark U+2581, which comes back as a space.
    """
    rows = encoded.drop("decoded")
    return rows.mapInArrow(_decode_batches(v), T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def encoded_and_checked(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """``docs`` without the text, with ``ids``, ``n_pieces`` and ``round_trip``: whether decoding gives the text back."""
    rows = docs.drop("ids", "n_pieces", "round_trip")
    kept = [f for f in rows.schema.fields if f.name != "text"]
    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    return rows.mapInArrow(_check_batches(v), T.StructType([*kept, *more]))
