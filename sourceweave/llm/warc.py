"""WARC archives with a two-level capture index.

Archives are rows of a table: records of one scan batch, each a gzip member of its own, end to end. The index sorts
reversed-host keys of the captured addresses into compressed blocks; a sparse directory holds the first key of each
block. A look-up searches the directory by bisection, reads only the blocks it names, and from the archives only the
byte ranges that these give. The directory has at most ``DIRECTORY`` entries of at most ``KEY_CHARS`` characters:
blocks grow with the number of captures, not the directory.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

ARCHIVE_BYTES = 8_000_000
BLOCK_ENTRIES, DIRECTORY, KEY_CHARS = 1_000, 65_536, 256
DATE = "2024-01-01T00:00:00Z"
NAME = "urn:page:"

CAPTURE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"


def capture_key(url: str | None) -> str:
    """``com,example)/path?query``: host labels reversed, in lower case, without scheme and port."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname or ""
    except ValueError:
        return url or ""
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One gzip member. ``first``: the page that holds the payload, if this record revisits it."""
    name = f"{NAME}{page_id}" if page_id is not None else uuid.uuid4().urn
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if first is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=''.join(map(chr, range(33, 127))))}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if first is not None:
        head[3:3] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{NAME}{first}>"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def read_record(member: bytes) -> dict:
    """Fields of a record from its gzip member; the digest of a payload at hand is computed anew and must agree."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or _base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: int(name[len(NAME) + 1 : -1]) if name and name.startswith(f"<{NAME}") else None
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To")),
        "url": fields["WARC-Target-URI"],
        "html": payload.decode() if fields["WARC-Type"] == "response" else None,
    }


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("key", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))

    def archive(members: list[bytes], captures: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([b"".join(members)], pa.binary()), pa.array([captures], kind)], ["archive", "data", "captures"])

    for batch in batches:
        members, captures, at = [], [], 0
        for page_id, url, html, digest, first in zip(*(batch[c] for c in ("page_id", "url", "html", "digest", "first")), strict=True):
            page_id, first = page_id.as_py(), first.as_py()
            digest32 = _base32(bytes.fromhex(digest.as_py()))
            payload = (html.as_py() or "").encode()
            member = _record(page_id, url.as_py(), payload, digest32, first)
            members.append(member)
            captures.append({"key": capture_key(url.as_py()), "page_id": page_id, "offset": at, "length": len(member)})
            at += len(member)
            if at >= ARCHIVE_BYTES:
                yield archive(members, captures)
                members, captures, at = [], [], 0
        if members:
            yield archive(members, captures)


def write_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives (archive, data, captures) of ``pages`` (page_id, url, html, any others), written as a table.

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the largest page_id are responses and the
    rest revisit it; if all have a null page_id, all are responses. A null html is an empty payload, a null url an
    empty address; repeated rows are records each.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    sized = rows.select("page_id", "digest", F.octet_length("html").alias("size"))
    shared = sized.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("largest"))
    shared = staged(shared.where((F.col("n") > 1) & F.col("largest").isNotNull()).select("digest", "largest"), "shared-payloads")
    told = rows.join(shared, "digest", "left")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    ready = told.select("page_id", "url", "html", "digest", first.alias("first"))
    return staged(ready.mapInArrow(_write, "archive string, data binary, captures array<struct<key:string,page_id:long,offset:long,length:long>>"), "archives")


@dataclass
class Index:
    """``blocks``: (block, first, last, n, data), a table; ``directory``: sorted (first key, last key, block), bounded."""

    blocks: DataFrame
    directory: list[tuple[str, str, str]]

    def captures(self) -> DataFrame:
        """All entries, unpacked from the blocks."""
        return self.blocks.select("data").mapInArrow(_unpack, CAPTURE)

    def find(self, urls: DataFrame) -> DataFrame:
        """Entries of the captures of ``urls`` (url): bisection, then only the blocks named."""
        firsts, lasts, names = ([x[i] for x in self.directory] for i in range(3))

        def route(batches):
            for batch in batches:
                rows = []
                for url in batch["url"].to_pylist():
                    key = capture_key(url)
                    short = key[:KEY_CHARS]
                    for i in range(bisect.bisect_left(lasts, short), bisect.bisect_right(firsts, short)):
                        rows.append((key, names[i]))
                yield pa.RecordBatch.from_pydict({"key": pa.array([r[0] for r in rows], pa.string()), "block": pa.array([r[1] for r in rows], pa.string())})

        def scan(batches):
            for batch in batches:
                out = []
                for wanted, data in zip(batch["keys"].to_pylist(), batch["data"].to_pylist(), strict=True):
                    wanted = set(wanted)
                    out += [e for e in json.loads(zlib.decompress(data)) if e[0] in wanted]
                yield _entries(out)

        named = urls.select("url").distinct().mapInArrow(route, "key string, block string").groupBy("block").agg(F.collect_set("key").alias("keys"))
        return named.join(self.blocks, "block").select("keys", "data").mapInArrow(scan, CAPTURE)


def _entries(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], CAPTURE.fieldNames())


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch["data"]:
            yield _entries(json.loads(zlib.decompress(data.as_py())))


def build_index(archives: DataFrame) -> Index:
    """The index of all captures in ``archives``."""
    entries = archives.select("archive", F.explode("captures").alias("c")).select("c.key", "c.page_id", "archive", "c.offset", "c.length")
    n = archives.agg(F.sum(F.size("captures"))).first()[0] or 0
    size = max(BLOCK_ENTRIES, -(-n // DIRECTORY) * 2)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []

        def block(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "block": [uuid.uuid4().hex],
                    "first": [rows[0][0][:KEY_CHARS]],
                    "last": [rows[-1][0][:KEY_CHARS]],
                    "n": [len(rows)],
                    "data": [zlib.compress(json.dumps(rows).encode())],
                }
            )

        for batch in batches:
            held += [list(r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            while len(held) >= size:
                yield block(held[:size])
                held = held[size:]
        if held:
            yield block(held)

    parts = max(1, min(n // size, 32_768))
    ordered = entries.repartitionByRange(parts, "key", "page_id", "archive", "offset").sortWithinPartitions("key", "page_id", "archive", "offset")
    blocks = staged(ordered.mapInArrow(pack, "block string, first string, last string, n long, data binary"), "capture-blocks")
    # at most one short block a partition: no more than DIRECTORY rows
    directory = sorted(tuple(r) for r in blocks.select("first", "last", "block").collect())
    return Index(blocks, directory)


def read_ranges(archives: DataFrame, captures: DataFrame) -> DataFrame:
    """The records of ``captures``, each cut out of its archive by offset and length.

    The archives asked for are a written table of names: while it is small, archives are told apart where they are
    scanned, and only the data of those asked for is shuffled.
    """
    captures = staged(captures.select("archive", "offset", "length"), "captures")
    archives = archives.join(staged(captures.select("archive").distinct(), "archives-asked"), "archive", "left_semi")

    def cut(archive: pa.Table, wanted: pa.Table) -> pa.Table:
        rows = []
        if archive.num_rows:
            data = memoryview(archive["data"][0].as_py())
            for offset, length in zip(wanted["offset"].to_pylist(), wanted["length"].to_pylist(), strict=True):
                rows.append(read_record(data[offset : offset + length]))
        kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.string())]
        return pa.table({name: pa.array([r[name] for r in rows], kind) for name, kind in kinds})

    return archives.select("archive", "data").groupBy("archive").cogroup(captures.groupBy("archive")).applyInArrow(cut, RECORD)
