"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make every signature coordinate: sigma scatters the shingle hashes once, and coordinate k is the
least pi(sigma(x) + k) modulo 2**32, that is, pi shifted by k. Bands of equal coordinates give candidate buckets.

Buckets are never expanded into all pairs. The member of a bucket that shares most buckets is its pivot, and every
member is compared with it (its star). Two members that the pivot does not link anyway can only be linked

- if their sizes allow it although all they have beyond the pivot differs, or
- if they share as many shingles beyond the pivot as the bound asks for, so they meet under a rare one of these.

Such pairs are compared on full sets; in a star of few members all pairs of different components are, outright. A shingle that very many members of a star share makes them a bucket of the next
round, with a pivot of its own. So no link within a bucket is lost, and a group of copies costs about one star.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import components, merged
from .word_hashes import as_bytes, mix64, pieces

#: Bytes of text that are gone through at a time: the arrays of so many words stay in a core's cache.
PIECE_BYTES = 400_000


@dataclass(frozen=True)
class Rule:
    """Shingle length, similarity ``num / den``, and the bands; a linked pair is missed with (1 - s**rows)**bands."""

    shingle: int = 5
    num: int = 80
    den: int = 100
    bands: int = 40
    rows: int = 4


def _pi(x: np.ndarray, shift: int, out: np.ndarray, tmp: np.ndarray) -> np.ndarray:
    """A fixed permutation of 0..2**32-1, applied at ``x + shift``."""
    np.add(x, np.uint32(shift), out=out)
    for by, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        np.right_shift(out, np.uint32(by), out=tmp)
        np.bitwise_xor(out, tmp, out=out)
        np.multiply(out, np.uint32(factor), out=out)
    np.right_shift(out, np.uint32(16), out=tmp)
    return np.bitwise_xor(out, tmp, out=out)


def word_lists(texts: list[bytes]) -> list[list[bytes]]:
    """Words of each text, in lower case (ASCII)."""
    return [text.lower().split() for text in texts]


def word_key(parts: list[bytes]) -> bytes:
    """16 bytes that tell word sequences apart."""
    return md5(b" ".join(parts)).digest()


def _windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of ``width`` words."""
    mixed = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(mixed)])
    return mixed


def shingle_sets(lists: list[list[bytes]], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each list of words; a shorter one is one shingle, an empty one none."""
    sizes = list(map(len, lists))
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for parts in lists for w in parts), np.uint64, sum(sizes))
    mixed, at, out = _windows(h, k) if len(h) >= k else h, 0, []  # in one go; windows across two texts are left out below
    for n in sizes:
        own = np.sort(mixed[at : at + n - k + 1] if n >= k else _windows(h[at : at + n], n) if n else h[:0])
        new = np.ones(len(own), bool)
        np.not_equal(own[1:], own[:-1], out=new[1:])
        out.append(own[new])
        at += n
    return out


def _band_keys(sets: list[np.ndarray], rule: Rule) -> np.ndarray:
    """One row of ``bands`` bucket keys for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    sigma = (mix64(flat + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32)
    values, tmp = np.empty_like(sigma), np.empty_like(sigma)
    keys = np.empty((len(sets), rule.bands), np.uint64)
    for b in range(rule.bands):
        mixed = np.full(len(sets), b + 1, np.uint64)
        for r in range(rule.rows):
            least = np.minimum.reduceat(_pi(sigma, b * rule.rows + r, values, tmp), starts)
            mixed = mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + least.astype(np.uint64))
        keys[:, b] = mixed
    return keys


def _signer(rule: Rule):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch["text"])
            for part in pieces(texts, PIECE_BYTES):
                lists = word_lists(texts[part])
                sets = shingle_sets(lists, rule.shingle)
                full = [s for s in sets if len(s)]
                sizes = np.array([len(s) for s in sets], np.int64)
                keys = _band_keys(full, rule).view(np.int64).ravel() if full else np.empty(0, np.int64)
                offsets = np.concatenate([[0], np.cumsum((sizes > 0) * rule.bands)]).astype(np.int32)
                key, raw = ([f(x) for x in of] for f, of in ((word_key, lists), (lambda x: md5(x).digest(), texts[part])))
                columns = [batch["doc_id"][part.start : part.stop], pa.array(key, pa.binary()), pa.array(raw, pa.binary()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "raw", "n_shingles", "bands"])

    return sign


def _setter(rule: Rule):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch["text"])
            for part in pieces(texts, PIECE_BYTES):
                sets = shingle_sets(word_lists(texts[part]), rule.shingle)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch["node"][part.start : part.stop], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["node", "shingles"])

    return build


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)))


def _raw(text: Column) -> Column:
    """16 bytes that tell texts apart, as the signatures have them."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _linked(rule: Rule, size: Column, other: Column, common: Column) -> Column:
    return rule.den * common >= rule.num * (size + other - common)


def _of_use(rule: Rule) -> Column:
    """Buckets that may hold a link: two members must have sizes that allow one."""
    return (F.col("n") > 2) | ((F.col("n") == 2) & (rule.den * F.col("least") >= rule.num * F.col("most")))


#: Most bits of a filter, bits a wanted key below that, and bits of each of its bitmaps: bounded, whatever the input. More
#: keys than bits only let more rows pass.
FILTER, KEY_BITS, SLOT = 1 << 25, 1 << 10, 1 << 15


def _maybe(rows: DataFrame, key: str, wanted: DataFrame, n: int | None = None) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted`` (the same column), so that these are not shuffled.

    One bit a key, in at most 1,024 bitmaps of 4 KB, fewer if ``n``, the most keys wanted, is told and small. A join on the
    key must follow.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER if n is None else min(FILTER, 1 << max(n * KEY_BITS, SLOT).bit_length())))
    slot, bit = F.floor(place / SLOT).alias("_slot"), (place % SLOT).alias("_bit")
    maps = wanted.select(slot, bit).distinct().repartition("_slot").groupBy("_slot").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, (F.col("_bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return rows.select("*", slot, bit).join(F.broadcast(staged(maps, "filter")), "_slot").where(is_set).drop("_slot", "_bit", "_bitmap")


def _with_sets(pairs: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of ``pairs`` (a, b, any others) with the sets of both."""
    sets = _maybe(sets, "node", pairs.select(F.explode(F.array("a", "b")).alias("node")), 2 * n)
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return one.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")


def _links(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame | None:
    """The pairs (a, b) whose full sets are similar enough, as links (u, v); None where there are no pairs."""
    pairs = staged(pairs, "near-pairs")
    n = pairs.count()
    if n == 0:
        return None
    both = _with_sets(pairs, sets, n).select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return both.where(_linked(rule, F.col("na"), F.col("nb"), F.col("common"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_groups(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text, any others).

    ``component_id`` is the least doc_id that can be reached over verified links, ``kept`` whether it is the row's own.
    Rows with the same words are copies of one class. Null texts, and texts without words, have no shingles and link
    with nothing; a null doc_id is no component's least unless all are null. Other columns are not looked at.
    """
    return _groups(docs, rule).drop("raw")


def _groups(docs: DataFrame, rule: Rule) -> DataFrame:
    """:func:`near_groups` with ``raw``, the key of each row's text as it stands. Words are parted once, in the tasks that sign."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = staged(keyed.mapInArrow(_signer(rule), "doc_id long, key binary, raw binary, n_shingles long, bands array<long>"), "signatures")
    some = signed.where("n_shingles > 0")
    first = F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "raw")).alias("first")
    classes = some.groupBy("key").agg(first, F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
    classes = classes.select("key", F.col("first.doc_id").alias("least"), F.col("first.raw").alias("raw"), "size", "bands")
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    in_bands = classes.select("node", "size", F.explode("bands").alias("bucket"))
    sizes = in_bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), F.max("size").alias("most"))
    shared = staged(sizes.where(_of_use(rule)).select("bucket", "n"), "buckets")
    placed = staged(in_bands.join(shared, "bucket"), "placed")
    weights = placed.groupBy("node").agg(F.sum("n").alias("weight"))
    members = staged(placed.join(weights, "node").select("bucket", "node", "size", "weight"), "members")

    wanted = members.select("node").distinct().join(classes, "node").select("node", "raw", _id(F.col("least")).alias("id"))
    wanted = staged(wanted, "wanted")
    some = _maybe(docs.select(_id(F.col("doc_id")).alias("id"), F.coalesce("text", F.lit("")).alias("text")), "id", wanted, wanted.count())
    # never by broadcast: the wanted grow with the input, so a small input is to show what a large one costs
    texts = some.withColumn("raw", _raw(F.col("text"))).join(wanted.hint("merge"), ["raw", "id"])
    once = texts.groupBy("raw", "id").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text")
    sets = staged(once.mapInArrow(_setter(rule), "node long, shingles array<long>"), "shingle-sets")

    labels = _labels(members, sets, rule, max(LEAST_PAIRS, PAIRS * classes.count()))
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "node long, label long")
    labels = labels if labels is not None else empty
    of_class = classes.join(labels, "node", "left").select("key", "least", F.coalesce("label", "node").alias("label"))
    first = staged(of_class.groupBy("label").agg(F.min("least").alias("component_id")), "firsts")
    found = staged(of_class.join(first, "label").select("key", "component_id"), "components")
    ids = signed.select("doc_id", "key", "raw", "n_shingles").join(found, "key", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return ids.select("doc_id", "key", "raw", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


#: Pairs of members under shared shingles that a round may compare, for each class of texts, and at least.
PAIRS, LEAST_PAIRS = 0.25, 10_000
#: Pairs that a round compares outright within small stars, for each of those under shared shingles, and most of one star.
DIRECT, STAR = 8, 1 << 17


def _labels(members: DataFrame, sets: DataFrame, rule: Rule, most: float) -> DataFrame | None:
    """Component labels of the members (bucket, node, size, weight); None where there is no link."""
    labels, late, buckets = None, None, members
    while True:
        top = F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top")
        pivots = buckets.groupBy("bucket").agg(top, F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), F.max("size").alias("most"))
        pivots = staged(pivots.where(_of_use(rule)).select("bucket", "n", (-F.col("top.minus")).alias("a")), "pivots")
        met = buckets.join(pivots, "bucket").where("node <> a")
        pairs = met.groupBy("a", F.col("node").alias("b")).agg(F.max("n").alias("n"), F.max("weight").alias("weight"))
        pairs = staged(pairs, "star-pairs")
        n = pairs.count()
        if n == 0:
            return labels if late is None else _joined(labels, late)
        parts = [F.when(F.col("n") > 2, f("sb", "sa")).alias(name) for f, name in ((F.array_intersect, "within"), (F.array_except, "beyond"))]
        common = F.size(F.array_intersect("sa", "sb")).alias("common")
        stars = staged(_with_sets(pairs, sets, n).select("a", "b", "weight", F.size("sa").alias("na"), F.size("sb").alias("nb"), common, *parts), "stars")
        own = _linked(rule, F.col("na"), F.col("nb"), F.col("common"))
        links = stars.where(own).select(F.col("a").alias("u"), F.col("b").alias("v"))
        # with those found within the stars of the round before: labels are made once a round
        labels = _joined(labels, links if late is None else links.union(late))
        held = stars.where("beyond IS NOT NULL").select("a", "b", "weight", F.col("nb").alias("n"), "common", "within", "beyond", own.alias("own"))
        held = held.join(labels.withColumnRenamed("node", "b"), "b", "left").withColumn("label", F.coalesce("label", "b")) if labels is not None else held.withColumn("label", F.col("b"))
        mixed, bound, largest = _mixed(held.select("a", "label"), most * DIRECT)
        if not largest:
            return labels
        late = _outright(staged(held.join(mixed.where(F.col("pairs") <= bound).select("a"), "a"), "small-stars"), rule) if bound else None
        if largest <= bound:
            return _joined(labels, late)
        open_stars = staged(held.drop("within").join(mixed.where(F.col("pairs") > bound).select("a"), "a"), "open-stars")
        near, buckets = _within(open_stars, rule, most)
        more = _links(near, sets, rule)
        late = more if late is None else late if more is None else late.union(more)


def _bound(sizes: DataFrame, size: str, pairs: Column, most: float) -> int:
    """The largest power of two such that the ``pairs`` of all rows of ``sizes`` up to that ``size`` stay below ``most``, 0 without."""
    by_size = sizes.groupBy(F.ceil(F.log2(size)).alias("log")).agg(F.sum(pairs).alias("pairs")).orderBy("log").collect()
    bound, total = 0, 0
    for r in by_size:  # one row for each power of two
        total += r.pairs
        if total > most:
            break
        bound = 2**r.log
    return bound


def _mixed(held: DataFrame, most: float) -> tuple[DataFrame, int, int]:
    """From members (a, label): the stars (a, pairs) with members of more than one component, and how many pairs across
    components these have; up to which number the stars' pairs are ``most`` in all; the largest number."""
    counts = held.groupBy("a", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("a").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("own"))
    mixed = staged(counts.select("a", F.expr("(n * n - own) div 2").alias("pairs")).where("pairs > 0"), "mixed")
    largest = mixed.agg(F.max("pairs")).first()[0] or 0
    return mixed, min(STAR, _bound(mixed, "pairs", F.col("pairs"), most)) if largest else 0, largest


def _outright(stars: DataFrame, rule: Rule) -> DataFrame:
    """Links (u, v) across components within stars (a, b, n, common, within, beyond, label), each pair compared where the star is.

    A set is what it shares with the pivot and what it has beyond it; the sizes of these parts rule most pairs out.
    """
    left, right = stars.alias("l"), stars.hint("merge").alias("r")
    enough = lambda common: (rule.num + rule.den) * common >= rule.num * (F.col("l.n") + F.col("r.n"))
    inner, beyond = (F.size(F.array_intersect(f"l.{c}", f"r.{c}")) for c in ("within", "beyond"))
    least = F.least("l.common", "r.common")
    may = enough(least + F.least(F.col("l.n") - F.col("l.common"), F.col("r.n") - F.col("r.common")))
    pairs = (F.col("l.a") == F.col("r.a")) & (F.col("l.b") < F.col("r.b")) & (F.col("l.label") != F.col("r.label"))
    linked = left.join(right, pairs & may & enough(least + beyond) & enough(inner + beyond))
    return linked.select(F.col("l.b").alias("u"), F.col("r.b").alias("v")).distinct()


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    links = staged(links, "found")
    if links.isEmpty():
        return labels
    return components(links) if labels is None else merged(labels, links)


def _within(stars: DataFrame, rule: Rule, most: float) -> tuple[DataFrame, DataFrame]:
    """From open stars (a, b, weight, n, common, beyond, own, label): pairs to compare, and buckets for the next round.

    ``common`` counts the member's shingles in the pivot, ``own`` tells whether the pivot links it. Members of sizes n
    and m can be linked only if they share at least num * (n + m) / (num + den) shingles, at most the lesser ``common``
    of them in the pivot. What is missing they must share beyond it; the least of that over all sizes in the star is the
    member's ``need``. Pairs under shared shingles are at most ``most``; members of shingles that more share take a further
    round with a pivot of their own, as the members of a further family of near copies do. A member that needs k shared shingles meets others under all but its k - 1 most frequent ones.
    """
    whole = rule.num + rule.den
    sizes = stars.groupBy("a", "n").agg(F.max("common").alias("most")).groupBy("a").agg(F.collect_list(F.struct("n", "most")).alias("sizes"))
    short = lambda m, most: F.ceil((rule.num * (F.col("n") + m) - whole * F.least(F.col("common"), most)) / F.lit(whole))
    need = F.array_min(F.transform("sizes", lambda x: short(x["n"], x["most"])))
    told = staged(stars.join(staged(sizes, "star-sizes"), "a").withColumn("need", need).drop("sizes"), "needs")

    slim = told.where("need <= 0").select("a", "b", "n", "common", "own", "label")
    one, two = slim.where("NOT own").alias("l"), slim.alias("r")
    enough = whole * F.least("l.common", "r.common") >= rule.num * (F.col("l.n") + F.col("r.n"))
    direct = one.join(two, (F.col("l.a") == F.col("r.a")) & (F.col("l.label") != F.col("r.label")) & enough)

    met = told.select("a", F.explode("beyond").alias("shingle"), "b", "n", "label", "weight", "need")
    counts = met.groupBy("a", "shingle").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    counts = staged(counts.where("lo < hi").select("a", "shingle", "size"), "shared-shingles")
    ordered = met.join(counts, ["a", "shingle"]).groupBy("a", "b").agg(
        F.sort_array(F.collect_list(F.struct("size", "shingle"))).alias("shared"), *[F.first(c).alias(c) for c in ("n", "label", "weight", "need")]
    )
    first = ordered.withColumn("shared", F.slice("shared", 1, F.greatest(F.size("shared") - F.greatest("need", F.lit(1)).cast("int") + 1, F.lit(0))))
    keyed = staged(first.select("a", "b", "n", "label", "weight", F.explode("shared").alias("x")).select("a", "b", "n", "label", "weight", "x.size", "x.shingle"), "met")
    bound = max(1, _bound(keyed, "size", F.col("size") / 2, most))
    few = keyed.where(F.col("size") <= bound)
    left, right = few.alias("l"), few.alias("r")
    meets = (F.col("l.a") == F.col("r.a")) & (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.b") < F.col("r.b")) & (F.col("l.label") != F.col("r.label"))
    pairs = direct.select("l.b", F.col("r.b").alias("c")).union(left.join(right, meets).select("l.b", F.col("r.b").alias("c")))
    near = pairs.select(F.least("b", "c").alias("a"), F.greatest("b", "c").alias("b")).distinct()
    many = keyed.where(F.col("size") > bound)
    return near, many.select(F.xxhash64("a", "shingle").alias("bucket"), F.col("b").alias("node"), F.col("n").alias("size"), "weight")


def one_of_each(docs: DataFrame, rule: Rule) -> DataFrame:
    """Rows of ``docs``, with all their columns, that are the first of their near-duplicate group; repeated rows once.

    Rows without words stay, each distinct one once.
    """
    kept = _groups(docs, rule).where("kept").groupBy("doc_id", "key").agg(F.min("raw").alias("_raw"))
    mine = docs.withColumns({"_id": _id(F.col("doc_id")), "_raw": _raw(F.col("text"))})
    chosen = kept.select(_id(F.col("doc_id")).alias("_id"), "_raw")
    return mine.join(chosen, ["_id", "_raw"], "left_semi").dropDuplicates(["_id", "_raw"]).drop("_id", "_raw")
