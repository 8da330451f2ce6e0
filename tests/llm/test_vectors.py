"""Hard negatives, product codes and the language model against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourceweave.llm import hadamard_codes, hard_negatives, kneser_ney, vectors

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, label_error string, cell string, row string, id string"


def table(spark, rows):
    """(vec_id, vector, label), with clashing columns."""
    return spark.createDataFrame([(i, v, c, "x", "x", "x", "x") for i, v, c in rows], SCHEMA)


def odd_vectors(rng, n, wide, repeat=0):
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(wide)], rng.randrange(4)) for i in range(n)]
    rows += [(n, [0.5] * wide, 1)] * repeat  # one very common vector
    rows += [(None, [0.1] * wide, 1), (50, [0.2] * wide, 2), (50, [0.2] * wide, 2), (3, None, 1), (4, [None] * wide, 1), (5, [NAN] * wide, 1), (6, [INF] * wide, 1)]
    return rows + [(7, [0.3] * wide, None), (100, [0.7] * (wide - 1), 0), (150, [], 0)]


def usable(rows):
    return [(i, v, c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def whole(v, factor, wide):
    out = [math.floor(factor * float(np.float32(x))) for x in v]
    return out + [0] * (wide - len(out))


def mined_by_hand(rows, rule, wide):
    rows = [(i, whole(v, rule.factor, wide), c) for i, v, c in usable(rows) if c is not None]
    out = []
    for k, (anchor, v, label) in enumerate(rows):
        if anchor is None or anchor % rule.every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), i is None, i or 0, i, c) for n, (i, w, c) in enumerate(rows) if n != k]
        scored.sort(key=lambda s: s[:3])
        for ps, _, _, positive, _ in [s for s in scored if s[4] == label][: rule.positives]:
            fits = [s for s in scored if s[4] != label and rule.low * -ps <= 100 * -s[0] <= rule.high * -ps][: rule.negatives]
            out += [(anchor, positive, r, s[3], -ps, -s[0]) for r, s in enumerate(fits, 1)]
    return Counter(out)


@pytest.mark.parametrize("n,wide,repeat", [(300, 12, 0), (900, 7, 400)])
def test_hard_negatives(spark, monkeypatch, n, wide, repeat):
    for name, value in (("CELL", 20), ("BLOCK", 32), ("GROUP", 4), ("FIRST", 3), ("GROWTH", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = odd_vectors(random.Random(n), n, wide, repeat)
    rule = hard_negatives.Rule(every=30)
    got = hard_negatives.mine(table(spark, rows), rule)
    assert Counter(tuple(r) for r in got.collect()) == mined_by_hand(rows, rule, wide)


def test_hard_negatives_of_few_rows(spark):
    assert hard_negatives.mine(table(spark, [])).count() == 0
    assert hard_negatives.mine(table(spark, [(1, None, 1), (2, [1.0], None)])).count() == 0
    assert hard_negatives.mine(table(spark, [(50, [], 1), (51, [], 1), (52, [], 2)])).select("positive_score", "negative_score").collect() == [(0, 0)]
    assert hard_negatives.mine(table(spark, [(50, [1.0, 0.5], 1)])).count() == 0


def test_cells_come_by_falling_bounds_that_hold():
    rng = np.random.default_rng(5)
    rows = rng.integers(-200, 200, (500, 10)).astype(float)
    books = [hard_negatives._codebook(rows[:, :5], 6, 0), hard_negatives._codebook(rows[:, 5:], 6, 1)]
    word = [hard_negatives._nearest(rows[:, :5], books[0]), hard_negatives._nearest(rows[:, 5:], books[1])]
    cell, count, radii = word[0] * 6 + word[1], np.zeros(36, int), np.zeros((36, 3))
    for k, c in enumerate(cell):
        far = [np.linalg.norm(rows[k, :5] - books[0][word[0][k]]), np.linalg.norm(rows[k, 5:] - books[1][word[1][k]])]
        count[c], radii[c] = count[c] + 1, np.maximum(radii[c], [*far, math.hypot(*far)])
    directory = hard_negatives.Directory(books, count, radii, 5)
    for anchor in rows[:20]:
        left, before = set(range(36)), np.inf
        for stop in range(1, 37):
            cells, rest = directory.walk(anchor, stop - 1, stop)
            assert rest <= before + 1e-6
            before = rest
            for c, upper, lower in cells:
                left.discard(c)
                scores = rows[cell == c] @ anchor
                assert lower - 1e-6 <= scores.min() and scores.max() <= upper + 1e-6
            assert all((rows[cell == c] @ anchor <= rest + 1e-6).all() for c in left if count[c])
        assert not [c for c in left if count[c]]


def coded_by_hand(rows, rule, wide):
    kept = [(i, whole(v, rule.factor, wide), c) for i, v, c in usable(rows)]
    each = wide // rule.parts
    first = {}
    for i, v, _ in kept:
        first[i] = min(first.get(i, v), v)
    ids = sorted(first, key=lambda i: (i is None, i))[: rule.entries]
    books = [[first[i][p * each : (p + 1) * each] for i in ids] for p in range(rule.parts)]

    def nearest(p, v):
        part = v[p * each : (p + 1) * each]
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rule.rounds):
        groups = [defaultdict(list) for _ in books]
        for _, v, _ in kept:
            for p in range(rule.parts):
                groups[p][nearest(p, v)[1]].append(v[p * each : (p + 1) * each])
        for p, book in enumerate(books):
            for k, members in groups[p].items():
                book[k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = []
    for i, v, _ in kept:
        found = [nearest(p, v) for p in range(rule.parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return Counter(out), ",".join(str(x) for b in books for e in b for x in e)


@pytest.mark.parametrize("wide,rule", [(12, hadamard_codes.Rule(parts=4, entries=7, rounds=3)), (10, hadamard_codes.Rule(parts=2, entries=16, rounds=2)), (8, hadamard_codes.Rule(rounds=1))])
def test_product_codes(spark, wide, rule):
    rows = odd_vectors(random.Random(wide), 200, wide, 90)
    codes, books = hadamard_codes.compress(table(spark, rows), rule)
    want, text = coded_by_hand(rows, rule, wide)
    assert Counter(tuple(r) for r in codes.select("vec_id", "code", "error").collect()) == want
    assert hadamard_codes.codebook_text(books) == text
    found = hadamard_codes.with_label_errors(codes).collect()
    totals = Counter()
    for r in found:
        totals[r.label] += r.error
    assert len(found) == sum(want.values()) and all(r.label_error == totals[r.label] for r in found) and None in totals


def test_product_codes_of_few_rows(spark):
    codes, books = hadamard_codes.compress(table(spark, [(1, None, 1)]))
    assert codes.count() == 0 and books == [] and hadamard_codes.with_label_errors(codes).count() == 0
    codes, _ = hadamard_codes.compress(table(spark, [(1, [0.5] * 8, 1), (1, [0.5] * 8, 1)]))
    assert [tuple(r)[2:] for r in codes.collect()] == [("00" * 8, 0)] * 2
    with pytest.raises(Exception, match="component"):
        hadamard_codes.compress(table(spark, [(1, [1e9] * 8, 1)]))[0].collect()


def test_transform_scales_distances_and_orders_by_sign_changes():
    rng = np.random.default_rng(2)
    for wide in (1, 2, 3, 8, 13):
        x, size = rng.integers(-5000, 5000, (20, wide)), 1 << max(0, wide - 1).bit_length()
        y = hadamard_codes.sequency_transform(x)
        assert y.shape[1] == size
        assert (((y[:1] - y) ** 2).sum(1) == size * ((x[:1] - x) ** 2).sum(1)).all()
        assert (y[:, 0] == x.sum(1)).all()
    rows = hadamard_codes.sequency_transform(np.eye(8, dtype=int)).T
    assert [(r[1:] != r[:-1]).sum() for r in rows] == list(range(8))


# --- language model


def split(text):
    return (text or "").lower().encode().split() + [b" "] if (text or "").isascii() else [*("".join(c.lower() if "A" <= c <= "Z" else c for c in text)).encode().split(), b" "]


def scored_by_hand(train, texts):
    pairs, words = Counter(), Counter()
    for t in train:
        before = b"  "
        for w in split(t):
            pairs[before, w] += 1
            words[w] += 1
            before = w
    joins, context = Counter(w for _, w in pairs), defaultdict(list)
    for (v, _), c in pairs.items():
        context[v].append(c)

    def discount(counts):
        n = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0
        out = [k - (k + 1) * y * n[k] / n[k - 1] if y and n[k - 1] else k / 2 for k in (1, 2, 3)]
        return [0.0] + [d if 0 < d < k else k / 2 for k, d in zip((1, 2, 3), out, strict=True)]

    pd, wd = discount(pairs.values()), discount(joins.values())
    even, total, tokens = 1 / (len(words) + 1), len(pairs), sum(words.values())
    free = sum(wd[min(c, 3)] for c in joins.values())

    def probability(v, w):
        low = (joins[w] - wd[min(joins[w], 3)] + free * even) / total if total else even
        if v not in context:
            return low
        n = sum(context[v])
        c = pairs.get((v, w), 0)
        return (c - pd[min(c, 3)]) / n + sum(pd[min(x, 3)] for x in context[v]) / n * low

    out = []
    for t in texts:
        before, score, base = b"  ", 0.0, 0.0
        for w in split(t):
            score += math.log10(probability(before, w))
            base += math.log10((words[w] + 1) / (tokens + len(words) + 1))
            before = w
        out.append((len(split(t)), sum(w in words for w in split(t)), tokens, base, score))
    return out, probability, words


def texts_of(rng, n):
    rows = [(i, " ".join(f"W{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(40)))) for i in range(n)]
    same = "the same words again and again"
    return rows + [(None, same), (None, None), (3, ""), (3, ""), (7, "É é x\x0by\x1cz"), (11, "long " * 40_000)] + [(1000 + i, same) for i in range(60)]


def close(a, b):
    return a[:3] == b[:3] and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[3:], b[3:], strict=True))


@pytest.mark.parametrize("small", [False, True])
def test_language_model(spark, monkeypatch, small):
    if small:  # many pieces and shards
        monkeypatch.setattr(kneser_ney, "PIECE_BYTES", 500)
        monkeypatch.setattr(kneser_ney, "SHARD_TOKENS", 3000)
    rows = texts_of(random.Random(4), 150)
    docs = spark.createDataFrame([(i, t, "x", "x") for i, t in rows], "doc_id long, text string, piece string, body string").repartition(5)
    import zlib

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    want, probability, words = scored_by_hand([t for i, t in rows if not held(i)], [t for _, t in rows])
    got = sorted((tuple(r) for r in kneser_ney.score_corpus(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=str)
    expected = sorted(((i, held(i), *w) for (i, _), w in zip(rows, want, strict=True)), key=str)
    assert len(got) == len(expected) and {g[1] for g in got} == {True, False}
    assert all(g[:2] == e[:2] and close(g[2:], e[2:]) for g, e in zip(got, expected, strict=True))
    for v in (b"w1", b"  ", b"never"):  # probabilities of a context sum to 1, with one unknown word
        assert math.isclose(sum(probability(v, w) for w in words) + probability(v, b"unknown"), 1.0, rel_tol=1e-9)


def test_a_stored_model_scores_other_texts(spark):
    rows = texts_of(random.Random(9), 80)
    train, other = [t for _, t in rows[:60]], ["w1 w2 w3", None, "the same words", "quite new", "W5 w5 w5"]
    model = kneser_ney.fit(spark.createDataFrame(list(enumerate(train)), "doc_id long, text string"))
    want, _, _ = scored_by_hand(train, other)
    found = kneser_ney.score(spark.createDataFrame(list(enumerate(other)), "doc_id long, text string"), model)
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found.collect()}
    assert all(close(got[i], w) for i, w in enumerate(want))


def test_language_model_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert kneser_ney.score_corpus(none).count() == 0
    model = kneser_ney.fit(none)
    assert kneser_ney.score(none, model).count() == 0
    row = kneser_ney.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)


def test_arrays_come_back_and_are_mapped():
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, top, 50, dtype=np.uint64) for top in (1, 2, 300, 1 << 20, 1 << 63)] + [np.empty(0, np.uint64)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, kneser_ney.unpack(kneser_ney.pack(*arrays)), strict=True))
    assert (kneser_ney.mapped(arrays[4]) == arrays[4]).all()


def test_vectors_are_floored_as_doubles(spark):
    df = spark.createDataFrame([([-0.1, 0.999, -1.0],)], "v array<float>")
    assert df.select(vectors.scaled(F.col("v"), 256)).first()[0] == [-26, 255, -256]
