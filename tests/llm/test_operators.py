"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourceweave.llm import components, decontaminate, html_trees, line_spread, minhash, pieces, quality_outliers, secret_owners, shards, substrings, warc
from sourceweave.session import staged

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def split(text):
    return (text or "").encode().split()


def sentence(rng, n, size=400):
    return " ".join(f"w{rng.randint(0, size)}" for _ in range(n))


def documents(spark, rows, more=()):
    """Rows (doc_id, text, source) with clashing extra columns."""
    df = spark.createDataFrame([(i, t, "en" if n % 3 else None, s, 0) for n, (i, t, s) in enumerate(rows)], DOCS)
    for c in more:
        df = df.withColumn(c, F.lit("mine"))
    return df


def odd_rows(rng):
    """Null, empty, blank and very long texts, null ids and sources, repeated rows, Unicode spaces."""
    long = sentence(rng, 30_000)
    return [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, long, "b"), (5, long, "c"), (None, "just some words", "a"), (None, None, None),
        (6, "one", "a"), (6, "one", "a"), (7, "One", "b"), (8, "a b c d", "a"), (9, "x\x0by\x0cz\x1cq", "b"),
    ]


# --- 1: substrings


def cut_by_hand(texts, window):
    seen = Counter()
    for t in texts:
        w = split(t)
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for t in texts:
        w = split(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("window", [3, 8, 35])
def test_repeats_are_cut_as_by_hand(spark, window):
    rng = random.Random(window)
    shared = [sentence(rng, n) for n in (window - 1, window, window + 1, 3 * window)]
    rows = [(100 + i, " ".join([sentence(rng, rng.randint(0, 60)), rng.choice(shared), sentence(rng, rng.randint(0, 20)), rng.choice(shared)]), "s") for i in range(60)]
    rows += odd_rows(rng) + [(400, "a b " * 60, "s")]
    got = substrings.without_repeats(documents(spark, rows, ["block", "kept"]), window).collect()
    want = Counter((i, *c) for (i, _, _), c in zip(rows, cut_by_hand([t for _, t, _ in rows], window), strict=True))
    assert Counter(tuple(r) for r in got) == want


def test_cover_meets_every_shift():
    for period, members in substrings.COVERS.items():
        assert {(a - b) % period for a in members for b in members} == set(range(period))


# --- 2: near-duplicates


def groups_by_hand(rows, rule):
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset({tuple(w)} if 0 < len(w) < rule.shingle else {tuple(w[i : i + rule.shingle]) for i in range(len(w) - rule.shingle + 1)}))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and rule.den * both >= rule.num * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for n, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return [(i, len(sets[n]), least.get(find(n)) if sets[n] else i) for n, (i, _, _) in enumerate(rows)]


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"z{rng.randint(0, 10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("rule", [minhash.Rule(3, 85, 100, 36, 5), minhash.Rule()])
def test_groups_are_those_of_all_pairs(spark, rule, monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS", 0.0)
    monkeypatch.setattr(minhash, "LEAST_PAIRS", 12)
    rng = random.Random(rule.shingle)
    base = [sentence(rng, 120) for _ in range(4)]
    rows = [(1000 + i, edited(rng, base[0], rng.randint(0, 9)), "s") for i in range(60)]  # near and not so near to each other
    second = edited(rng, base[0], 8)
    rows += [(1200 + i, edited(rng, second, rng.randint(0, 3)), "s") for i in range(20)]  # a group beside the pivot's
    rows += [(1300 + i, " ".join(base[1].split()[: 60 + 3 * i]), "s") for i in range(20)]  # a chain of growing texts
    rows += [(1400 + i, base[2].upper() if i % 2 else base[2], "s") for i in range(10)] + odd_rows(rng)
    rng.shuffle(rows)
    got = minhash.near_groups(documents(spark, rows, ["key", "node", "bucket"]), rule).collect()
    want = Counter((i, n, c, i == c) for i, n, c in groups_by_hand(rows, rule))
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want


def test_one_row_of_each_group_stays(spark):
    text = sentence(random.Random(1), 50)
    rows = [(3, text, "a"), (2, text.upper(), "b"), (2, text.upper(), "b"), (5, "other words", "a"), (6, None, "a"), (7, "", "a")]
    kept = minhash.one_of_each(documents(spark, rows, ["_id"]).drop("_id"), minhash.Rule())
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 7]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (1, 0)]
    got = dict(components.components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, **{200 + i: 100 for i in range(50)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_further_links_join_only_what_they_touch(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 8)  # the star's middle is dealt out
    links = [[(i, i + 1) for i in range(0, 40, 2)] + [(100, 200 + i) for i in range(50)], [(1, 2), (3, 220), (249, 300), (500, 400), (2, 1), (200, 201)]]
    first, second = (spark.createDataFrame(part, "u long, v long") for part in links)
    labels = components.components(first)
    seen = []
    whole = components.components
    monkeypatch.setattr(components, "components", lambda df: seen.append(whole(df)) or seen[0])
    got = components.merged(labels, second).collect()
    assert sorted(got) == sorted(whole(first.union(second)).collect())
    assert {r.node for r in seen[0].collect()} == {0, 2, 100, 300, 400, 500}


def test_what_cannot_be_wanted_is_dropped_before_the_join(spark):
    rows = spark.range(50_000).selectExpr("id * 8589934592 AS node")
    wanted = spark.range(0, 50_000, 100).selectExpr("id * 8589934592 AS node")
    some = minhash._maybe(rows, "node", wanted)
    assert some.columns == ["node"] and some.join(wanted, "node", "left_semi").count() == 500
    assert some.count() < 600


def kept_plans(monkeypatch, module):
    seen, whole = [], module.staged
    monkeypatch.setattr(module, "staged", lambda df, name: seen.append((name, df._jdf.queryExecution().executedPlan().toString())) or whole(df, name))
    return seen


@pytest.mark.parametrize("hub", [4096, 8])
def test_steps_of_components_broadcast_nothing(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB", hub)
    seen = kept_plans(monkeypatch, components)
    links = [(i, i + 1) for i in range(0, 40)] + [(500, 200 + i) for i in range(50)] + [(7, 7), (1, 0), (500, 40)]
    got = dict(components.components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 500: 0, **{200 + i: 0 for i in range(50)}}
    assert len(seen) > 2 and not any("Broadcast" in plan for _, plan in seen)


def test_links_to_roots_take_no_step(spark, monkeypatch):
    seen = kept_plans(monkeypatch, components)
    got = dict(components.components(spark.createDataFrame([(9, 1), (1, 8), (7, 2), (7, 2)], "u long, v long")).collect())
    assert got == {1: 1, 8: 1, 9: 1, 2: 2, 7: 2} and [name for name, _ in seen] == ["links", "labels"]


def test_a_round_makes_labels_once(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS", 0.0)
    monkeypatch.setattr(minhash, "LEAST_PAIRS", 12)
    seen, whole = kept_plans(monkeypatch, minhash), minhash._joined
    made = []
    monkeypatch.setattr(minhash, "_joined", lambda *a: made.append(0) or whole(*a))
    rng = random.Random(5)
    base = sentence(rng, 120)
    rows = [(i, edited(rng, base, rng.randint(0, 9)), "s") for i in range(60)]
    got = minhash.near_groups(documents(spark, rows, []), minhash.Rule()).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(groups_by_hand(rows, minhash.Rule()))
    rounds = sum(name == "stars" for name, _ in seen)
    assert rounds > 1 and rounds <= len(made) <= rounds + 1


def test_small_stars_are_compared_outright(spark, monkeypatch):
    seen = kept_plans(monkeypatch, minhash)
    rng = random.Random(5)
    base = sentence(rng, 120)
    rows = [(i, edited(rng, base, rng.randint(0, 9)), "s") for i in range(60)]
    got = minhash.near_groups(documents(spark, rows, []), minhash.Rule()).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(groups_by_hand(rows, minhash.Rule()))
    names = [name for name, _ in seen]
    assert "small-stars" in names and names.count("stars") == 1 and "shared-shingles" not in names


def test_words_are_parted_by_the_signer_alone(spark, monkeypatch):
    seen = kept_plans(monkeypatch, minhash)
    rng = random.Random(6)
    text = "Two  \tWords\x0b" + sentence(rng, 30)
    rows = [(1, text, "s"), (2, " ".join(text.upper().split()), "s"), (None, text, "s"), (4, None, "s"), (5, "", "s"), (6, "one", "s"), (1, "other " + text, "s")]
    found = minhash.near_groups(documents(spark, rows, []), minhash.Rule())
    keys = {r.doc_id: bytes(r.key) for r in found.where("doc_id <> 1").collect()}
    assert keys == {i: hashlib.md5(" ".join((t or "").lower().split()).encode()).digest() for i, t, _ in rows if i and i != 1}
    kept = minhash.one_of_each(documents(spark, rows, []), minhash.Rule())
    plans = [plan for _, plan in seen] + [kept._jdf.queryExecution().executedPlan().toString()]
    assert not any("split(" in plan for plan in plans)
    assert sorted(r.doc_id for r in kept.collect() if r.text) == [1, 1, 6]


def test_a_filter_for_few_keys_is_small(spark, monkeypatch):
    kept, whole = [], minhash.staged
    monkeypatch.setattr(minhash, "staged", lambda df, name: kept.append(whole(df, name)) or kept[-1])
    rows = spark.range(50_000).selectExpr("id * 8589934592 AS node")
    wanted = spark.range(0, 50_000, 100).selectExpr("id * 8589934592 AS node")
    some = minhash._maybe(rows, "node", wanted, 500)
    assert some.join(wanted, "node", "left_semi").count() == 500 and some.count() < 600
    assert kept[0].count() <= 16


# --- 3: shards


def test_slots_are_a_permutation():
    for n in (1, 2, 3, 17, 1000):
        a, b = shards.slots(np.arange(n), n, 1), shards.slots(np.arange(n), n, 2)
        assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(n))
    assert a.tolist() != b.tolist() and a.tolist() != list(range(1000))


def test_shards_give_the_texts_back(spark):
    tokenizer = shards.Tokenizer({bytes([b]): b for b in range(256)} | {b"w1": 256, b"w2": 257}, r"\s?\S+|\s+", 258)
    rows = [r for r in odd_rows(random.Random(2)) if r[0]]
    written = shards.materialise(documents(spark, rows, ["part", "n", "data"]), tokenizer, key=5, length=64)
    records = sorted(shards.read_records(written, tokenizer, 64).collect())
    assert [r.slot for r in records] == list(range(len(records)))
    stride = shards.record_type(tokenizer.end, 64).itemsize
    assert all(len(r.data) == stride * r.records for r in written.collect())
    encoding = tokenizer.encoding()
    want = Counter(t or "" for _, t, _ in rows)
    by_text = Counter()
    parts = sorted(records, key=lambda r: (r.doc_id, r.part))
    for i in {r.doc_id for r in parts}:
        ids = [x for r in parts if r.doc_id == i for x in r.ids]
        copies = sum(r.part == 0 for r in parts if r.doc_id == i)
        by_text[encoding.decode([x for x in ids[: len(ids) // copies] if x != tokenizer.end])] += copies
    assert by_text == want
    assert shards.read_records(written, tokenizer, 64, start=100).count() == len(records) - 100
    assert shards.materialise(documents(spark, rows).where("false"), tokenizer).count() == 0


def test_every_sequence_has_its_slot_and_files_follow_the_slots(spark, monkeypatch):
    monkeypatch.setattr(shards, "LEAST_SHARDS", 1)
    rng = random.Random(3)
    tokenizer = shards.Tokenizer({bytes([b]): b for b in range(256)}, r"\s?\S+|\s+", 256)
    docs = staged(documents(spark, [(i, sentence(rng, rng.randrange(60)), "a") for i in range(300)]).repartition(7, "doc_id"), "t-shards")
    numbered = shards.sequences(docs, tokenizer, 16).collect()
    n = len(numbered)
    assert sorted(r["index"] for r in numbered) == list(range(n))
    where = shards.slots(np.array([r["index"] for r in numbered]), n, 9)
    written = shards.write_shards(shards.sequences(docs, tokenizer, 16), n, tokenizer, 9, 16, per_shard=256)
    got = {r.slot: (r.doc_id, r.part, r.n) for r in shards.read_records(written, tokenizer, 16).collect()}
    assert got == {int(s): (r.doc_id, r.part, r.n) for s, r in zip(where, numbered, strict=True)}
    files = sorted((r.f, r.lo, r.hi) for r in written.groupBy(F.input_file_name().alias("f")).agg(F.min("first_slot").alias("lo"), F.max("first_slot").alias("hi")).collect())
    assert len(files) > 5 and all(a[2] < b[1] for a, b in zip(files, files[1:]))


# --- 4: lines


def test_lines_on_many_sites_go(spark):
    rng = random.Random(4)
    wide, near, few, short = "all rights are reserved here", "this line stands on eight", "this line stands on seven", "too short"
    rows = []
    for i in range(40):
        own = [sentence(rng, 12) for _ in range(4)]
        lines = own + [wide] + ([near] if i % 20 < 8 else []) + ([few] if i % 20 < 7 else []) + [short]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), f"site{i % 20}"))
    rows += [(50, wide, "site1"), (51, f"{wide}\n\n{wide}\nmore of my own words than of theirs by far", "site2"), *odd_rows(rng)]
    sites = {}
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            sites.setdefault(x, set()).add(s or "")
    bad = {x for x, s in sites.items() if len(s) >= line_spread.MIN_SITES and len(split(x)) >= line_spread.MIN_WORDS}
    assert bad == {wide, near}
    want, held = Counter(), Counter(t for _, t, _ in rows)
    for i, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        gone = [x for x in lines if x in bad]
        goes = held[t] == 1 or sum(len(split(x)) for x in gone) <= 0.5 * sum(len(split(x)) for x in lines)
        want[i, "\n".join(x for x in lines if x not in bad) if goes and t is not None else t, len(lines), len(gone) if goes else 0] += 1
    got = line_spread.without_boilerplate(documents(spark, rows, ["n_lines", "line", "_id", "_text", "_out"]))
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == want
    assert line_spread.without_boilerplate(documents(spark, rows).where("false")).count() == 0


def test_texts_of_mostly_boilerplate_lose_it(spark):
    wide = [f"all rights of kind {i} are reserved here" for i in range(5)]
    rows = [(i, "\n".join([*wide, f"own words of page {i}"]), f"site{i}") for i in range(8)]
    rows += [(20, "\n".join(wide), "site1"), (21, "\n".join(wide), "site2"), (22, wide[0], "site3"), *[(30, f"{wide[0]}\n{'my words ' * 9}", "s")] * 2, (23, None, "a"), (24, "", "a")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_spread.without_boilerplate(documents(spark, rows, ["_goes"])).collect()}
    want = {i: (f"own words of page {i}", 5) for i in range(8)} | {20: (rows[8][1], 0), 21: (rows[9][1], 0), 22: ("", 1), 30: ("my words " * 9, 1), 23: (None, 0), 24: ("", 0)}
    assert got == want


# --- 5: benchmark items


def distance_by_hand(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_items_are_found_within_their_edits(spark):
    rng = random.Random(5)
    letters = "abcdefg  "
    items = [(n, "".join(rng.choice(letters) for _ in range(rng.randint(40, 90)))) for n in range(8)] + [(90, None), (91, ""), (92, "Ab")]

    def mangled(text, n):
        c = list(text)
        for _ in range(n):
            at = rng.randrange(len(c))
            c[at : at + 1] = rng.choice([[], [rng.choice(letters)], [c[at], rng.choice(letters)]])
        return "".join(c)

    rows = [(i, " ".join([sentence(rng, 5), mangled(rng.choice(items[:8])[1], rng.randint(0, 8)), sentence(rng, 5)]), "s") for i in range(60)]
    rows += [(500 + i, t, s) for i, t, s in odd_rows(rng)[:4]] + [(70, "ab\n\nc", "s"), (70, "ab\n\nc", "s")]
    folded = decontaminate.folded
    want = Counter()
    for i, t, _ in rows:
        for n, x in items:
            k = int(len(folded(x)) * decontaminate.RATE)
            if folded(x) and len(t or "") < 2000 and (d := distance_by_hand(folded(x), folded(t))) <= k:
                want[i, n, d] += 1
    docs, table = documents(spark, rows, ["item_id"]), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(docs, table).collect()
    assert len(want) > 20 and Counter((r.doc_id, r.item_id, r.distance) for r in got) == want
    for r in got:
        text = folded(next(t for i, t, _ in rows if i == r.doc_id))
        assert distance_by_hand(folded(dict(items)[r.item_id]), text[r.start : r.end]) == r.distance
    clean = decontaminate.without_leaks(docs, table)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _, _ in rows if i not in {k[0] for k in want})
    assert decontaminate.leaks(docs, table.where("false")).count() == 0 and decontaminate.leaks(docs.where("false"), table).count() == 0


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    items = spark.createDataFrame([(i, f"benchmark passage number {i} stands here") for i in range(6)], "item_id long, text string")
    docs = documents(spark, [(i, f"before benchmark passage number {i} stands here after", "s") for i in range(9)])
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).where("distance = 0").collect()} == {(i, i) for i in range(6)}
    assert decontaminate.without_leaks(docs, items).count() <= 3


# --- 6: quality


def counts_by_hand(t):
    t = t or ""
    w = t.encode().split()
    lines = [x for x in t.split("\n") if x.encode().split()]
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_base_counts(spark):
    rng = random.Random(6)
    rows = odd_rows(rng) + [(20, "a b c d e f g h i a b c d e f g h", "s"), (21, "x " * 40, "s"), (22, "l m\nl m\n\n \nl m\nn", "s"), (23, "#*$ %&|<> é😀", "s")]
    got = quality_outliers.base_counts(documents(spark, rows, ["n_words", "_runs"])).collect()
    assert Counter((r.doc_id, *(r[c] for c in quality_outliers.COUNTS)) for r in got) == Counter((i, *counts_by_hand(t)) for i, t, _ in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def model_by_hand(x):
    """The same estimate with plain arrays."""
    floors = np.diag(np.square(quality_outliers.FLOORS))
    bins = np.floor(x / quality_outliers.VALUE_BIN)

    def quantile(b, q):
        return (np.sort(b)[int(np.ceil(q * len(b))) - 1] + 0.5) * quality_outliers.VALUE_BIN

    mean = np.array([quantile(b, 0.5) for b in bins.T])
    scatter = np.diag([((quantile(b, 0.75) - quantile(b, 0.25)) / 1.349) ** 2 for b in bins.T]) + floors

    def far():
        return np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(scatter), x - mean)

    for step in range(quality_outliers.STEPS + 1):
        d = far()
        b = np.floor(np.log2(1 + d) / quality_outliers.DISTANCE_BIN)
        if step < quality_outliers.STEPS:
            near = b <= np.sort(b)[int(np.ceil(quality_outliers.SHARE * len(b))) - 1]
        else:
            near = np.isin(b, [v for v in set(b) if d[b == v].min() <= quality_outliers.FAR])
        mean, scatter = x[near].mean(0), np.cov(x[near].T, bias=True) + floors
    return far() <= quality_outliers.FAR


def test_outliers_are_those_of_the_plain_estimate(spark):
    rng = random.Random(66)
    rows = []
    for i in range(400):
        text = "\n".join(sentence(rng, rng.randint(8, 20), 3000) for _ in range(rng.randint(3, 8)))
        if i % 13 == 0:
            text = " ".join(f"{x}###" for x in text.split())
        if i % 17 == 0:
            text = "\n".join([text, *["the same line once more"] * 12])
        rows.append((i, text, "big" if i % 4 else "other"))
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)
    got = {r.doc_id: r for r in quality_outliers.quality(docs).collect()}
    vectors = {i: (lambda n, c, s, d, r: (np.log((c + 250) / (n + 50)), np.log1p(s / n), d / len([x for x in t.split("\n") if x.split()]), r / n))(*counts_by_hand(t)) for i, t, _ in rows}
    for source in ("big", "other"):
        ids = [i for i, _, s in rows if s == source and not got[i].base_failed]
        assert [got[i].kept for i in ids] == model_by_hand(np.array([vectors[i] for i in ids])).tolist()
    assert not any(got[i].kept for i in range(0, 400, 13))
    assert np.mean([got[i].kept for i in range(400) if i % 13 and i % 17]) > 0.99


def test_junk_of_nearly_half_a_group_goes(spark):
    rng = random.Random(40)
    junk = {"clean": 0, "third": 33, "more": 40}
    rows = []
    for source, share in junk.items():
        for i in range(200):
            text = sentence(rng, rng.randint(60, 120), 3000)
            if i % 100 < share:
                text = " ".join(x + rng.choice(["###", "$$$", "&&&"]) for x in text.split())
            rows.append((len(rows), text, source))
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)
    kept = {r.doc_id: r.kept for r in quality_outliers.quality(docs).collect()}
    assert [kept[i] for i, _, _ in rows] == [i % 100 >= junk[s] for i, _, s in rows]


def test_quality_of_odd_rows(spark):
    rows = odd_rows(random.Random(3))
    got = quality_outliers.quality(documents(spark, rows, ["kept", "_group", "_d"]))
    assert Counter(r.doc_id for r in got.collect()) == Counter(i for i, _, _ in rows)
    assert {r.doc_id for r in got.where("kept").collect()} <= {4, 5}
    assert quality_outliers.quality(documents(spark, rows).where("false")).count() == 0


# --- 7: pages


@pytest.fixture(scope="module")
def trees(spark):
    return html_trees.fit(spark)


def test_held_out_pages(trees):
    rng, right = random.Random(77), 0
    for _ in range(120):
        html, main = html_trees._labelled_page(rng)
        right += html_trees.main_text(html, trees) == "\n".join(" ".join(x.split()) for x in main)
    assert right >= 114
    x, y = html_trees.labelled_nodes(60, seed=78)
    assert np.mean((trees.margin(x) > 0) == (y > 0.5)) > 0.98


def test_pages_with_oddities(spark, trees):
    article = "<article><h1>Title &amp; more</h1><p>First  line\nof text, long enough to be the article of this page.<p>Second&nbsp;one &#8217;tis a &lt; b, and quite some more words.</article>"
    page = f"<body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><div class=ad>Buy now<div>cheap</div></div>{article}<section id='comments'><p>I like it very much.</p></section><footer>(c)</footer>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "u", ""), (3, "u", "<p"), (4, "u", "plain < text"), (5, "u", "<div>" * 5000 + "deep" + "</div>" * 5000), (6, "u", "<script>var a='<p>no</p>'</script>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    got = html_trees.extract(df, trees).collect()
    text = "Title & more\nFirst line of text, long enough to be the article of this page.\nSecond one ’tis a < b, and quite some more words."
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    assert all(r.text == text for r in got if r.page_id == 1) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (2, None, 6)] == ["", "", ""]
    assert html_trees.extract(df.where("false"), trees).count() == 0


@pytest.mark.parametrize("start", ["<html><head><title>T</title><body>", "<head><meta charset=utf-8><title>T</title>", "<title>T</title>", "<html><head><noscript><div>no script</div></noscript></head><body>", "<head><style>p{}</style><noscript><img src=x>off</noscript><body>"])
def test_tags_that_may_be_left_out(start):
    page = html_trees.Page(f"{start}<article><p>One <svg/>two <math />three<p>Four <svg><title>no</title><path/></svg>five</article>")
    assert [t for _, t in page.blocks()] == ["One", "two", "three", "Four", "five"]
    assert [t for _, t in html_trees.Page("<head><title>T</title>Bare text").blocks()] == ["Bare text"]


# --- 8: archives


def test_archives_round_trip_through_the_index(spark, monkeypatch):
    rows = [(i, f"http://Host{i % 7}.example.org:80/p/{i}?q={i}", f"<p>{i % 5} é</p>" * (i % 3)) for i in range(60)]
    rows += [(60, None, None), (61, "not a url \r\n", ""), (None, "http://x.org/", "<p>only</p>"), (None, "http://x.org/", "<p>only</p>"), (59, rows[59][1], rows[59][2]), (62, "http://[bad", "x" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("mine"))
    for least in (0, 5):
        archives = warc.write_archives(df, least)
        index = warc.build_index(archives)
        got = warc.read_ranges(archives, index.captures()).collect()
        want = Counter()
        for i, _, h in rows:
            data = (h or "").encode()
            same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
            first = max(same) if len(data) >= least and len([g for _, _, g in rows if (g or "") == (h or "")]) > 1 and same and max(same) != i else None
            want[i, len(data), warc._base32(hashlib.sha1(data).digest()), "response" if first is None else "revisit", first, None if first is not None else h or ""] += 1
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.html) for r in got) == want
    urls = spark.createDataFrame([(rows[3][1],), ("http://x.org/",), ("http://absent.org/",), (None,)], "url string")
    assert sorted(str(r.page_id) for r in warc.read_ranges(archives, index.find(urls)).collect()) == ["3", "60", "None", "None"]
    assert warc.build_index(warc.write_archives(df.where("false"))).captures().count() == 0
    assert warc.capture_key("https://a.B.example.com:8080/x?y=1") == "com,example,b,a)/x?y=1"


def test_look_up_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_ENTRIES", 7)
    rows = [(i, f"http://h{i % 11}.org/" + ("same" if i % 2 else f"{i}" + "x" * 300), f"{i}") for i in range(200)]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    index = warc.build_index(archives)
    assert len(index.directory) > 20
    for url in (rows[1][1], rows[2][1]):
        found = index.find(spark.createDataFrame([(url,)], "url string"))
        assert sorted(r.page_id for r in found.collect()) == [i for i, u, _ in rows if u == url]


# --- 9: secrets


def test_base_spans_and_owners(spark):
    key, common = "AKIA" + "ABCDEFGH12345678", "deadbeef" * 4
    mine, shared = "ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vX7", "ghp_" + "zZ1yY2xX3wW4vV5uU6tT7sS8"
    rows = [
        (1, f'x password = "hunter2pass" {key} {mine}', "a"), (2, f"é😀 Api_Key:abcdef {common}", "a"), (3, "token=token:abcdefgh secret=ab", "b"),
        (44, f"{shared} {common}", "a"), (45, f"{shared} {common}", "b"), (46, f"{shared} {common}", "c"), (46, f"{shared} {common}", "c"),
        *[r for r in odd_rows(random.Random(9)) if r[0] not in (1, 2, 3)],
    ]
    df = documents(spark, rows, ["_found", "n_live", "secrets"])
    got = secret_owners.scan(df).withColumn("spans", secret_owners.span_text(F.col("secrets"))).collect()
    spans = {r.doc_id: r.spans for r in got}
    at = rows[0][1].index
    assert spans[1] == f"assign:2:{at(key) - 2},access:{at(key)}:{at(key) + len(key)},live:{at(mine)}:{at(mine) + len(mine)}"
    assert spans[2] == f"assign:3:17,hex:18:{18 + len(common)}" and spans[3] == "" and spans[46] == f"hex:29:{29 + len(common)}"
    by_id = {r.doc_id: (r.n_live, r.n_example) for r in got}
    assert by_id[46] == (0, 2) and by_id[1][0] >= 1
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    assert secret_owners.scan(df.where("false")).count() == 0


def test_values_of_many_repositories_are_examples_whoever_owns_them(spark):
    token = lambda k: "ghp_" + f"aB3dE5gH7jK9mN1pQ3sT5v{k:02d}"
    rows = [(i, token(1), "a") for i in range(secret_owners.EXAMPLE_REPOS)] + [(i, token(2), "a") for i in range(secret_owners.EXAMPLE_REPOS - 1)] + [(7, token(2), "a")]
    got = Counter((r.n_live, r.n_example) for r in secret_owners.scan(documents(spark, rows)).collect())
    assert got == {(0, 1): secret_owners.EXAMPLE_REPOS, (1, 0): secret_owners.EXAMPLE_REPOS}


def test_a_text_of_very_many_matches(spark):
    long = " é ".join(["deadbeef" * 3 + f"{i:05d}" for i in range(20_000)] + ["ghp_aB3dE5gH7jK9mN1pQ3sT5vX7"] * 10_000)
    start = time.time()
    row = secret_owners.scan(documents(spark, [(1, long, "a")])).first()
    spans = [(x["start"], x["end"]) for x in row.secrets]
    assert time.time() - start < 60 and len(spans) == 30_000 and row.n_live > 29_000
    assert spans == [m.span() for m in re.finditer(r"[0-9a-f]{24,}|ghp_\w+", long)]


# --- 10: pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(pieces.default_model())


def test_encoding_is_the_model_s(spark, vocabulary):
    import sentencepiece

    rng = random.Random(10)
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = ["".join(rng.choice("abcdeinorst  \n\tÉßé1290.,!日😀") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += ["a" * 700, " ", "  ", "\n", " \n ", "▁ x▁▁y", *[t for _, t, _ in odd_rows(rng)[3:5]]]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + odd_rows(rng)
    got = pieces.encoded_and_checked(documents(spark, rows, ["ids", "decoded"]), vocabulary)
    assert "text" not in got.columns and got.where("not round_trip").count() == 0
    ids = Counter((r.doc_id, tuple(r.ids)) for r in got.collect())
    assert ids == Counter((i, tuple(own.encode(t or ""))) for i, t, _ in rows)
    assert pieces.encode(documents(spark, rows).where("false"), vocabulary).count() == 0


def test_unigram_scores_give_the_best_path():
    ranks = {"▁": -2.0, "a": -1.5, "b": -1.6, "ab": -2.0, "▁a": -2.5, "ba": -2.2, "▁ab": -4.4, "abab": -3.9}
    v = pieces.Vocabulary(["<unk>", *ranks], ranks, {p: i + 1 for i, p in enumerate(ranks)}, -1, 0, False, True, {})

    def best(word):
        if not word:
            return 0.0
        return max([ranks[word[:n]] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in ranks], default=-99.0)

    words = sorted({"▁" + "".join(random.Random(i).choice("ab") for _ in range(i % 9)) for i in range(60)})
    for word, ids in pieces.Encoder(v).encode(words).items():
        assert "".join(v.pieces[i] for i in ids) == word
        assert sum(ranks[v.pieces[i]] for i in ids) == pytest.approx(best(word))
    assert pieces.Encoder(v).encode(["▁c"])["▁c"] == (1, 0)
