import plans
from pyspark.sql import functions as F

from sourceweave import schemas
from sourceweave.operators import evidence as ev
from sourceweave.session import scratch_path, staged
from sourceweave.sources import store
from sourceweave.streaming import jobs, triggers


def batch(spark, rows):
    df = spark.createDataFrame(rows, "id string, excerpt_hash string, pos int")
    for c in ("run_id", "url", "title", "author", "excerpt", "locator"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("pos") * 86400)
    return df.withColumn("published_at", F.lit(None).cast("timestamp")).withColumn("retrieved_at", at).withColumn(
        "source_quality", F.lit(None).cast(schemas.SOURCE_QUALITY)
    )


def sequential(rows, ids=(), hashes=()):
    """Row-at-a-time rule of the store."""
    ids, hashes, out = set(ids), set(hashes), []
    for i, h, p in sorted(rows, key=lambda r: r[2]):
        if i not in ids and h not in hashes:
            ids.add(i), hashes.add(h), out.append((i, h))
    return sorted(out)


def test_writes_follow_the_sequential_rule(spark):
    path = scratch_path(spark, "t-store")
    rows = [("a", "h1", 0), ("a", "h2", 1), ("b", "h2", 2), ("c", "h2", 3), ("d", "h1", 4), ("c", "h3", 5), ("c", "h4", 6), ("e", "h4", 7)]
    expected = sequential(rows)
    assert store.write_evidence(batch(spark, rows), path, ["pos"]) == len(expected)
    assert sorted((r.id, r.excerpt_hash) for r in store.read_store(spark, path).collect()) == expected
    assert store.write_evidence(batch(spark, rows), path, ["pos"]) == 0


def test_equal_rows_go_in_once_and_rows_without_keys_never(spark):
    path = scratch_path(spark, "t-equal")
    rows = batch(spark, [("a", "h1", 0), ("a", "h1", 0), ("b", None, 1), (None, "h2", 2), (None, None, 3), ("c", "h2", 4)])
    assert store.write_evidence(rows, path, ["pos"]) == 2
    assert sorted((r.id, r.excerpt_hash) for r in store.read_store(spark, path).collect()) == [("a", "h1"), ("c", "h2")]
    assert store.rejected(rows).count() == 3
    assert store.write_evidence(rows, path, ["pos"]) == 0


def many(spark, ids):
    return batch(spark, [(f"id{n}", f"{n:05x}", n) for n in ids])


def test_only_parts_that_may_hold_a_key_are_read(spark, monkeypatch):
    monkeypatch.setattr(store, "ROWS_PER_PART", 16)
    path = scratch_path(spark, "t-parts")
    assert store.write_evidence(many(spark, range(1500)), path, ["pos"]) == 1500
    assert store.write_evidence(many(spark, range(1400, 3000)), path, ["pos"]) == 1500
    for kind, key in store.KEYS.items():
        names = store.parts(spark, path).where(F.col("kind") == kind).select("part").distinct().count()
        known = store.may_hold(spark, path, kind, many(spark, [7, 2000]).select(key))
        assert names > 300 and known.count() <= 80  # what is read, of 3,000 rows
        assert {r[0] for r in known.select(key).collect()} >= {r[0] for r in many(spark, [7, 2000]).select(key).collect()}
        absent = store.may_hold(spark, path, kind, many(spark, range(90_000, 90_100)).select(key))
        assert absent.count() <= 200
        assert "part#" in plans.text_of(known).split("PartitionFilters: [")[1].split("]")[0]


def test_lookups_on_the_written_store(spark, monkeypatch):
    monkeypatch.setattr(store, "ROWS_PER_PART", 50)
    path = scratch_path(spark, "t-look")
    assert store.get(spark, path, "id1").count() == 0
    store.write_evidence(many(spark, range(300)), path, ["pos"])
    assert [r.excerpt_hash for r in store.get(spark, path, "id7").collect()] == ["00007"]
    assert store.get(spark, path, "gone").count() == 0
    asked = spark.createDataFrame([("id1",), ("id299",), ("id300",), (None,)], "id string")
    assert sorted(r.id for r in store.get_many(spark, path, asked).collect()) == ["id1", "id299"]
    hashes = spark.createDataFrame([("00001",), ("nope",), (None,)], "excerpt_hash string")
    assert {r.excerpt_hash: r.stored for r in store.exists_by_hash(hashes, path).collect()} == {"00001": True, "nope": False, None: False}


def test_compaction_keeps_the_rows_and_grows_the_buckets(spark, monkeypatch):
    path = scratch_path(spark, "t-compact")
    for n in range(0, 90, 30):
        store.write_evidence(many(spark, range(n, n + 30)), path, ["pos"])
    monkeypatch.setattr(store, "ROWS_PER_PART", 10)
    store.compact(spark, path)
    assert store.read_store(spark, path).count() == 90
    assert {r[0] for r in store.parts(spark, path).select(F.length("bucket")).distinct().collect()} == {1}
    assert store.write_evidence(many(spark, range(80, 100)), path, ["pos"]) == 10
    assert [r.id for r in store.get(spark, path, "id85").collect()] == ["id85"]


def test_the_list_of_parts_has_a_row_a_part_and_no_bitmaps(spark):
    path = scratch_path(spark, "t-list")
    store.write_evidence(many(spark, range(3000)), path, ["pos"])
    assert sorted((r.kind, r.n) for r in store.parts(spark, path).collect()) == [("ids", 3000), ("rows", 3000)]
    bitmaps = store._read(spark, f"{path}/bitmaps", store.BITMAPS)
    assert sorted(r["count"] for r in bitmaps.groupBy("part").count().collect()) == [2, 2]  # 48,000 bits each
    assert store.exists_by_hash(many(spark, range(3000)).select("excerpt_hash"), path).where("stored").count() == 3000


def test_unlisted_parts_do_not_count(spark):
    path = scratch_path(spark, "t-half")
    store.write_evidence(many(spark, range(5)), path, ["pos"])
    many(spark, [9]).select(*schemas.EVIDENCE_COLUMNS).withColumn("part", F.lit("half-")).write.mode("append").partitionBy("part").parquet(f"{path}/rows")
    assert store.read_store(spark, path).count() == 5
    assert store.write_evidence(many(spark, [9]), path, ["pos"]) == 1


def test_passes_of_a_write_carry_no_texts(spark, monkeypatch):
    seen, plain = [], store.counted
    monkeypatch.setattr(store, "counted", lambda df, name: seen.append(df.columns) or plain(df, name))
    schema = "id string, excerpt_hash string, excerpt string"
    batch = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "2", "z"), ("c", "3", "w")], schema)
    for c in schemas.EVIDENCE_COLUMNS:
        if c not in batch.columns:
            batch = batch.withColumn(c, F.lit(None).cast(spark.createDataFrame([], schemas.EVIDENCE).schema[c].dataType))
    path = scratch_path(spark, "keys-only")
    assert store.write_evidence(batch, path, ["excerpt_hash"]) == 3
    assert {(r.id, r.excerpt) for r in store.read_store(spark, path).collect()} == {("a", "x"), ("b", "z"), ("c", "w")}
    assert seen and not any("excerpt" in columns for columns in seen)
    assert store.write_evidence(batch, path, ["excerpt_hash"]) == 0


def test_hot_hash_leaves_one_row(spark):
    path = scratch_path(spark, "t-hot")
    rows = [(f"i{n}", "same" if n % 3 else f"h{n}", n) for n in range(300)]
    assert store.write_evidence(batch(spark, rows), path, ["pos"]) == len(sequential(rows))


def test_absent_store_reads_empty(spark):
    assert store.read_store(spark, scratch_path(spark, "none")).count() == 0


def test_round_trip_keeps_nulls_and_nesting(spark):
    path = scratch_path(spark, "t-round")
    full = spark.sql(
        "SELECT 'r' run_id, 'i' id, 'u' url, 't' title, CAST(NULL AS STRING) author, TIMESTAMP '2020-01-02 03:04:05' published_at, "
        "TIMESTAMP '2024-01-01' retrieved_at, 'é' excerpt, 'h' excerpt_hash, CAST(NULL AS STRING) locator, "
        "named_struct('is_peer_reviewed', true, 'is_primary_source', false, 'domain_reputation', CAST(NULL AS STRING), 'conflict_of_interest', false) source_quality, 1 pos"
    )
    store.write_evidence(full, path, ["pos"])
    assert store.read_store(spark, path).collect() == full.select(*schemas.EVIDENCE_COLUMNS).collect()


def test_search(spark):
    rows = spark.createDataFrame(
        [("1", "https://a.com/x", "About Sleep", "body", 1), ("2", "https://a.com/y", None, "100% sleep", 2), ("3", "https://b.com", "no", "no", 3)],
        "id string, url string, title string, excerpt string, retrieved_at int",
    )
    ids = lambda **k: [r.id for r in ev.search(rows, **k).collect()]
    assert ids() == ["3", "2", "1"]
    assert ids(topic="SLEEP") == ["2", "1"]
    assert ids(url="https://A.com") == ["2", "1"]
    assert ids(url="https://a.com", topic="about") == ["1"]
    assert ids(topic="0% s") == ["2"] and ids(topic="%") == ["2"] and ids(url="", topic="", limit=1) == ["3"]
    many = ev.search_many(rows, spark.createDataFrame([("sleep",), ("NO",), ("absent",)], "topic string"), 1).collect()
    assert sorted((r.topic, r.id) for r in many) == [("NO", "3"), ("sleep", "2")]


def test_a_write_copies_no_texts(spark, tmp_path, monkeypatch):
    kept = []
    for name in ("staged", "counted"):
        whole = getattr(store, name)
        monkeypatch.setattr(store, name, lambda df, label, whole=whole: kept.append((label, df.columns)) or whole(df, label))
    path = str(tmp_path / "store")
    rows = batch(spark, [("a", "h1", None), ("a", "h1", 3), ("b", "h2", 1), ("c", "h2", 0)])
    assert store.write_evidence(rows, path, ["pos"]) == 2
    assert sorted(r.id for r in store.read_store(spark, path).collect()) == ["a", "c"]
    assert kept and not [label for label, columns in kept if "excerpt" in columns]
    # a batch that would differ when read again is copied
    odd = many(spark, range(20)).withColumn("id", F.concat("id", F.rand().cast("string")))
    assert store.write_evidence(odd, path, ["pos"]) == 20
    assert [label for label, columns in kept if "excerpt" in columns] == ["evidence-batch"]


def test_hits_of_a_common_topic_are_cut_before_they_move(spark):
    rows = spark.range(400).selectExpr("cast(id AS string) id", "'u' url", "cast(null AS string) title", "'Sleep ' || id excerpt", "cast(id AS int) retrieved_at")
    found = ev.search_many(rows, spark.createDataFrame([("sleep",), ("SLEEP",), (None,), ("",)], "topic string"), 2)
    assert sorted((r.topic, r.id, r["rank"]) for r in found.collect()) == [(x, i, k) for x in ("SLEEP", "sleep") for i, k in (("398", 2), ("399", 1))]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("MapInArrow")[0].rsplit("Exchange hashpartitioning", 1)[1]


def test_lookups(spark):
    rows = batch(spark, [("a", "h1", 0), ("b", "h2", 1)])
    ids = spark.createDataFrame([("a",), ("z",)], "id string")
    assert [r.id for r in ev.get_many(rows, ids).collect()] == ["a"]
    assert ev.get(rows, "q").isEmpty()
    asked = spark.createDataFrame([("h2",), ("h9",)], "excerpt_hash string")
    assert {r.excerpt_hash: r.stored for r in ev.exists_by_hash(asked, rows).collect()} == {"h2": True, "h9": False}
    new = batch(spark, [("c", "h2", 0), ("d", "h7", 1)])
    assert {(r.minted_id, r.id) for r in ev.canonicalise_ids(new, rows).collect()} == {("c", "b"), ("d", "d")}


def test_source_updates_cross_buckets(spark):
    rows = [("u", t, h) for t, h in [(1, "a"), (2, "a"), (11, "a"), (12, "b"), (35, "b"), (36, "c"), (51, "a")]] + [("v", 5, "x")]
    df = spark.createDataFrame(rows, "url string, t int, content_hash string")
    got = triggers.source_updates(df, ["t"], lambda: F.floor(F.col("t") / 10)).collect()
    assert sorted((r.t, r.previous_hash, r.content_hash) for r in got) == [(12, "a", "b"), (36, "b", "c"), (51, "c", "a")]


def test_sessions_over_days_equal_plain_sessions(spark):
    rows = [(u, 86400 * 19700 + (i * i * 977 + u * 41) % 400_000 // 60 * 60) for u in (1, 2) for i in range(150)]
    rows += [(3, 86400 * 19700 + i * 3600) for i in range(60)]  # gaps of exactly the limit, across midnights
    df = spark.createDataFrame(rows, "user_id int, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
    cols = ["user_id", "session_start", "n", "last_ts"]
    plain = triggers.usage_sessions(df, "1 hour").select(*cols).collect()
    assert sorted(triggers.usage_sessions_table(df, "1 hour").select(*cols).collect()) == sorted(plain)


def test_stream_resumes_without_repeats(spark):
    """Two files arriving one after the other give the batch result of both."""
    base = scratch_path(spark, "t-stream")
    log = spark.createDataFrame(
        [(f"j{i % 3}", i, f"2024-01-{1 + i % 9:02d}", "completed" if i % 4 == 0 else "running", "write") for i in range(60)],
        "job_id string, event_id int, day string, status string, stage string",
    ).withColumn("ts", F.col("day").cast("timestamp")).drop("day")
    halves = [log.filter("event_id < 30"), log.filter("event_id >= 30")]
    for half in halves:
        half.coalesce(1).write.mode("append").parquet(f"{base}/in")
        feed = spark.readStream.schema(log.schema).parquet(f"{base}/in")
        # last states per batch: batches merge by key, counts grow in the state
        jobs.job_events_stream(feed, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    now = jobs.latest(spark, f"{base}/out", ["job_id"]).select("job_id", "status", "n_events")
    assert sorted(now.collect()) == sorted(triggers.job_state(log).select("job_id", "status", "n_events").collect())


def test_staged_keeps_rows(spark):
    df = spark.range(10).withColumn("x", F.array("id"))
    assert sorted(staged(df, "t").collect()) == sorted(df.collect())


def test_late_signals_join_the_closed_sessions(spark):
    rows = [("a", 0), ("a", 1), ("a", 12), ("a", 18), ("a", 40), ("b", 3), ("b", 200), ("c", 5), (None, 4), (None, 5)]
    events = spark.createDataFrame([(u, float(h)) for u, h in rows], "user_id string, h double").select("user_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("h") * 3600).alias("ts"))
    whole = triggers.usage_sessions_table(events, "6 hours")
    hour = (F.unix_seconds("session_start") - 1_700_000_000) / 3600
    # closed without the signals at 12 and 18, which came late, and before those of b at 200 and of c
    closed = triggers.usage_sessions_table(events.where("unix_seconds(ts) NOT IN (1700043200, 1700064800, 1700720000) AND (user_id <> 'c' OR user_id IS NULL)"), "6 hours")
    done = triggers.complete_sessions(events, closed, "6 hours")
    key = lambda df: sorted((str(r.user_id), r.h, r.n) for r in df.select("user_id", hour.alias("h"), "n").collect())
    assert key(done) == key(whole) and len(key(whole)) == 7
    assert key(triggers.complete_sessions(events, closed.limit(0), "6 hours")) == key(whole)


def test_streamed_updates_equal_the_batch_with_late_and_repeated_fetches(spark):
    base = scratch_path(spark, "t-updates")
    rows = [(f"u{n % 5}", n, f"h{n // 7 % 3}") for n in range(60)]
    schema = "url string, at long, content_hash string"
    batches = [rows[10:30], rows[:10] + rows[25:35], rows[35:], rows[:60], [("u9", 1, None), ("u9", 2, "x"), ("u9", 3, "y")]]
    for n, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{base}/in/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        jobs.source_updates_stream(stream, f"{base}/out", f"{base}/checkpoint", ["at"], lambda: F.floor(F.col("at") / 8)).awaitTermination()
        seen = spark.createDataFrame(sum(batches[: n + 1], []), schema).distinct()
        want = triggers.source_updates(seen, ["at"], lambda: F.floor(F.col("at") / 8))
        key = lambda df: sorted((r.url, r.at, r.content_hash, r.previous_hash) for r in df.collect())
        assert key(jobs.current_updates(spark, f"{base}/out")) == key(want) != []
