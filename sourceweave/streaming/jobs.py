"""Incremental forms of the batch operators with Structured Streaming.

Sinks write through ``foreachBatch`` into tables below the caller's paths; checkpoints belong in the
cluster's shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import discovery as d
from ..operators import gate as g
from ..session import staged
from ..sources import crawl, store
from . import triggers


def page_evidence(fetches: DataFrame, run_id: Column, retrieved_at: Column) -> DataFrame:
    """Raw fetches -> evidence rows with the batch operators; page order is by URL."""
    pages = d.drop_empty_pages(crawl.read_crawl(fetches).withColumn("run_id", run_id).withColumn("page_pos", F.lit(0)))
    return d.extract_evidence(pages, retrieved_at)


def ingest_stream(pages: DataFrame, store_path: str, checkpoint: str, run_id: Column, retrieved_at: Column) -> StreamingQuery:
    """New pages -> excerpts -> store. Ids derive from the content, so a replayed batch inserts nothing."""

    def absorb(batch: DataFrame, batch_id: int) -> None:
        rows = staged(page_evidence(batch, run_id, retrieved_at), "page-evidence")  # a store reads its batch more than once
        store.write_evidence(rows, store_path, ["url", "chunk_pos"])

    return (
        crawl.pages_as_fetches(pages)
        .writeStream.foreachBatch(absorb)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dedup_stream(evidence: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First row per excerpt hash within the watermark; state is dropped behind it."""
    return evidence.withWatermark("retrieved_at", delay).dropDuplicatesWithinWatermark(["excerpt_hash"])


def write_updates(stream: DataFrame, path: str, checkpoint: str, mode: str) -> StreamingQuery:
    """Write a stateful result batch by batch; :func:`latest` reads the current state back.

    A replayed batch overwrites its own folder, so results stay exactly once.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode).foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest row per key over the written batches."""
    rows = spark.read.parquet(f"{path}/batch=*")
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*keys, "_r.*")


def recurate_triggers_stream(
    events: DataFrame, path: str, checkpoint: str, keys: list[str], width: str, flagged: Column, slide: str | None = None,
    delay: str = "1 day",
) -> StreamingQuery:
    """Windowed counts of flagged signals as they arrive, for :func:`latest` and a threshold on ``n``.

    Update mode keeps every open window current; append mode would hold each back until the watermark.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return write_updates(triggers.usage_windows(timed.filter(flagged), keys, width, slide), path, checkpoint, "update")


def usage_sessions_stream(events: DataFrame, path: str, checkpoint: str, gap: str, delay: str = "1 day") -> StreamingQuery:
    """Sessions per user; append mode gives each session once, when the watermark has passed it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return write_updates(triggers.usage_sessions(timed, gap), path, checkpoint, "append")


#: Folders that the fetches of all URLs are dealt to; a batch reads those of its own URLs.
URL_BUCKETS = 64


def _url_bucket() -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(URL_BUCKETS)).alias("_bucket")


def source_updates_stream(fetches: DataFrame, path: str, checkpoint: str, order: list[str], bucket: Callable[[], Column]) -> StreamingQuery:
    """:func:`triggers.source_updates` of a stream of fetches (url, content_hash, the columns of ``order``).

    Kept are each URL's fetch keys and hashes, by hash bucket. A batch is added to them, and the changes of the URLs it
    holds are found anew over their fetches so far, so a late fetch falls into its place and a repeat changes nothing. A
    replayed batch overwrites its own folders. :func:`current_updates` reads the changes back.
    """

    def absorb(batch: DataFrame, batch_id: int) -> None:
        spark, columns = batch.sparkSession, ["url", "content_hash", *order]
        batch.select(*columns, _url_bucket()).distinct().write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/fetches/batch={batch_id:09d}")
        kept = spark.read.option("basePath", f"{path}/fetches").parquet(f"{path}/fetches").where(F.col("batch") <= batch_id)
        mine = kept.where(F.col("batch") == batch_id)
        urls = mine.select("url").distinct()
        buckets = [r[0] for r in mine.select("_bucket").distinct().collect()]  # at most URL_BUCKETS
        known = kept.where(F.col("_bucket").isin(buckets)).join(urls, "url", "left_semi").select(*columns).distinct()
        changes = triggers.source_updates(known, order, bucket)
        urls.join(changes, "url", "left").write.mode("overwrite").parquet(f"{path}/updates/batch={batch_id:09d}")

    return fetches.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_updates(spark: SparkSession, path: str) -> DataFrame:
    """The changes of each URL by the last batch that held it."""
    rows = spark.read.parquet(f"{path}/updates")
    last = rows.groupBy("url").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["url", "batch"], "left_semi").where("previous_hash IS NOT NULL").drop("batch")


def compact(spark: SparkSession, path: str, keys: list[str], target: str) -> None:
    """The newest row per key as a table of its own at ``target``, for readers of a long-running :func:`write_updates`."""
    latest(spark, path, keys).write.mode("overwrite").parquet(target)


def job_events_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Current state per job from its event stream (job_id, status, stage, ts, event_id).

    State is held for each job seen; its size is that of the job table.
    """
    return write_updates(triggers.job_state(events), path, checkpoint, "update")


def gate_stream(
    reports: DataFrame, config: DataFrame, paths: dict[str, str], checkpoint: str
) -> StreamingQuery:
    """Reports stream against the gate settings, routed to the publish, rewrite and review tables.

    ``reports`` carry content, risk_profile, iteration, counts and scores; ``paths`` maps pass, fail and
    review to tables.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        judged = g.route(g.feedback(g.decide(g.citation_density(g.gate_profile(batch, config)))))
        staged = f"{paths['staged']}/batch={batch_id}"
        judged.write.mode("overwrite").partitionBy("decision").parquet(staged)
        rows = batch.sparkSession.read.schema(judged.schema).option("basePath", staged).parquet(staged)
        for decision in ("pass", "fail", "review"):
            rows.filter(F.col("decision") == decision).write.mode("overwrite").parquet(f"{paths[decision]}/batch={batch_id}")

    return reports.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
