"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "sourceweave", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators rely on: AQE with skew joins, UTC, ANSI."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # ranks up to this limit are cut in each task before the shuffle
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "100000")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", "12g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; in local mode, where it may be unset, one in the working folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        current = spark.sparkContext.getCheckpointDir()
        if current is not None:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = os.path.join(os.getcwd(), "spark-checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the checkpoint folder and read back.

    Stages that later stages read several times are cut here: their plan is not repeated, and the files
    outlive lost executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """:func:`staged` with the number of rows, observed while they are written."""
    seen = Observation(name)
    return staged(df.observe(seen, F.count(F.lit(1)).alias("n")), name), seen.get["n"]
