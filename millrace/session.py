"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime re-planning is what absorbs skew on joins: oversized sort-merge partitions
# are split, small sides are switched to broadcast by measured size, and the shuffle
# width adapts to the volume.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g"
) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in ADAPTIVE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir` of the session.

    Only a local master may fall back to a temporary folder, because there driver and
    executors are one machine. On a cluster an unset folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir() or path


def checkpointed(df):
    """Cut lineage through the shared checkpoint folder; survives lost executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def growing(df):
    """df as the side of a join that is merged, never sent whole to every task.

    For tables that grow with the input. The planner judges a table by the size of its files, and
    repeated values compress so well that millions of rows can look small enough to send: they
    would be collected on the driver and held by every executor.
    """
    return df.hint("merge")


def materialized(df, purpose: str):
    """Write df once as a table in the shared folder and continue from that table.

    For results that several branches of a plan read: each is computed once, the plan
    stays small, the planner knows the table's size, and a lost executor costs a re-read
    rather than a replay.
    """
    path = scratch(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def released(spark: SparkSession) -> None:
    """Let shuffles go that no plan holds any longer: their files stay until the driver collects garbage."""
    spark.sparkContext._jvm.System.gc()
