"""Session helpers shared by tests, the bench and jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quillspark") -> SparkSession:
    """A local session with the settings the engine expects: UTC, AQE on, few shuffle partitions."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUILL_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """Read one driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share, set as the checkpoint folder.

    A session that names none gets a temporary folder if it runs in this one process, as in tests. On a cluster
    executors would not see such a folder, so there the setting is required.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="quillspark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder and read from there: a reliable checkpoint, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of one use's own in the shared folder; whoever asks for it removes it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
