"""Session defaults and the few settings the library reads back from it."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BLOCK_ROWS = "seriesloom.block.rows"
DEFAULT_BLOCK_ROWS = 1 << 20
MAX_RANGE_PARTITIONS = 20_000


def build_session(app: str = "seriesloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def block_rows(spark: SparkSession) -> int:
    """Most rows of one series that a single task may be asked to hold in order."""
    return int(spark.conf.get(BLOCK_ROWS, str(DEFAULT_BLOCK_ROWS)))


def _shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session that names none gets one of its own."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder and cut its lineage."""
    _shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for a job's own files, below the cluster's checkpoint folder."""
    return os.path.join(_shared_root(spark), f"{name}-{uuid.uuid4().hex}")
