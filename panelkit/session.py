"""Session defaults and shared storage used by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS_KEY = "spark.panelkit.salts"
# Rows that a range of ordered rows is meant to hold; the default is in operators/order.py.
RANGE_ROWS_KEY = "spark.panelkit.rangeRows"

SALTS_DEFAULT = 16


def build_session(app: str = "panelkit", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and skew handling on; keyword conf uses `__` for `.`."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def salt_count(spark: SparkSession) -> int:
    return conf_int(spark, SALTS_KEY, SALTS_DEFAULT)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; a private temp folder only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="panelkit-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for files one job writes and rereads."""
    return f"{checkpoint_dir(spark)}/panelkit-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write the frame to reliable storage so that later branches read one fixed version."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_row(df: DataFrame, row: DataFrame, name: str) -> DataFrame:
    """Add a one-row frame as a struct column, computed once and read as often as needed."""
    return df.withColumn(name, row.select(F.struct(*row.columns)).scalar())


def names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)
