"""Session settings that suit this library; a cluster's own settings win."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("busward")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_WRITTEN: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Without that setting a local master, whose tasks see the driver's disk, gets a temporary folder; on a
    cluster this is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="busward-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write a reduced table (windows, scores, decisions) that several steps read, and read it back.

    This cuts the lineage, keeps column pruning and survives lost executors. Within one application
    the same table of the same source is written once.
    """
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _WRITTEN:
        path = f"{shared_folder(spark).rstrip('/')}/busward-{uuid.uuid4().hex}/{name}"
        build().write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def forget_staged() -> None:
    """Let the next use write its tables anew, for changed sources or for timing."""
    _WRITTEN.clear()
