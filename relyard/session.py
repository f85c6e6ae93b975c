"""Session settings for tests and the benchmark, and the shared folder of a cluster."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str, cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named in ``spark.checkpoint.dir``.

    A single-process session without that setting, as in tests, gets its own folder; any cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="relyard-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def new_location(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, so that a run never overwrites another one's tables."""
    return f"{shared_root(spark).rstrip('/')}/relyard/{name}-{uuid.uuid4().hex}"
