"""Session construction and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cores: int | str = "*",
    *,
    shuffle_partitions: int = 8,
    app: str = "clausemill",
    checkpoint_dir: str | None = None,
) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("CLAUSEMILL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is used only where that setting is absent *and* the
    driver is the only executor (master ``local`` or ``local[n]``), because
    executors on other hosts, or of a local cluster, could not read it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="clausemill-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def saved(frame: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``frame``, written once below the shared folder and read back.

    Whatever reads the result plans and runs over files, not over the steps
    before them; a lost executor costs no more than its own tasks.  The files
    are left to the owner of the folder.
    """
    path = work_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
