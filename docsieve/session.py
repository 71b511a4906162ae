"""Session helpers for tests, benches and local runs (a cluster brings its own session)."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", app: str = "docsieve", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        # lines are small groups: keep hash aggregation for more of them before sorting
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site capture per expression
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers (a cluster has no copy of it).

    The archive is a file of the driver; Spark copies it to every executor.
    """
    context = spark.sparkContext
    if getattr(context, "_docsieve_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="docsieve-"), "docsieve"), "zip", root, "docsieve"))
    context._docsieve_shipped = True


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not getattr(context, "_docsieve_scratch", None):
            context._docsieve_scratch = "file:" + tempfile.mkdtemp(prefix="docsieve-")
        base = context._docsieve_scratch
    return f"{base.rstrip('/')}/docsieve/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings, as it was afterwards."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


#: While a table of the shared folder is written: shuffle files behind it are of no further use and go with the write.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def write_table(df: DataFrame, folder: str, **options: str) -> None:
    """Write Parquet files (zstd unless ``options`` say otherwise) to a shared folder; shuffle files behind them are removed."""
    spark = df.sparkSession
    with settings(spark, WRITING):
        df.write.options(**{"compression": "zstd"} | options).parquet(folder)
