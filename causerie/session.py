"""Session helper for scripts and tests."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str | None = None, app: str = "causerie", memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A local session with shared, or else a folder of its own, as its shared folder. On a cluster use the session that the cluster gives."""
    if shared is None:
        shared = tempfile.mkdtemp(prefix="causerie-shared-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.dir", f"file://{os.path.abspath(shared)}")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
