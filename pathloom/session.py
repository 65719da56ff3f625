"""Local session for tests and the bench, and the shared folder for written intermediates."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

_FALLBACK: dict[str, str] = {}


def local_session(cpus: str | int = "*", partitions: int | None = None, app: str = "pathloom") -> SparkSession:
    """Session for one machine; on a cluster use the session the cluster gives."""
    n = os.cpu_count() or 8 if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # call-site capture costs a few round trips to the JVM per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own, in its warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        _FALLBACK[app] = f"{warehouse}/staged_{uuid.uuid4().hex[:12]}"
    return _FALLBACK[app]
