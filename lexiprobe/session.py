"""Session helper for local runs, tests and the bench; clusters bring their own session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with AQE, UTC and Arrow, sized to ``cpus`` threads."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName("lexiprobe")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all machines share: spark.checkpoint.dir; a temporary one, removed at the end, only where it is unset and Spark runs on this machine alone."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="lexiprobe-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        place = f"file://{folder}"
    return f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex}"
