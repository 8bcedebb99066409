"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR_KEY = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and for bench.py. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plumbline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only in local mode may that be unset, as in
    tests: a temporary folder is made then and remembered for the life of the session.
    """
    named = spark.conf.get(CHECKPOINT_DIR_KEY, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_DIR_KEY, None
    )
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError(f"Set {CHECKPOINT_DIR_KEY} to a folder that all executors reach")
    return _LOCAL.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="plumbline-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below :func:`shared_dir` that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The rows of a frame as a table of the shared folder, evaluated once."""
    path = fresh_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
