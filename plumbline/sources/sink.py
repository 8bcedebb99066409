"""Writing prepared splits and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.checks import guard
from plumbline.operators.splits import SPLITS, drop_unassigned
from plumbline.sources.scan import relative_path

ROWS_PER_PART = 262_144


def write_splits(
    prepared: DataFrame,
    path: str,
    rows_per_part: int = ROWS_PER_PART,
    compression: str = "zstd",
    mode: str = "error",
) -> DataFrame:
    """Write ``split=<name>/`` folders of Parquet parts and return what was read back.

    Each task writes its own rows, so nothing shuffles. A part holds at most
    ``rows_per_part`` rows.
    """
    if rows_per_part <= 0:
        raise ValueError("rows_per_part must be positive")
    (
        drop_unassigned(prepared)
        .drop("in_scope")
        .write.mode(mode)
        .partitionBy("split")
        .option("maxRecordsPerFile", rows_per_part)
        .option("compression", compression)
        .parquet(path)
    )
    return prepared.sparkSession.read.parquet(path)


def check_written(written: DataFrame, expected: DataFrame, fail: bool = True) -> DataFrame:
    """Splits whose row count on disk differs from the expected (split, rows)."""
    return check_counts(written.groupBy("split").agg(F.count("*").alias("rows")), expected, fail)


def check_counts(found: DataFrame, expected: DataFrame, fail: bool = True) -> DataFrame:
    """As :func:`check_written`, for rows counted before."""
    bad = (
        expected.join(found.withColumnRenamed("rows", "rows_found"), "split", "full_outer")
        .na.fill(0, subset=["rows", "rows_found"])
        .where(F.col("rows") != F.col("rows_found"))
    )
    return guard(bad, fail, "Written rows differ from the plan")


def part_inventory(written: DataFrame, root: str) -> DataFrame:
    """(split, path, rows, bytes) of the parts of a written dataset."""
    return (
        written.groupBy(
            "split",
            relative_path(F.col("_metadata.file_path"), root, encoded=True).alias("path"),
            F.col("_metadata.file_size").alias("bytes"),
        )
        .agg(F.count("*").alias("rows"))
        .select("split", "path", "rows", "bytes")
    )


def read_split(
    spark: SparkSession,
    path: str,
    split: str,
    columns: Sequence[str],
    expected_rows: int | None = None,
) -> DataFrame:
    """One split with its columns in the declared order; other split folders are not opened."""
    if split not in SPLITS:
        raise ValueError(f"Unknown split {split!r}")
    frame = spark.read.parquet(path).where(F.col("split") == split).select(*columns)
    if expected_rows is not None:
        found = frame.count()
        if found != expected_rows:
            raise ValueError(f"Split {split!r} has {found} rows, its record says {expected_rows}")
    return frame


def fixed_digits(table: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns as text with a fixed number of digits; NULL stays NULL."""
    columns = []
    for field in table.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            text = F.format_string(f"%.{digits}f", column)
            column = F.when(column.isNotNull() & ~F.isnan(column), text)
        columns.append(column.alias(field.name))
    return table.select(*columns)


def export_table(table: DataFrame, path: str, kind: str = "csv", digits: int = 6) -> str:
    """Write a result table as CSV with fixed digits, or as JSON lines with full precision."""
    if kind == "csv":
        fixed_digits(table, digits).write.mode("overwrite").option("header", "true").csv(path)
    elif kind == "json":
        table.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    else:
        raise ValueError(f"Unknown export kind {kind!r}")
    return path
