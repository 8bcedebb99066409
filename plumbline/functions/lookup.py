"""Small tables: broadcast only after their size has been seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import fresh_path

LOOKUP_ROWS = 100_000
#: Up to how many bytes of Parquet a table is sent to every executor.
SMALL_BYTES = 16 << 20


def small_side(table: DataFrame, name: str = "side") -> DataFrame:
    """A table evaluated once into the shared folder, marked for broadcast if its files are small.

    Nothing of it passes through the driver. A larger one comes back unmarked and is joined by a shuffle.
    """
    spark, path = table.sparkSession, fresh_path(table.sparkSession, name)
    table.write.parquet(path)
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = spark.read.schema(table.schema).parquet(path)
    return F.broadcast(found) if system.getContentSummary(location).getLength() <= SMALL_BYTES else found


def bounded_lookup(table: DataFrame, max_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Evaluate a small table once and mark it for broadcast.

    At most ``max_rows + 1`` rows reach the driver. A table with more rows comes back as
    it was, so the join that uses it shuffles instead and adaptive execution splits hot keys.
    """
    rows = table.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return table
    return F.broadcast(table.sparkSession.createDataFrame(rows, schema=table.schema))


def bounded_rows(table: DataFrame, max_rows: int = LOOKUP_ROWS) -> list:
    """Rows of a table whose size is bounded by its meaning (classes, splits, files)."""
    rows = table.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"Expected at most {max_rows} rows")
    return rows
