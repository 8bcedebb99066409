"""Tables that are written once and read again, and Arrow stages over the texts of a table."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import fresh_path

#: A word of the contracts: a run of characters outside space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whether Spark removes a query's shuffle files as the query ends, not when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files. None may read what another one shuffled."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The rows of a frame, written to the shared folder and read back: later stages start there."""
    spark = frame.sparkSession
    path = fresh_path(spark, name)
    with shuffles_go(spark):
        frame.write.parquet(path)
    found = spark.read.schema(frame.schema).parquet(path)
    found.stored_path = path
    return found


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that :func:`stored` made, once all that was read from them is written elsewhere."""
    for frame in frames:
        path = getattr(frame, "stored_path", None)
        if path is not None:
            spark = frame.sparkSession
            location = spark._jvm.org.apache.hadoop.fs.Path(path)
            location.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(location, True)


#: Up to how many bytes of Parquet a table is sent to every executor.
SMALL_BYTES = 16 << 20


def small_side(frame: DataFrame) -> DataFrame:
    """The frame as a written table, marked for broadcast if its files are small.

    A larger one comes back unmarked and is joined by a shuffle.
    """
    found, small = sized(frame)
    if not small:
        return found
    marked = F.broadcast(found)
    marked.stored_path = found.stored_path
    return marked


def sized(frame: DataFrame) -> tuple[DataFrame, bool]:
    """The frame as a written table, and whether its files are small enough to send to every executor."""
    spark = frame.sparkSession
    found = stored(frame, "side")
    location = spark._jvm.org.apache.hadoop.fs.Path(found.stored_path)
    system = location.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return found, system.getContentSummary(location).getLength() <= SMALL_BYTES


def row_bits(rows: DataFrame, number: str) -> DataFrame:
    """word, bits: the numbers of ``rows``, 64 neighbours in a row, as a side for :func:`with_bits`.

    Numbers of rows follow each other within a partition, so a table of them is hundreds of times smaller than
    its rows and is sent to every executor where a list of numbers would make the rows move.
    """
    bit = F.expr(f"shiftleft(1L, cast({number} & 63 as int))")
    return small_side(rows.groupBy(F.shiftright(number, 6).alias("__word")).agg(F.bit_or(bit).alias("__bits")))


def with_bits(frame: DataFrame, number: str, bits: DataFrame) -> DataFrame:
    """The rows of ``frame`` whose number is in ``bits``."""
    there = F.expr(f"(shiftright(__bits, cast({number} & 63 as int)) & 1) = 1")
    joined = frame.join(bits, F.shiftright(number, 6) == F.col("__word"))
    return joined.where(there).drop("__word", "__bits")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo 5, is 0. A null id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """The rows of ``docs`` that may be learnt from, with their 0/1 label as ``label``.

    Held-out rows, null ids and null labels stay out. An id that several label rows disagree on takes
    the larger label.
    """
    known = known_labels(labels, column)
    return docs.where(~held_out()).join(known, F.col("doc_id") == F.col("labelled_id")).drop("labelled_id")


def known_labels(labels: DataFrame, column: str) -> DataFrame:
    """labelled_id, label: one row for each id with a 0/1 label."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
        .groupBy(F.col("doc_id").alias("labelled_id"))
        .agg(F.max(column).cast("int").alias("label"))
    )


def map_batches(
    frame: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """``function`` over every Arrow batch of a frame, within its partitions and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)
        # Workers are used again; what stays in Arrow's pool counts against stages that come later.
        pa.default_memory_pool().release_unused()

    return frame.mapInArrow(run, schema)
