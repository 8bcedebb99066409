"""The queries against their SQL, and the stages against what they promise."""

import time
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import queries
from plumbline.llm.frames import map_batches, row_bits, stored, with_bits
from plumbline.session import shared_dir
from tests.llm.fixtures import WORD, frame, odd_rows, prose
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_queries_agree_with_their_sql(spark, name):
    connection: duckdb.DuckDBPyConnection = connect(SF)
    assert compare(queries.queries()[name](spark, SF), connection, queries.oracles()[name]) is None


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
    assert kept["quality"].count() < spark.read.parquet(f"{SF}/documents.parquet").count()
    lines = [x for r in kept["lines"].collect() for x in (r["text"] or "").lower().split("\n") if x.strip()]
    assert len(lines) == len(set(lines))
    ids = [r["doc_id"] for r in kept["near_copies"].collect()]
    assert len(ids) == len(set(ids))
    words = lambda df: sum(len(WORD.findall(r["text"] or "")) for r in df.collect())
    assert abs(words(kept["mixing"]) - words(kept["near_copies"])) <= 0.1 * words(kept["near_copies"])
    sums = kept["packing"].groupBy("doc_id").sum("length").collect()
    assert {r["doc_id"] for r in sums} == {r["doc_id"] for r in kept["mixing"].collect()}


def test_stages_take_odd_rows_and_extra_columns(spark, folder):
    rows = odd_rows() + [(i, prose(i, 60), "x", "s", 1) for i in range(40)]
    for table in (frame(spark, rows), frame(spark, [])):
        docs = table.selectExpr("*", "1 AS row", "'x' AS node", "2L AS score", "3 AS size", "4 AS `key`").coalesce(1)
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, SF), name)
            if name != "packing":
                assert out.columns == docs.columns
                docs = out


def test_stages_hand_texts_to_python_in_batches_of_bounded_bytes(spark):
    wide = spark.range(400, numPartitions=1).select(F.repeat(F.lit("words "), 16_000).alias("text"))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        corpus_pipeline.STAGES[-1][1](spark, frame(spark, odd_rows()), SF)
        sizes = map_batches(wide, lambda b: pa.record_batch([pa.array([b.nbytes])], names=["n"]), "n long").collect()
    finally:
        spark.conf.set(key, before)
    assert sum(r["n"] for r in sizes) >= 400 * 96_000
    assert max(r["n"] for r in sizes) <= 4 << 20


def _shuffled(spark):
    """The shuffle files that are there now, Spark's cleaner being given time to remove some."""
    time.sleep(1)
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in folders for f in Path(d.getPath()).rglob("shuffle_*.data")}


def test_written_tables_leave_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, held = spark.conf.get(key, None), _shuffled(spark)
    found = stored(spark.range(10_000).groupBy((F.col("id") % 99).alias("k")).count().repartition(3, "k"), "counts")
    assert not _shuffled(spark) - held
    assert found.count() == 99 and spark.conf.get(key, None) == before


def test_lines_and_near_copies_leave_only_the_tables_they_are_read_from(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    top = Path(shared_dir(spark).removeprefix("file:"))
    for stage in (corpus_pipeline.drop_repeated_lines, corpus_pipeline.drop_near_copies):
        before = set(top.iterdir())
        out = stage(spark, docs, SF)
        assert {p.name.rpartition("-")[0] for p in set(top.iterdir()) - before} == {"side"}
        assert 0 < out.count() <= docs.count()


def test_bits_pick_rows_by_number(spark):
    numbers = [0, 1, 63, 64, 127, 5000, (3 << 33) + 62, (3 << 33) + 63]
    rows = spark.createDataFrame([(n,) for n in numbers], "number long")
    for wanted in ([], [0], [63, 64, (3 << 33) + 63], numbers):
        bits = row_bits(spark.createDataFrame([(n,) for n in wanted], "kept long"), "kept")
        assert sorted(r["number"] for r in with_bits(rows, "number", bits).collect()) == wanted
