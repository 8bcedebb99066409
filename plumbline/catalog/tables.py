"""The frames the queries start from, and the same frames as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import WHITESPACE
from plumbline.operators.labels import LabelPolicy
from plumbline.operators.splits import TEST_ROLE, TRAIN_ROLE
from plumbline.sources.scan import with_row_identity

SEED = 2026
RATIOS = (0.7, 0.15, 0.15)
DIGITS = 6

POLICY = LabelPolicy(
    merge_map={" r-o ": "N-O"}, keep_only=["A-F", "A-O", "N-O"], open_set_labels=["R-F"]
)
DAY_ROLES = {
    **{str(year): TRAIN_ROLE for year in range(1995, 2000)},
    "2000": TEST_ROLE,
}
VALIDATION_FRACTION = 0.15


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, identity: bool = True) -> DataFrame:
    """lineitem with row identity, a label of six values and the shipping year as the day."""
    frame = read(spark, sf_dir, "lineitem")
    if identity:
        frame = with_row_identity(frame, sf_dir)
    return frame.withColumn("label", F.concat_ws("-", "l_returnflag", "l_linestatus")).withColumn(
        "day", F.year("l_shipdate").cast("string")
    )


def rounded(frame: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles so that the order of a sum cannot show; -0.0 becomes 0.0."""
    return frame.select(
        *[
            (F.round(f.name, digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in frame.schema.fields
        ]
    )


# ---- SQL pieces ------------------------------------------------------------------------------------

SPACE = "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"
# Fixed value: the 64-bit id of the path 'lineitem.parquet' (XXH64 with seed 42).
FILE_ID = "(-8205281460649421068)::BIGINT"
ROW = f"{FILE_ID} || '|' || rid"


def r(expression: str, digits: int = DIGITS) -> str:
    return f"(round({expression}, {digits}) + 0.0)"


def unit(key: str, seed: int | str = SEED) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT / 4294967296.0)"


def split_case(key: str, seed: int = SEED, ratios: tuple = RATIOS) -> str:
    u = unit(key, seed)
    return (
        f"CASE WHEN {u} < {ratios[0]!r} THEN 'train' "
        f"WHEN {u} < {ratios[0] + ratios[1]!r} THEN 'validation' ELSE 'test' END"
    )


def text_key(*columns: str) -> str:
    """Injective text of key parts."""
    parts = [f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns]
    return "(" + " || '|' || ".join(parts) + ")"


GROUP = text_key("l_orderkey")

LINES = """lines AS (
  SELECT *, row_number() OVER () - 1 AS rid, l_returnflag || '-' || l_linestatus AS label,
         year(l_shipdate)::VARCHAR AS day
  FROM lineitem)"""

CLASSIFIED = f"""{LINES},
merged AS (SELECT * REPLACE (CASE WHEN lower(label) = 'r-o' THEN 'N-O' ELSE label END AS label) FROM lines),
classified AS (
  SELECT *, label IN ('A-F', 'A-O', 'N-O', 'R-F') AS keep, label = 'R-F' AS open_set FROM merged)"""

GROUP_SPLIT = split_case(GROUP)
ROW_SPLIT = split_case(ROW)
DAY_SPLIT = (
    f"CASE WHEN day = '2000' THEN 'test' WHEN day BETWEEN '1995' AND '1999' THEN "
    f"CASE WHEN {unit(GROUP)} < {1.0 - VALIDATION_FRACTION!r} THEN 'train' ELSE 'validation' END END"
)


def assigned_sql(split: str = GROUP_SPLIT) -> str:
    """CTEs up to ``assigned``: policy flags, then the split, open-set rows in test."""
    return f"""{CLASSIFIED},
assigned AS (
  SELECT *, CASE WHEN NOT keep THEN NULL WHEN open_set THEN 'test' ELSE {split} END AS split
  FROM classified)"""


ASSIGNED_DEFAULT = assigned_sql()
