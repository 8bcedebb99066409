"""Running totals and neighbours over an order, without one task per group.

A window over a whole group puts the group into one task. Here the order is cut into
buckets: windows run inside (group, bucket), one summary row per bucket carries what crosses
the border, and the two are joined on the keys they are already partitioned by.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 65_536
LOG_STEPS = 64
ZERO_BUCKET = 20_000


def score_bucket(score: Column) -> Column:
    """Bucket of a float32 score, growing as the score falls.

    64 buckets per power of two, so no bucket holds more than about 131,000 distinct float32
    values, however the scores are distributed.
    """
    size = F.floor(F.log2(F.abs(score).cast("double")) * LOG_STEPS).cast("int")
    signed = F.when(score > 0, -size).when(score < 0, F.lit(2 * ZERO_BUCKET) + size)
    # Never NULL, also for the optimizer: a join on it then adds no filter to one side, and
    # both sides share one shuffle.
    return F.coalesce(signed, F.lit(ZERO_BUCKET))


def _cuts(frame: DataFrame, column: str, n: int) -> list[float]:
    wide = frame.select(F.col(column).cast("double").alias("_v"))
    return wide.approxQuantile("_v", [i / n for i in range(1, n)], 0.25 / n)


def _bucketed(frame: DataFrame, column: str, cuts: list[float], name: str) -> DataFrame:
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol="_v", outputCol=name, handleInvalid="keep")
    wide = frame.withColumn("_v", F.col(column).cast("double"))
    whole = F.coalesce(F.col(name).cast("int"), F.lit(-1))
    return bucketizer.transform(wide).drop("_v").withColumn(name, whole)


def with_range_bucket(
    frame: DataFrame,
    order: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    name: str = "_bucket",
    tie: str | None = None,
) -> DataFrame:
    """Add a bucket number that grows with ``order``, cut at the quantiles of the whole table.

    Narrow passes (a count and quantile sketches) decide the cuts; they are then literals in
    the plan, so the same row always falls in the same bucket. A value that fills several
    quantiles by itself gets its own bucket, which is cut again along ``tie``, the numeric
    column that orders equal values.
    """
    total = frame.count()
    n = min(MAX_BUCKETS, -(-total // rows_per_bucket))
    if n <= 1:
        return frame.withColumn(name, F.lit(0))
    cuts = _cuts(frame, order, n)
    heavy = sorted({cut for cut, after in zip(cuts, cuts[1:], strict=False) if cut == after})
    if not heavy or tie is None:
        return _bucketed(frame, order, cuts, name)
    alone = [math.nextafter(value, math.inf) for value in heavy]
    is_heavy = F.col(order).cast("double").isin(heavy)
    ties = sorted(set(_cuts(frame.where(is_heavy), tie, n)))
    split = _bucketed(_bucketed(frame, order, [*cuts, *alone], name), tie, ties, "_tie")
    within = F.when(is_heavy, F.col("_tie")).otherwise(F.lit(0))
    return split.withColumn(name, F.col(name) * (len(ties) + 1) + within).drop("_tie")


def with_micros(frame: DataFrame, column: str, name: str = "_micros") -> DataFrame:
    """Add a timestamp as a number, for use as an order."""
    return frame.withColumn(name, F.unix_micros(F.col(column).cast("timestamp")))


def running_totals(
    frame: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[Column],
    sums: dict[str, str],
    totals: bool = True,
) -> DataFrame:
    """Add inclusive running sums, and optionally group totals, along an order.

    ``sums`` maps an input column to the name of its running sum; the total of a group is
    ``<name>_total``. ``bucket`` must grow along the order.
    """
    keys = list(keys)
    inside = (
        Window.partitionBy(*keys, bucket)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = frame.groupBy(*keys, bucket).agg(
        *[F.sum(c).alias(f"_sum_{name}") for c, name in sums.items()]
    )
    columns = [*keys, bucket]
    for name in sums.values():
        columns.append(F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_off_{name}"))
        if totals:
            columns.append(F.sum(f"_sum_{name}").over(Window.partitionBy(*keys)).alias(f"{name}_total"))
    offsets = offsets.select(*columns)
    rows = frame
    for c, name in sums.items():
        rows = rows.withColumn(name, F.sum(c).over(inside))
    rows = rows.join(offsets, [*keys, bucket])
    for name in sums.values():
        rows = rows.withColumn(name, F.col(name) + F.col(f"_off_{name}"))
    return rows.drop(*[f"_off_{name}" for name in sums.values()])


def positions(
    frame: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], name: str
) -> DataFrame:
    """Add the 1-based position of every row in its group, and the group size ``<name>_total``."""
    one = frame.withColumn("_one", F.lit(1).cast("bigint"))
    return running_totals(one, keys, bucket, order, {"_one": name}).drop("_one")


def with_previous(
    frame: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Add ``prev_<value>``: the value of the row before, NULL for the first row of a group.

    ``order`` columns together must differ between any two rows of a group.
    """
    keys = list(keys)
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    row = F.struct(*values)
    edges = frame.groupBy(*keys, bucket).agg(F.max_by(row, F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy(bucket)
    edges = edges.select(*keys, bucket, F.lag("_last").over(across).alias("_edge"))
    linked = frame.withColumn("_prev", F.lag(row).over(inside)).join(edges, [*keys, bucket])
    previous = F.coalesce(F.col("_prev"), F.col("_edge"))
    return linked.select(
        *frame.columns, *[previous[v].alias(f"prev_{v}") for v in values]
    )
