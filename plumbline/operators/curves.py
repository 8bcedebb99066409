"""ROC and precision-recall statistics from counts per distinct score.

Rows are first combined to (class, score) -> positives, negatives. The order over scores is
then walked in buckets (see ``ordered``), so a class never sits in one task. The micro
average is class -1, built from the same counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.ordered import (
    positions,
    running_totals,
    score_bucket,
    with_range_bucket,
)

MICRO = -1
MAX_CURVE_POINTS = 5_000
MACRO_GRID = 2_000  # the grid has one point more than it has steps


def score_counts(scored: DataFrame, by: Sequence[str] = (), micro: bool = True) -> DataFrame:
    """(by, class, score, pos, neg, _bucket) per distinct float32 score."""
    # The outer form keeps the optimizer from copying the whole score expression into a
    # filter below the scoring step; empty vectors are dropped right after.
    exploded = scored.select(
        *by, "y_true", F.posexplode_outer("y_prob").alias("class", "score")
    ).where(F.col("class").isNotNull())
    hit = F.col("y_true") == F.col("class")
    counted = (
        exploded.withColumn("score", F.col("score").cast("float"))
        .groupBy(*by, "class", "score")
        .agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    )
    if micro:
        both = F.array(F.col("class"), F.lit(MICRO))
        counted = (
            counted.withColumn("class", F.explode(both))
            .groupBy(*by, "class", "score")
            .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        )
    return counted.withColumn("_bucket", score_bucket(F.col("score")))


def _double(column: str) -> Column:
    return F.col(column).cast("double")


def roc_auc_ovr(scored: DataFrame, by: Sequence[str] = (), micro: bool = True) -> DataFrame:
    """(by, class, positives, negatives, roc_auc); NULL when a class has no rows or all rows.

    The area is a sum over buckets: pairs inside a bucket, plus the bucket's negatives times
    the positives ranked above it. Only bucket totals cross tasks; no join is needed.
    """
    keys = [*by, "class"]
    inside = Window.partitionBy(*keys, "_bucket").orderBy(F.desc("score"))
    above = F.sum("pos").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    buckets = (
        score_counts(scored, by, micro)
        .withColumn("_won", _double("neg") * (above - F.col("pos") / 2))
        .groupBy(*keys, "_bucket")
        .agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), F.sum("_won").alias("_won"))
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    area = F.sum(F.col("_won") + _double("_n") * _double("_before"))
    positives, negatives = F.sum("_p"), F.sum("_n")
    defined = (positives > 0) & (negatives > 0)
    return (
        buckets.withColumn("_before", F.coalesce(F.sum("_p").over(before), F.lit(0)))
        .groupBy(*keys)
        .agg(
            positives.alias("positives"),
            negatives.alias("negatives"),
            F.when(defined, area / (positives.cast("double") * negatives.cast("double"))).alias(
                "roc_auc"
            ),
        )
    )


def ranked_counts(scored: DataFrame, by: Sequence[str] = (), micro: bool = True) -> DataFrame:
    """Score counts with inclusive running counts tp, fp and the group totals, scores falling.

    Also (next_pos, next_neg) of the following lower score, NULL at the end of a curve.
    """
    keys = [*by, "class"]
    counts = score_counts(scored, by, micro)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(F.desc("score"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.struct("pos", "neg")
    rows = counts.select(
        "*",
        F.sum("pos").over(upto).alias("_tp"),
        F.sum("neg").over(upto).alias("_fp"),
        F.lead(step).over(inside).alias("_next"),
    )
    order = Window.partitionBy(*keys).orderBy("_bucket")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    borders = (
        counts.groupBy(*keys, "_bucket")
        .agg(
            F.sum("pos").alias("_p"),
            F.sum("neg").alias("_n"),
            F.max_by(step, "score").alias("_first"),
        )
        .select(
            *keys,
            "_bucket",
            F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_p_before"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"),
            F.sum("_p").over(whole).alias("positives"),
            F.sum("_n").over(whole).alias("negatives"),
            F.lead("_first").over(order).alias("_first_after"),
        )
    )
    following = F.coalesce(F.col("_next"), F.col("_first_after"))
    return rows.join(borders, [*keys, "_bucket"]).select(
        *keys,
        "score",
        "pos",
        "neg",
        (F.col("_tp") + F.col("_p_before")).alias("tp"),
        (F.col("_fp") + F.col("_n_before")).alias("fp"),
        "positives",
        "negatives",
        following["pos"].alias("next_pos"),
        following["neg"].alias("next_neg"),
        "_bucket",
    )


def average_precision_ovr(
    scored: DataFrame, by: Sequence[str] = (), micro: bool = True
) -> DataFrame:
    """(by, class, positives, negatives, average_precision): the step sum, no interpolation."""
    keys = [*by, "class"]
    precision = _double("tp") / (F.col("tp") + F.col("fp"))
    defined = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return (
        ranked_counts(scored, by, micro)
        .groupBy(*keys)
        .agg(
            F.max("positives").alias("positives"),
            F.max("negatives").alias("negatives"),
            F.sum(_double("pos") * precision).alias("_sum"),
        )
        .select(
            *keys,
            "positives",
            "negatives",
            F.when(defined, F.col("_sum") / F.col("positives")).alias("average_precision"),
        )
    )


def class_areas(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC area and average precision of every class and of the micro average, in one walk."""
    keys = [*by, "class"]
    precision = _double("tp") / (F.col("tp") + F.col("fp"))
    positives, negatives = F.max("positives"), F.max("negatives")
    defined = (positives > 0) & (negatives > 0)
    won = F.sum(_double("neg") * (F.col("tp") - F.col("pos") / 2))
    return (
        ranked_counts(scored, by)
        .groupBy(*keys)
        .agg(
            positives.alias("positives"),
            negatives.alias("negatives"),
            F.when(defined, won / (positives.cast("double") * negatives.cast("double"))).alias(
                "roc_auc"
            ),
            F.when(defined, F.sum(_double("pos") * precision) / positives).alias(
                "average_precision"
            ),
        )
    )


def auc_summary(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro, support-weighted and micro ROC area and average precision."""
    areas = class_areas(scored, by)
    single = F.col("class") != MICRO
    columns = []
    for name, short in (("roc_auc", "roc"), ("average_precision", "pr")):
        weight = F.when(single & F.col(name).isNotNull(), F.col("positives"))
        columns += [
            F.avg(F.when(single, F.col(name))).alias(f"{short}_macro"),
            (F.sum(F.when(single, F.col(name) * F.col("positives"))) / F.sum(weight)).alias(
                f"{short}_weighted"
            ),
            F.max(F.when(~single, F.col(name))).alias(f"{short}_micro"),
        ]
    return areas.groupBy(*by).agg(*columns)


def _drawable(ranked: DataFrame) -> DataFrame:
    return ranked.where((F.col("positives") > 0) & (F.col("negatives") > 0))


def roc_curve(scored: DataFrame, by: Sequence[str] = (), micro: bool = True) -> DataFrame:
    """(by, class, fpr, tpr, threshold). Points between two equal steps are left out.

    Each curve starts at (0, 0) with threshold infinity. A class with only positives or only
    negatives has no curve.
    """
    keys = [*by, "class"]
    ranked = _drawable(ranked_counts(scored, by, micro))
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    last = F.col("next_pos").isNull()
    turns = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    point = F.struct(
        (_double("fp") / F.col("negatives")).alias("fpr"),
        (_double("tp") / F.col("positives")).alias("tpr"),
        _double("score").alias("threshold"),
    )
    origin = F.struct(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold")
    )
    points = F.when(first, F.array(origin, point)).otherwise(F.array(point))
    return ranked.where(first | last | turns).select(*keys, F.inline(points))


def roc_macro_curve(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean TPR of all classes on an even FPR grid, linear between the points of a curve.

    Every score emits the grid points its own step covers, found by integer arithmetic, so no
    range join is needed.
    """
    ranked = _drawable(ranked_counts(scored, by, micro=False))
    # ceil(2000 * FP / N) in integers, before and after the step of this score.
    low = F.expr(f"((fp - neg) * {MACRO_GRID}L + negatives - 1) DIV negatives").cast("int")
    high = F.expr(f"(fp * {MACRO_GRID}L + negatives - 1) DIV negatives").cast("int") - 1
    on_grid = (
        ranked.withColumn("_low", low)
        .withColumn("_high", high)
        .where(F.col("_high") >= F.col("_low"))
        .select("*", F.explode(F.sequence("_low", "_high")).alias("point"))
    )
    reached = _double("point") * F.col("negatives") / MACRO_GRID
    into = (reached - (F.col("fp") - F.col("neg"))) / F.col("neg")
    tpr = (F.col("tp") - F.col("pos") + into * F.col("pos")) / F.col("positives")
    inner = on_grid.select(*by, "point", tpr.alias("tpr"))
    closing = ranked.where(F.col("next_pos").isNull()).select(
        *by, F.lit(MACRO_GRID).alias("point"), F.lit(1.0).alias("tpr")
    )
    return (
        inner.unionByName(closing)
        .groupBy(*by, "point")
        .agg(F.avg("tpr").alias("tpr"), F.count("*").alias("classes"))
        .select(*by, (_double("point") / MACRO_GRID).alias("fpr"), "tpr", "classes")
    )


def pr_curve(scored: DataFrame, by: Sequence[str] = (), micro: bool = True) -> DataFrame:
    """(by, class, recall, precision, threshold), closed by (0, 1) without a threshold.

    A class without positives has no curve.
    """
    keys = [*by, "class"]
    ranked = ranked_counts(scored, by, micro).where(F.col("positives") > 0)
    point = F.struct(
        (_double("tp") / F.col("positives")).alias("recall"),
        (_double("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        _double("score").alias("threshold"),
    )
    closing = F.struct(
        F.lit(0.0).alias("recall"),
        F.lit(1.0).alias("precision"),
        F.lit(None).cast("double").alias("threshold"),
    )
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    points = F.when(first, F.array(closing, point)).otherwise(F.array(point))
    return ranked.select(*keys, F.inline(points))


def thin_curve(
    curve: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: str,
    maximum: int = MAX_CURVE_POINTS,
) -> DataFrame:
    """Evenly spaced points of each curve, at most ``maximum`` of them, both ends kept.

    Point i of the thinned curve is point floor(i * (n - 1) / (maximum - 1)) of the curve.
    """
    numbered = positions(curve, keys, bucket, order, "_at")
    n = F.col("_at_total")
    span, at = F.lit(maximum - 1).cast("bigint"), F.col("_at") - 1
    # at is kept when some i has i*(n-1) div span = at, that is when the smallest i with
    # i*(n-1) >= at*span also satisfies i*(n-1) < (at+1)*span.
    smallest = F.expr(
        f"((_at - 1) * {maximum - 1}L + (_at_total - 2)) DIV greatest(_at_total - 1, 1L)"
    )
    kept = (n <= maximum) | (smallest * (n - 1) < (at + 1) * span)
    return numbered.where(kept).drop("_at", "_at_total")


def percentiles(
    frame: DataFrame,
    value: str,
    fractions: dict[str, float],
    by: Sequence[str] = (),
    rows_per_bucket: int = 1_000_000,
) -> DataFrame:
    """Exact percentiles, linear between ranks, from counts per distinct value.

    The value's place in the order is found in range buckets, so no group is sorted in one
    task and no task holds all distinct values.
    """
    by = list(by)
    counts = (
        frame.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count("*").alias("_n"))
    )
    bucketed = with_range_bucket(counts, value, rows_per_bucket)
    keys = by or ["_all"]
    if not by:
        bucketed = bucketed.withColumn("_all", F.lit(0))
    walked = running_totals(bucketed, keys, "_bucket", [F.asc(value)], {"_n": "_upto"})
    columns = []
    for name, q in fractions.items():
        rank = (F.col("_upto_total") - 1) * F.lit(float(q))
        low, high = F.floor(rank), F.ceil(rank)
        holds = lambda r: (F.col("_upto") > r) & (F.col("_upto") - F.col("_n") <= r)
        at_low = F.max(F.when(holds(low), F.col(value)))
        at_high = F.max(F.when(holds(high), F.col(value)))
        part = F.max(rank - low)
        columns.append((at_low + (at_high - at_low) * part).alias(name))
    return walked.groupBy(*keys).agg(*columns, F.max("_upto_total").alias("rows")).select(
        *by, *fractions, "rows"
    )
