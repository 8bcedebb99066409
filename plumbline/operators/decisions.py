"""Accept or reject a smaller feature set."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.importance import RANKING_SPLIT, Ranking, ranked_features
from plumbline.operators.metrics import mixed_open_set, per_class_metrics
from plumbline.session import written


def sweep_table(
    scores: DataFrame,
    class_recall: DataFrame,
    baseline_k: int,
    tolerance_macro_f1: float,
    tolerance_class_recall: float,
) -> DataFrame:
    """Every candidate k against the baseline.

    ``scores`` is (k, macro_f1, balanced_accuracy, ...), one row per candidate; ``class_recall``
    is (k, class, recall). A candidate is accepted when its macro F1 drop and its largest
    class recall drop both stay within the tolerances. Candidates at or above the baseline
    are left out.
    """
    # One row per candidate: the baseline's figures are read off with a window.
    everything = Window.partitionBy()
    is_baseline = F.col("k") == baseline_k
    at_baseline = lambda c: F.max(F.when(is_baseline, F.col(c))).over(everything)
    base_recall = class_recall.where(F.col("k") == baseline_k).select(
        "class", F.col("recall").alias("_recall")
    )
    drop = F.col("_recall") - F.col("recall")
    worst = (
        class_recall.where(F.col("k") < baseline_k)
        .join(base_recall, "class")
        .withColumn("_drop", drop)
        .groupBy("k")
        .agg(
            F.max_by("class", F.struct("_drop", -F.col("class"))).alias("worst_class"),
            F.max("_drop").alias("worst_class_recall_drop"),
        )
    )
    accepted = (F.col("delta_macro_f1") <= tolerance_macro_f1) & (
        F.col("worst_class_recall_drop") <= tolerance_class_recall
    )
    return (
        scores.where(F.col("k") <= baseline_k)
        .join(worst, "k", "left")
        .withColumn("is_baseline", is_baseline)
        .withColumn("delta_macro_f1", at_baseline("macro_f1") - F.col("macro_f1"))
        .withColumn(
            "delta_balanced_accuracy",
            at_baseline("balanced_accuracy") - F.col("balanced_accuracy"),
        )
        .withColumn(
            "worst_class_recall_drop", F.coalesce(F.col("worst_class_recall_drop"), F.lit(0.0))
        )
        .withColumn("accepted", is_baseline | accepted)
    )


def choose_k(sweep: DataFrame) -> DataFrame:
    """One row: the smallest accepted k that is not the baseline, or NULL."""
    able = F.col("accepted") & ~F.col("is_baseline")
    return sweep.agg(F.min(F.when(able, F.col("k"))).alias("chosen_k"))


def sweep_ranked(
    rows: DataFrame,
    features: Sequence[str],
    ranking: Ranking,
    candidates: Sequence[int],
    score: Callable[[DataFrame, list[str], list[int]], DataFrame],
    n_classes: int,
    tolerance_macro_f1: float,
    tolerance_class_recall: float,
) -> DataFrame:
    """The sweep over the k best ranked features, for every candidate k below the number of features.

    ``rows`` has ``split`` and ``y_true``; only its validation rows are scored, and open-set rows among them are refused.
    The baseline sees all features. ``score`` gets the rows, the features from the best on and the counts, and
    returns (k, y_true, y_prob) of all of them: one scan for the whole sweep. The ranking has to be one of these
    features, measured on validation.
    """
    order = ranked_features(features, ranking)
    counts = sorted({k for k in candidates if k < len(order)} | {len(order)})
    if counts[0] < 1:
        raise ValueError(f"k={counts[0]} is outside 1..{len(order)}")
    held = rows.where(F.col("split") == RANKING_SPLIT)
    mixed_open_set(held, fail=True)
    # A row per k and class, read three times below; the rows are scored once.
    classes = written(per_class_metrics(score(held, order, counts), n_classes, ["k"]), "sweep-classes")
    scores = classes.groupBy("k").agg(F.avg("f1").alias("macro_f1"), F.avg("recall").alias("balanced_accuracy"))
    recall = classes.select("k", "class", "recall")
    return sweep_table(scores, recall, len(order), tolerance_macro_f1, tolerance_class_recall)
