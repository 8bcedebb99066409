"""All evaluation tables of one scored table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.lookup import bounded_lookup
from plumbline.operators import curves, metrics
from plumbline.session import written
from plumbline.sources.sink import export_table


def summary_metrics(scored: DataFrame, n_classes: int) -> DataFrame:
    """One wide row, the two headline figures first.

    Two passes over the scores: counts of hard decisions, and the ranked walk behind the areas.
    Every part is one row of figures; the parts are stacked as (name, value) and folded into
    one row, so nothing is joined.
    """
    counted = bounded_lookup(metrics.prediction_counts(scored))
    per_class = metrics.per_class_of(counted, n_classes)
    parts = [
        metrics.macro_scores(per_class),
        metrics.balanced_accuracy(per_class),
        metrics.mcc(per_class),
        metrics.weighted_f1(per_class),
        per_class.agg(
            (F.sum("hits") / F.sum("support")).alias("accuracy"),
            F.sum("support").alias("test_samples"),
        ),
        metrics.minority_class(per_class),
        counted.agg((F.sum("loss") / F.sum("rows")).alias("log_loss")),
        curves.auc_summary(scored),
    ]
    integral = ("minority_class", "minority_support", "test_samples")
    names = [name for part in parts for name in part.columns]
    stacked = reduce(DataFrame.unionByName, [_stacked(part) for part in parts])
    value = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    row = stacked.agg(
        *[value(n).cast("bigint" if n in integral else "double").alias(n) for n in names]
    )
    return row.select(
        "macro_f1",
        "balanced_accuracy",
        "macro_precision",
        "macro_recall",
        "mcc",
        "weighted_f1",
        "accuracy",
        "minority_class",
        "minority_support",
        "minority_f1",
        "log_loss",
        F.col("roc_macro").alias("auc_roc_macro_ovr"),
        F.col("roc_weighted").alias("auc_roc_weighted_ovr"),
        F.col("roc_micro").alias("auc_roc_micro"),
        F.col("pr_macro").alias("pr_auc_macro"),
        F.col("pr_weighted").alias("pr_auc_weighted"),
        F.col("pr_micro").alias("pr_auc_micro"),
        "test_samples",
    )


def _stacked(part: DataFrame) -> DataFrame:
    cells = [
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
        for c in part.columns
    ]
    return part.select(F.inline(F.array(*cells)))


def report_tables(
    scored: DataFrame,
    n_classes: int,
    names: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Every table of the final report. ``names`` is (class, name).

    Only y_true and y_prob of ``scored`` are read. A table of withheld classes gets the open-set tables; a mixed one
    is refused. Curves are of all rows:
    thin them afterwards with :func:`plumbline.operators.curves.thin_curve`.
    """
    # The rows are scored once; every table reads what was written.
    scored = written(scored.select("y_true", "y_prob"), "report-scores")
    metrics.mixed_open_set(scored, fail=True)
    if scored.where(F.col("y_true") < 0).limit(1).count():
        spread = metrics.open_set_distribution(scored, n_classes)
        return {
            "open_set_distribution": named(spread, names, "y_pred").orderBy(F.desc("rows"), "y_pred"),
            "open_set_confidence": metrics.open_set_confidence(scored, n_classes),
        }
    per_class = metrics.per_class_metrics(scored, n_classes)
    confusion = metrics.confusion_matrix(scored, n_classes)
    areas = curves.class_areas(scored).select("class", "roc_auc", "average_precision")
    return {
        "per_class_metrics": named(per_class.join(areas, "class", "left"), names, "class").orderBy(
            F.desc("support"), "class"
        ),
        "confusion_matrix": confusion,
        "confusion_normalized": metrics.confusion_normalized(confusion),
        "classification_report": metrics.classification_report(per_class),
        "summary_metrics": summary_metrics(scored, n_classes),
        "roc_curve": curves.roc_curve(scored),
        "roc_macro_curve": curves.roc_macro_curve(scored),
        "pr_curve": curves.pr_curve(scored),
    }


def named(table: DataFrame, names: DataFrame | None, key: str) -> DataFrame:
    """Add the class name of a code."""
    if names is None:
        return table
    return table.join(bounded_lookup(names.withColumnRenamed("class", key)), key, "left")


def write_report(tables: dict[str, DataFrame], path: str) -> list[str]:
    return [export_table(table, f"{path}/{name}", "csv") for name, table in tables.items()]
