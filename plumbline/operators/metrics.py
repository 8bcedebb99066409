"""Evaluation tables over a scored table (y_true INT, y_prob ARRAY<FLOAT>).

Every function takes optional ``by`` keys, so the figures of one round or one evaluation set
are the same operators. Each starts with one map-side combining aggregate over the rows; all
that follows has at most classes x classes rows per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.checks import guard
from plumbline.operators.sampling import stratified_sample
from plumbline.operators.splits import SPLITS

FLOAT32_EPS = 1.1920929e-07  # fixed value: machine epsilon of float32
ENTROPY_FLOOR = 1e-12  # fixed value: smallest probability inside a logarithm


def argmax(prob: Column) -> Column:
    """Index of the largest entry; ties go to the lowest index."""
    return (F.array_position(prob, F.array_max(prob)) - 1).cast("int")


def with_prediction(scored: DataFrame) -> DataFrame:
    return scored.withColumn("y_pred", argmax(F.col("y_prob")))


def _classes(n_classes: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n_classes - 1))


def _zero_filled(
    counted: DataFrame, by: Sequence[str], keys: Sequence[str], sums: Sequence[str], grid: Column
) -> DataFrame:
    """Sum ``sums`` per key with a zero row for every entry of ``grid``."""
    row = F.struct(*[F.col(k).cast("int").alias(k) for k in keys], *[F.col(s) for s in sums])
    return (
        counted.groupBy(*by)
        .agg(F.collect_list(row).alias("_rows"))
        .select(*by, F.explode(F.concat("_rows", grid)).alias("_row"))
        .select(*by, "_row.*")
        .groupBy(*by, *keys)
        .agg(*[F.sum(s).alias(s) for s in sums])
    )


def confusion_matrix(scored: DataFrame, n_classes: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, y_true, y_pred, rows) for every pair of classes, zeros included."""
    counted = (
        with_prediction(scored).groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("rows"))
    )
    zero = F.lit(0).cast("bigint")
    grid = F.flatten(
        F.transform(
            _classes(n_classes),
            lambda t: F.transform(
                _classes(n_classes),
                lambda p: F.struct(t.alias("y_true"), p.alias("y_pred"), zero.alias("rows")),
            ),
        )
    )
    return _zero_filled(counted, by, ["y_true", "y_pred"], ["rows"], grid)


def confusion_normalized(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shares per true class; 0 for a class without rows."""
    total = F.sum("rows").over(Window.partitionBy(*by, "y_true"))
    share = F.when(total > 0, F.col("rows") / total).otherwise(F.lit(0.0))
    return confusion.select(*by, "y_true", "y_pred", share.alias("share"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _loss() -> Column:
    """-ln p[true], with p kept float32 eps away from 0 and 1."""
    chosen = F.get("y_prob", F.col("y_true").cast("int")).cast("double")
    return -F.ln(F.least(F.greatest(chosen, F.lit(FLOAT32_EPS)), F.lit(1.0 - FLOAT32_EPS)))


def prediction_counts(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, y_true, y_pred, rows, loss): all that the figures of a hard decision need."""
    return (
        with_prediction(scored)
        .groupBy(*by, "y_true", "y_pred")
        .agg(F.count("*").alias("rows"), F.sum(_loss()).alias("loss"))
    )


def per_class_metrics(scored: DataFrame, n_classes: int, by: Sequence[str] = ()) -> DataFrame:
    """support, precision, recall and F1 of every class; 0 where a ratio is undefined."""
    return per_class_of(prediction_counts(scored, by).drop("loss"), n_classes, by)


def per_class_of(counted: DataFrame, n_classes: int, by: Sequence[str] = ()) -> DataFrame:
    """:func:`per_class_metrics` from rows counted per (y_true, y_pred)."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("rows")).otherwise(0)
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("y_true").alias("class"),
            F.col("rows").alias("support"),
            none.alias("predicted"),
            hit.cast("bigint").alias("hits"),
        ),
        F.struct(
            F.col("y_pred").alias("class"),
            none.alias("support"),
            F.col("rows").alias("predicted"),
            none.alias("hits"),
        ),
    )
    grid = F.transform(
        _classes(n_classes),
        lambda c: F.struct(
            c.alias("class"), none.alias("support"), none.alias("predicted"), none.alias("hits")
        ),
    )
    sided = counted.select(*by, F.inline(sides))
    summed = sided.groupBy(*by, "class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "hits")]
    )
    full = _zero_filled(summed, by, ["class"], ["support", "predicted", "hits"], grid)
    return (
        full.withColumn("precision", _ratio(F.col("hits"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("hits"), F.col("support")))
        .withColumn("f1", _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")))
    )


def accuracy(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """accuracy and multi_error = 1 - accuracy."""
    right = F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))
    return (
        with_prediction(scored)
        .groupBy(*by)
        .agg(right.alias("accuracy"), F.count("*").alias("rows"))
        .withColumn("multi_error", 1 - F.col("accuracy"))
    )


def balanced_accuracy(per_class: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean recall of the classes that have rows."""
    recall = F.when(F.col("support") > 0, F.col("recall"))
    return per_class.groupBy(*by).agg(F.avg(recall).alias("balanced_accuracy"))


def macro_scores(per_class: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro precision, recall and F1 over all classes; an absent class counts as 0."""
    return per_class.groupBy(*by).agg(
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")]
    )


def weighted_f1(per_class: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    weighted = F.sum(F.col("f1") * F.col("support"))
    return per_class.groupBy(*by).agg(
        _ratio(weighted, F.sum("support")).alias("weighted_f1")
    )


def mcc(per_class: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Multiclass Matthews correlation from the class marginals."""
    as_double = {c: F.col(c).cast("double") for c in ("hits", "support", "predicted")}
    sums = per_class.groupBy(*by).agg(
        F.sum(as_double["hits"]).alias("_c"),
        F.sum(as_double["support"]).alias("_s"),
        F.sum(as_double["predicted"] * as_double["support"]).alias("_tp"),
        F.sum(as_double["predicted"] * as_double["predicted"]).alias("_pp"),
        F.sum(as_double["support"] * as_double["support"]).alias("_tt"),
    )
    square = F.col("_s") * F.col("_s")
    below = F.sqrt(square - F.col("_pp")) * F.sqrt(square - F.col("_tt"))
    above = F.col("_c") * F.col("_s") - F.col("_tp")
    return sums.select(*by, _ratio(above, below).alias("mcc"))


def log_loss(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean -ln p[true], with p kept float32 eps away from 0 and 1."""
    return scored.groupBy(*by).agg(F.avg(_loss()).alias("log_loss"))


def minority_class(per_class: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The class with the fewest rows (at least one), ties to the lowest code, and its F1."""
    row = F.struct("class", "support", "f1")
    chosen = F.min_by(row, F.struct("support", "class")).alias("_m")
    return (
        per_class.where(F.col("support") > 0)
        .groupBy(*by)
        .agg(chosen)
        .select(
            *by,
            F.col("_m.class").alias("minority_class"),
            F.col("_m.support").alias("minority_support"),
            F.col("_m.f1").alias("minority_f1"),
        )
    )


def classification_report(per_class: DataFrame) -> DataFrame:
    """One row per class, then accuracy, macro average and weighted average."""
    figures = ("precision", "recall", "f1")
    rows = per_class.select(F.col("class").cast("string").alias("name"), *figures, "support")
    total = F.sum("support")
    accuracy_value = _ratio(F.sum("hits"), total)
    weight = lambda m: _ratio(F.sum(F.col(m) * F.col("support")), total)
    lines = F.array(
        F.struct(
            F.lit("accuracy").alias("name"),
            *[F.col("_acc").alias(m) for m in figures],
            F.col("_n").alias("support"),
        ),
        F.struct(
            F.lit("macro avg").alias("name"),
            *[F.col(f"_macro_{m}").alias(m) for m in figures],
            F.col("_n").alias("support"),
        ),
        F.struct(
            F.lit("weighted avg").alias("name"),
            *[F.col(f"_weighted_{m}").alias(m) for m in figures],
            F.col("_n").alias("support"),
        ),
    )
    averages = per_class.agg(
        total.alias("_n"),
        accuracy_value.alias("_acc"),
        *[F.avg(m).alias(f"_macro_{m}") for m in figures],
        *[weight(m).alias(f"_weighted_{m}") for m in figures],
    ).select(F.inline(lines))
    return rows.unionByName(averages)


# ---- rows of withheld classes -------------------------------------------------------------------


def open_set_distribution(scored: DataFrame, n_classes: int, by: Sequence[str] = ()) -> DataFrame:
    """Where the model sends rows of classes it never saw: (y_pred, rows, share)."""
    counted = with_prediction(scored).groupBy(*by, "y_pred").agg(F.count("*").alias("rows"))
    zero = F.lit(0).cast("bigint")
    grid = F.transform(
        _classes(n_classes), lambda c: F.struct(c.alias("y_pred"), zero.alias("rows"))
    )
    full = _zero_filled(counted, by, ["y_pred"], ["rows"], grid)
    total = F.sum("rows").over(Window.partitionBy(*by))
    return full.withColumn("share", _ratio(F.col("rows"), total))


def open_set_confidence(scored: DataFrame, n_classes: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean largest probability, mean entropy, the entropy of pure guessing, the dominant class."""
    prob = F.transform("y_prob", lambda p: p.cast("double"))
    entropy = -F.aggregate(
        prob,
        F.lit(0.0),
        lambda total, p: total + p * F.ln(F.greatest(p, F.lit(ENTROPY_FLOOR))),
    )
    counted = (
        with_prediction(scored)
        .groupBy(*by, "y_pred")
        .agg(
            F.count("*").alias("_rows"),
            F.sum(F.array_max(prob)).alias("_confidence"),
            F.sum(entropy).alias("_entropy"),
        )
    )
    total = F.sum("_rows")
    first = F.max_by(F.struct("y_pred", "_rows"), F.struct("_rows", -F.col("y_pred")))
    return (
        counted.groupBy(*by)
        .agg(
            total.alias("open_set_rows"),
            (F.sum("_confidence") / total).alias("mean_max_probability"),
            (F.sum("_entropy") / total).alias("mean_entropy"),
            first.alias("_first"),
        )
        .select(
            *by,
            "open_set_rows",
            "mean_max_probability",
            "mean_entropy",
            F.lit(float(n_classes)).alias("_n"),
            F.col("_first.y_pred").alias("dominant_class"),
            (F.col("_first._rows") / F.col("open_set_rows")).alias("dominant_share"),
        )
        .withColumn("maximum_entropy", F.ln("_n"))
        .drop("_n")
    )


def mixed_open_set(scored: DataFrame, fail: bool = False) -> DataFrame:
    """A table that mixes withheld and trained classes cannot be scored as either."""
    mixed = scored.agg(
        F.count_if(F.col("y_true") < 0).alias("open_set_rows"),
        F.count_if(F.col("y_true") >= 0).alias("labelled_rows"),
    ).where((F.col("open_set_rows") > 0) & (F.col("labelled_rows") > 0))
    return guard(mixed, fail, "The test split mixes open-set and labelled rows")


def validation_scores(
    scored: DataFrame,
    n_classes: int,
    fail: bool = True,
    maximum_rows: int = 0,
    seed: int = 2026,
    identity: Column | None = None,
) -> DataFrame:
    """Macro F1, balanced accuracy and per-class recall of the validation split only.

    ``maximum_rows`` scores a class-proportional sample with at least one row per class, the rows of the
    smallest seeded hash of ``identity``; 0 scores all. ``rows_available`` counts the split, ``rows_scored`` what was scored.
    """
    rows = scored.where(F.col("split") == "validation")
    opened = rows.where(F.col("y_true") < 0).agg(F.count("*").alias("rows"))
    guard(opened.where(F.col("rows") > 0), fail, "The validation split contains open-set rows")
    rows = rows.where(F.col("y_true") >= 0)
    drawn = rows
    if maximum_rows > 0:
        if identity is None:
            raise ValueError("A sample of validation needs the identity of its rows")
        drawn = stratified_sample(rows, "y_true", maximum_rows, identity, seed)
    per_class = per_class_metrics(drawn, n_classes)
    whole = Window.partitionBy()
    table = per_class.select(
        "class",
        "support",
        "recall",
        F.avg("f1").over(whole).alias("macro_f1"),
        F.avg("recall").over(whole).alias("balanced_accuracy"),
        F.sum("support").over(whole).alias("rows_scored"),
    )
    available = F.col("rows_scored") if drawn is rows else F.lit(rows.count()).cast("bigint")
    return table.withColumn("rows_available", available)


RESERVED_SETS = ("train", "val", "validation", "training", "valid", "test")


def monitor_set(
    rows: DataFrame,
    maximum_rows: int,
    identity: Column,
    split: str = "test",
    name: str = "monitor",
    label: str = "y_true",
    seed: int = 2026,
) -> DataFrame:
    """A class-proportional sample of a split that a training run watches and never selects by, with its ``eval_set``.

    The name must not be that of a set the run has anyway. A split that holds open-set rows, all or some, is refused:
    they have no label to score against.
    """
    if split not in SPLITS:
        raise ValueError(f"Unknown split {split!r}")
    if not name or name.lower() in RESERVED_SETS:
        raise ValueError(f"{name!r} is not a name for a monitored set")
    if maximum_rows <= 0:
        raise ValueError("The row budget of a monitored set must be positive")
    watched = rows.where(F.col("split") == split)
    opened = watched.agg(F.count_if(F.col(label) < 0).alias("open_set_rows")).where(F.col("open_set_rows") > 0)
    guard(opened, True, f"The {split} split holds open-set rows and cannot be monitored")
    return stratified_sample(watched, label, maximum_rows, identity, seed).withColumn("eval_set", F.lit(name))
