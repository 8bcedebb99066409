"""Counts, coverage and the row account of a prepared dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.checks import guard
from plumbline.functions.lookup import bounded_lookup
from plumbline.operators.labels import OPEN_SET_CODE, LabelPolicy, apply_policy
from plumbline.operators.splits import SPLITS, assign_split, drop_unassigned


def _rows(condition: Column, rows: str | None) -> Column:
    """Rows that meet a condition; ``rows`` names a count column of a table counted before."""
    if rows is None:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, F.col(rows))), F.lit(0)).cast("bigint")


def counted(assigned: DataFrame, label: str = "label", file: str = "_relative_path") -> DataFrame:
    """Rows per (file, label, keep, open_set, split): one narrow pass that the class counts, the
    inventory and the row account are all read from."""
    return assigned.groupBy(file, label, "keep", "open_set", "split").agg(
        F.count("*").alias("rows")
    )


def split_class_counts(frame: DataFrame, label: str = "label") -> DataFrame:
    """label x split counts, open-set labels apart from trainable ones."""
    return frame.groupBy(label, "open_set").agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    )


def split_class_rows(frame: DataFrame, label: str = "label", rows: str | None = None) -> DataFrame:
    """The same counts in long form (label, open_set, split, rows)."""
    return (
        drop_unassigned(frame)
        .groupBy(label, "open_set", "split")
        .agg(_rows(F.lit(True), rows).alias("rows"))
    )


def split_sizes(frame: DataFrame, fail: bool = False) -> DataFrame:
    """Rows per split, all three splits listed; an empty split raises when ``fail`` is set."""
    per_split = [F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    pairs = [F.struct(F.lit(s).alias("split"), F.col(s).alias("rows")) for s in SPLITS]
    sizes = frame.agg(*per_split).select(F.inline(F.array(*pairs)))
    guard(sizes.where(F.col("rows") == 0), fail, "Empty split")
    return sizes


def missing_classes(counts: DataFrame, label: str = "label", fail: bool = False) -> DataFrame:
    """(split, label) of trainable classes absent from a split.

    ``counts`` is the long form. A split that holds only open-set rows is exempt.
    """
    wanted = F.array(*[F.lit(s) for s in SPLITS])
    trainable = counts.where(~F.col("open_set"))
    exempt = (
        counts.groupBy("split")
        .agg(F.count_if(~F.col("open_set")).alias("trainable"))
        .where(F.col("trainable") == 0)
    )
    every = trainable.select(label).distinct().select(label, F.explode(wanted).alias("split"))
    absent = every.join(trainable.select(label, "split"), [label, "split"], "left_anti").join(
        exempt.select("split"), "split", "left_anti"
    )
    return guard(absent.select("split", label), fail, "Classes missing from one or more splits")


def classify_and_split(
    frame: DataFrame, policy: LabelPolicy, label: str = "label", **split_arguments
) -> DataFrame:
    """Policy flags, then a split for the kept rows. Rows out of scope have a NULL split."""
    classified = apply_policy(frame, policy, label)
    return assign_split(
        classified, open_set=F.col("open_set"), keep=F.col("keep"), **split_arguments
    )


def preflight_coverage(assigned: DataFrame, label: str = "label") -> DataFrame:
    """Coverage from label, key and day columns alone: (label, split, rows, missing).

    Nothing but narrow columns reaches the scan, so this runs before any feature work.
    """
    counts = split_class_rows(assigned, label)
    absent = missing_classes(counts, label).select(
        label, F.lit(False).alias("open_set"), "split", F.lit(0).cast("bigint").alias("rows")
    )
    return counts.unionByName(absent).withColumn("missing", F.col("rows") == 0)


def preflight_agrees(preflight: DataFrame, realised: DataFrame, fail: bool = False) -> DataFrame:
    """Rows that only one of the two coverage verdicts holds."""
    columns = preflight.columns
    left = preflight.exceptAll(realised.select(*columns)).withColumn("only_in", F.lit("preflight"))
    right = realised.select(*columns).exceptAll(preflight).withColumn("only_in", F.lit("realised"))
    return guard(left.unionByName(right), fail, "Preflight disagrees with the realised split")


def row_accounting(
    assigned: DataFrame, fail: bool = False, rows: str | None = None
) -> DataFrame:
    """read - excluded by label - excluded by split = written, as one row."""
    kept, placed = F.col("keep"), F.col("split").isNotNull()
    account = (
        assigned.agg(
            _rows(F.lit(True), rows).alias("rows_read"),
            _rows(~kept, rows).alias("excluded_by_label"),
            _rows(kept & ~placed, rows).alias("excluded_by_split"),
            *[_rows(kept & (F.col("split") == s), rows).alias(f"rows_{s}") for s in SPLITS],
        )
        .withColumn("rows_written", F.col("rows_train") + F.col("rows_validation") + F.col("rows_test"))
        .withColumn(
            "balanced",
            F.col("rows_read") - F.col("excluded_by_label") - F.col("excluded_by_split")
            == F.col("rows_written"),
        )
    )
    guard(account.where(~F.col("balanced")), fail, "Row accounting does not balance")
    return account


def source_inventory(
    assigned: DataFrame, plan: DataFrame, file: str = "_relative_path", rows: str | None = None
) -> DataFrame:
    """Per source file: physical, planned, read and written rows."""
    read = assigned.groupBy(file).agg(
        _rows(F.lit(True), rows).alias("rows_read"),
        _rows(F.col("keep") & F.col("split").isNotNull(), rows).alias("rows_written"),
    )
    return (
        plan.withColumnRenamed("relative_path", file)
        .join(read, file, "left")
        .na.fill(0, subset=["rows_read", "rows_written"])
        .select(file, "physical_rows", "planned_rows", "rows_read", "rows_written")
    )


def sampling_count_check(inventory: DataFrame, fail: bool = False) -> DataFrame:
    """Files whose read rows differ from the plan."""
    bad = inventory.where(~F.col("rows_read").eqNullSafe(F.col("planned_rows")))
    return guard(bad, fail, "Sampling count mismatch")


def full_read_gate(
    inventory: DataFrame, written: int, excluded: int, fail: bool = False
) -> DataFrame:
    """Every file read in full, and written + excluded = physical rows."""
    totals = inventory.agg(
        F.sum("physical_rows").alias("physical_rows"),
        F.count_if(
            (F.col("physical_rows") != F.col("planned_rows"))
            | (F.col("physical_rows") != F.col("rows_read"))
        ).alias("incomplete_files"),
        F.count("*").alias("files"),
    )
    bad = totals.withColumn("accounted_rows", F.lit(written + excluded).cast("bigint")).where(
        (F.col("files") == 0)
        | (F.col("incomplete_files") > 0)
        | (F.col("physical_rows") != F.col("accounted_rows"))
    )
    return guard(bad, fail, "The dataset was not read in full")


def label_integrity(
    prepared: DataFrame, fail: bool = False, rows: str | None = None
) -> DataFrame:
    """Open-set rows outside test, and codes that are not 0..n-1."""
    counts = prepared.groupBy("split", "_label").agg(_rows(F.lit(True), rows).alias("rows"))
    misplaced = counts.where(
        (F.col("_label") == OPEN_SET_CODE) & F.col("split").isin("train", "validation")
    ).select(F.lit("open-set rows outside test").alias("problem"), "split", "_label", "rows")
    codes = (
        counts.where(F.col("_label") != OPEN_SET_CODE)
        .agg(
            F.count_distinct("_label").alias("n"),
            F.min("_label").alias("low"),
            F.max("_label").alias("high"),
        )
        .where((F.col("n") > 0) & ((F.col("low") != 0) | (F.col("high") != F.col("n") - 1)))
        .select(
            F.lit("codes are not contiguous from zero").alias("problem"),
            F.lit(None).cast("string").alias("split"),
            F.col("high").alias("_label"),
            F.col("n").alias("rows"),
        )
    )
    return guard(misplaced.unionByName(codes), fail, "Prepared labels are inconsistent")


def class_distribution(assigned: DataFrame, mapping: DataFrame, label: str = "label") -> DataFrame:
    """Long (split, class, rows) with zeros for classes a split does not have."""
    wanted = F.array(*[F.lit(s) for s in SPLITS])
    grid = mapping.select(F.col(label), F.explode(wanted).alias("split"))
    counts = assigned.groupBy("split", label).agg(F.count("*").alias("rows"))
    return bounded_lookup(counts).join(grid, ["split", label], "right").na.fill(0, subset=["rows"])


def open_only_splits(counts: DataFrame) -> DataFrame:
    """Splits that hold rows but no trainable one."""
    return (
        counts.groupBy("split")
        .agg(F.count_if(~F.col("open_set")).alias("trainable"))
        .where(F.col("trainable") == 0)
        .select("split")
    )
