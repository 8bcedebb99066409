"""Does any identity cross splits? One aggregate per identity, no self-joins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.checks import guard
from plumbline.functions.hashing import divisible, seeded_hash
from plumbline.operators.splits import SPLITS, drop_unassigned

AUDIT_SALT = "leak-audit"
PAIRS = (("train", "validation"), ("train", "test"), ("validation", "test"))


def identities(frame: DataFrame, sample: str | None = None, group: str | None = None) -> DataFrame:
    """Long form (kind, id, split) of the sample and group identities of assigned rows.

    One pass: each row emits its identities, so the source is scanned once.
    """
    pairs = [
        F.struct(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("id"))
        for kind, column in (("sample", sample), ("group", group))
        if column is not None
    ]
    return (
        drop_unassigned(frame)
        .select("split", F.explode(F.array(*pairs)).alias("item"))
        .select("item.kind", "item.id", "split")
    )


def audit_scope(ids: DataFrame, strategy: str) -> DataFrame:
    """Under a day split a group may recur on the test day; only train and validation count."""
    if strategy != "by_capture_day":
        return ids
    return ids.where((F.col("kind") == "sample") | F.col("split").isin("train", "validation"))


def _per_identity(ids: DataFrame) -> DataFrame:
    """(kind, id) with the number of rows in each split. A hot group combines map-side."""
    return ids.groupBy("kind", "id").agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    )


def leakage_exact(ids: DataFrame, group_aware: bool = True) -> DataFrame:
    """Per kind: identities, those in several splits, repeats inside one split, verdict."""
    in_splits = sum((F.col(s) > 0).cast("int") for s in SPLITS)
    repeats = sum(F.greatest(F.col(s) - 1, F.lit(0)) for s in SPLITS)
    ignored = F.lit(not group_aware) & (F.col("kind") == "group")
    return (
        _per_identity(ids)
        .groupBy("kind")
        .agg(
            F.count("*").alias("identities"),
            F.count_if(in_splits > 1).alias("cross_split"),
            F.sum(F.when(F.col("kind") == "sample", repeats).otherwise(F.lit(0))).alias(
                "duplicates_within_split"
            ),
        )
        .withColumn("passed", (F.col("cross_split") == 0) | ignored)
    )


def leakage_pairs(ids: DataFrame) -> DataFrame:
    """(kind, pair, overlap): distinct identities shared by each pair of splits."""
    counted = [
        F.count_if((F.col(a) > 0) & (F.col(b) > 0)).alias(f"{a}_{b}") for a, b in PAIRS
    ]
    wide = _per_identity(ids).groupBy("kind").agg(*counted)
    items = [
        F.struct(F.lit(f"{a}_intersection_{b}").alias("pair"), F.col(f"{a}_{b}").alias("overlap"))
        for a, b in PAIRS
    ]
    return wide.select("kind", F.inline(F.array(*items)))


def leakage_sampled(ids: DataFrame, divisor: int, assumed_leaks: int = 100) -> DataFrame:
    """The exact check on a salted 1-in-K subsample of the identities.

    The filter sits below the shuffle, so 1/K of the identities move.
    ``escape_probability`` is the chance that ``assumed_leaks`` leaking identities all miss
    the subsample.
    """
    if divisor <= 0:
        raise ValueError("The identity sample divisor must be positive")
    # Identities outside the subsample fold into one NULL id, which combines map-side, so
    # one scan gives both the occurrences seen and the identities tracked.
    kept = divisible(seeded_hash(AUDIT_SALT, F.col("id")), divisor)
    per_id = _per_identity(ids.withColumn("id", F.when(kept, F.col("id"))))
    tracked = F.col("id").isNotNull()
    in_splits = sum((F.col(s) > 0).cast("int") for s in SPLITS)
    repeats = sum(F.greatest(F.col(s) - 1, F.lit(0)) for s in SPLITS)
    overlaps = [f"{a}_{b}" for a, b in PAIRS]
    return (
        per_id.groupBy("kind")
        .agg(
            F.sum(sum(F.col(s) for s in SPLITS)).alias("identities_seen"),
            F.coalesce(F.sum(F.when(tracked, in_splits)), F.lit(0)).cast("bigint").alias(
                "tracked_distinct"
            ),
            F.coalesce(F.sum(F.when(tracked & (F.col("kind") == "sample"), repeats)), F.lit(0)).alias(
                "duplicates_within_split"
            ),
            *[
                F.count_if(tracked & (F.col(a) > 0) & (F.col(b) > 0)).alias(f"{a}_{b}")
                for a, b in PAIRS
            ],
        )
        .withColumn("cross_split", sum(F.col(name) for name in overlaps[1:]) + F.col(overlaps[0]))
        .withColumn(
            "escape_probability", F.pow(F.lit(1.0 - 1.0 / divisor), F.lit(float(assumed_leaks)))
        )
    )


def enforce_audit(
    result: DataFrame, group_aware: bool, switches: Mapping[str, bool] | None = None, fail: bool = True
) -> DataFrame:
    """Overlaps that must stop the run, honouring the switches; raises unless told not to."""
    switches = switches or {}
    wanted = []
    if switches.get("fail_on_cross_split_overlap", True):
        wanted.append("sample")
    if group_aware and switches.get("fail_on_group_cross_split_overlap", True):
        wanted.append("group")
    bad = result.where(F.col("kind").isin(wanted) & (F.col("cross_split") > 0))
    return guard(bad.select("kind", "cross_split"), fail, "Identities found in several splits")


def tracked_limit(result: DataFrame, maximum: int, fail: bool = True) -> DataFrame:
    """The sampled audit refuses to track more identities than allowed; raise K instead."""
    total = result.agg(F.sum("tracked_distinct").alias("tracked")).where(F.col("tracked") > maximum)
    return guard(total, fail, f"The audit tracks more than {maximum} identities")
