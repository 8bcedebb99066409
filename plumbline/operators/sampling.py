"""Exact, repeatable samples.

A sample is a hash cut-off per stratum, so the wide rows never move: the last step is a
filter over the source. The cut-off is found by radix selection, without sorting a stratum: a histogram of
hash prefixes, as long as the stratum's size asks for, says in which bucket the last sampled row lies
and how many rows come before it; only that bucket is ranked. Two narrow scans, whatever the number of
strata, and exact however the hashes fall.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.hashing import seeded_hash
from plumbline.functions.lookup import bounded_rows, small_side
from plumbline.session import written

#: Rows of a stratum in one bucket of hash prefixes (about), and hex digits of a prefix at most.
ROWS_PER_BUCKET, PREFIX_DIGITS = 65_536, 12


# ---- how many rows of each stratum ------------------------------------------------------------


def proportional_quotas(sizes: DataFrame, key: str, target: int, rows: str = "rows") -> DataFrame:
    """Exact total by largest remainder in integer arithmetic; ties go to the smaller key.

    ``sizes`` has one row per file or class, any number of them. Totals are two numbers. The keys that get one
    row more are the first ones by remainder and key: keys are sorted in ranges, and the counts of the ranges, one number
    for each partition, say in which of them and where the last one stands.
    """
    if target <= 0:
        raise ValueError("The target row count must be positive")
    big = "decimal(38,0)"
    total = int(sizes.agg(F.sum(F.col(rows).cast(big))).first()[0] or 0)
    wanted = min(target, total)
    if not total:
        return sizes.withColumn("quota", F.lit(0).cast("bigint"))
    product = (F.lit(wanted).cast("decimal(19,0)") * F.col(rows).cast("decimal(19,0)")).cast(big)
    whole = F.lit(total).cast(big)
    remainder = F.col("_product") % whole
    shared = (
        sizes.withColumn("_product", product)
        .withColumn("_remainder", remainder)
        .withColumn("_floor", ((F.col("_product") - F.col("_remainder")) / whole).cast(big))
        .drop("_product")
    )
    order = [F.desc("_remainder"), F.asc(key)]
    ranged = shared.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "remainders")
    part = F.shiftright("_at", 33).alias("part")
    counts = ranged.groupBy(part).agg(F.count("*").alias("n"), F.sum("_floor").alias("floor")).collect()
    left, last = wanted - sum(int(r["floor"]) for r in counts), -1
    for r in sorted(counts, key=lambda r: r["part"]):
        if left <= 0:
            break
        taken = min(left, r["n"])
        last, left = (r["part"] << 33) + taken - 1, left - taken
    extra = (F.col("_at") <= F.lit(last)).cast("int")
    return ranged.withColumn("quota", (F.col("_floor") + extra).cast("bigint")).drop("_remainder", "_floor", "_at")


def sampling_plan(
    sizes: DataFrame,
    key: str,
    samples_per_file: int | None = None,
    target_total_rows: int | None = None,
    rows: str = "rows",
) -> DataFrame:
    """(key, physical_rows, planned_rows): everything, the first N rows, or a proportional total."""
    if samples_per_file is not None and target_total_rows is not None:
        raise ValueError("samples_per_file and target_total_rows are mutually exclusive")
    if samples_per_file is not None and samples_per_file <= 0:
        raise ValueError("samples_per_file must be positive")
    if target_total_rows is not None:
        planned = proportional_quotas(sizes, key, target_total_rows, rows)
    elif samples_per_file is not None:
        planned = sizes.withColumn("quota", F.least(F.col(rows), F.lit(samples_per_file)))
    else:
        planned = sizes.withColumn("quota", F.col(rows))
    return planned.select(
        key, F.col(rows).alias("physical_rows"), F.col("quota").cast("bigint").alias("planned_rows")
    )


def _in_order(classes) -> list:
    """Classes by value, NULL before all others."""
    return sorted(classes, key=lambda c: (c is not None, c))


def _shift(quotas: dict, rows: int, step: int, urgency, allowed) -> None:
    """Move ``rows`` single rows in or out of the quotas, the most urgent class first."""
    queue = [(-urgency(c, q), i, c) for i, (c, q) in enumerate(quotas.items()) if allowed(c, q)]
    heapq.heapify(queue)
    for _ in range(rows):
        if not queue:
            return
        _, i, c = heapq.heappop(queue)
        quotas[c] += step
        if allowed(c, quotas[c]):
            heapq.heappush(queue, (-urgency(c, quotas[c]), i, c))


def stratified_quotas(counts: dict, budget: int) -> dict:
    """Proportional quotas with at least one row per class and at most ``budget`` in all.

    Rows lost to rounding go to the largest fractions, one each; when the minimum of one
    row pushes the total over the budget, the largest quotas shrink. One entry per class.
    """
    total = sum(counts.values())
    if budget <= 0 or total <= budget:
        return dict(counts)
    if len(counts) > budget:
        raise ValueError(f"A budget of {budget} rows cannot cover {len(counts)} classes")
    share = {c: counts[c] * (budget / float(total)) for c in _in_order(counts)}
    quotas = {c: min(counts[c], max(1, math.floor(s))) for c, s in share.items()}
    missing = budget - sum(quotas.values())
    rounds = {c: 0 for c in quotas}

    def next_fraction(c, q):
        # Each further row of a class waits until every other class had its turn.
        rounds[c] += 1
        return share[c] % 1 - rounds[c]

    _shift(quotas, missing, 1, next_fraction, lambda c, q: q < counts[c])
    _shift(quotas, -missing, -1, lambda c, q: q, lambda c, q: q > 1)
    return quotas


def report_quotas(counts: dict, budget: int) -> dict:
    """As :func:`stratified_quotas`, but corrections go by distance from the exact share:
    the most over-served class shrinks, the most under-served one grows."""
    total = sum(counts.values())
    if total <= budget:
        return dict(counts)
    if len(counts) > budget:
        raise ValueError(f"A budget of {budget} rows cannot cover {len(counts)} classes")
    share = {c: counts[c] / total * budget for c in _in_order(counts)}
    quotas = {c: max(1, math.floor(s)) for c, s in share.items()}
    missing = budget - sum(quotas.values())
    _shift(quotas, missing, 1, lambda c, q: share[c] - q, lambda c, q: q < counts[c])
    _shift(quotas, -missing, -1, lambda c, q: q - share[c], lambda c, q: q > 1)
    return quotas


# ---- drawing the rows ---------------------------------------------------------------------------


def draw(
    frame: DataFrame, strata: Sequence[str], quotas: DataFrame, identity: Column, seed: int
) -> DataFrame:
    """Exactly ``quota`` rows of each stratum, those with the smallest seeded hash.

    ``quotas`` has the strata columns, ``rows`` (the stratum size) and ``quota``, one row per
    stratum. ``identity`` must differ between any two rows of a stratum.
    """
    hashed = frame.withColumn("_hash", seeded_hash(seed, identity))
    narrow = hashed.select(*strata, "_hash")
    cuts = _cut_offs(narrow, list(strata), quotas)
    return (
        _join_strata(hashed, cuts, list(strata)).where(F.col("_hash") <= F.col("_cut")).drop("_hash", "_cut")
    )


def _join_strata(frame: DataFrame, table: DataFrame, strata: list[str], how: str = "inner") -> DataFrame:
    """Join a table of one row per stratum; a NULL stratum is a stratum like any other."""
    renamed = table.withColumnsRenamed({s: f"_of_{s}" for s in strata})
    same = reduce(Column.__and__, [F.col(s).eqNullSafe(F.col(f"_of_{s}")) for s in strata])
    return frame.join(renamed, same, how).drop(*[f"_of_{s}" for s in strata])


def _cut_offs(narrow: DataFrame, strata: list[str], quotas: DataFrame) -> DataFrame:
    """(strata, _cut): the largest hash that still belongs to the sample."""
    # As many hex digits as give buckets of about ROWS_PER_BUCKET rows.
    digits = F.ceil(F.log(16.0, F.greatest(F.col("rows") / ROWS_PER_BUCKET, F.lit(1.0))))
    wanted = small_side(
        quotas.where(F.col("quota") > 0).select(
            *strata, "rows", "quota", F.least(digits, F.lit(PREFIX_DIGITS)).cast("int").alias("_digits")
        ),
        "quotas",
    )
    whole = wanted.where(F.col("quota") >= F.col("rows")).select(*strata, F.lit("g").alias("_cut"))
    part = wanted.where(F.col("quota") < F.col("rows")).select(*strata, "quota", "_digits")
    bucket = F.expr("substring(_hash, 1, _digits)").alias("_bucket")
    found = _join_strata(narrow, part, strata).groupBy(*strata, "quota", "_digits", bucket).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = small_side(
        found.withColumn("_upto", F.sum("_n").over(upto))
        .where((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota")))
        .select(*strata, "_digits", "_bucket", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_rank")),
        "border",
    )
    inside = _join_strata(narrow, border, strata).where(F.expr("substring(_hash, 1, _digits)") == F.col("_bucket"))
    in_order = Window.partitionBy(*strata).orderBy("_hash")
    repeated = F.raise_error(F.lit("A sample needs identities that do not repeat inside a stratum")).cast("string")
    cuts = (
        inside.withColumn("_position", F.row_number().over(in_order))
        .withColumn("_rows_upto", F.count("*").over(in_order))
        .where(F.col("_position") == F.col("_rank"))
        .withColumn("_cut", F.when(F.col("_rows_upto") == F.col("_position"), F.col("_hash")).otherwise(repeated))
        .select(*strata, "_cut")
    )
    cuts = small_side(cuts.unionByName(whole), "cuts")
    if not _join_strata(wanted.select(*strata), cuts, strata, "left_anti").isEmpty():
        raise ValueError("The quota table does not describe the rows it is applied to")
    return cuts


def exact_sample(
    frame: DataFrame, stratum: str, target: int, identity: Column, seed: int
) -> DataFrame:
    """``target`` rows in all, proportional to stratum size, uniform inside each stratum."""
    sizes = frame.groupBy(stratum).agg(F.count("*").alias("rows"))
    return draw(frame, [stratum], proportional_quotas(sizes, stratum, target), identity, seed)


def _class_counts(frame: DataFrame, label: str, limit: int) -> dict:
    counted = frame.groupBy(label).agg(F.count("*").alias("rows"))
    return {row[label]: row["rows"] for row in bounded_rows(counted, limit)}


def _quota_table(frame: DataFrame, label: str, counts: dict, quotas: dict) -> DataFrame:
    kind = frame.schema[label].dataType.simpleString()
    rows = [(c, counts[c], quotas[c]) for c in _in_order(counts)]
    return frame.sparkSession.createDataFrame(rows, f"`{label}` {kind}, rows bigint, quota bigint")


MAX_CLASSES = 1_000_000


def stratified_sample(
    frame: DataFrame, label: str, budget: int, identity: Column, seed: int
) -> DataFrame:
    """At most ``budget`` rows, proportional per class, at least one row per class."""
    counts = _class_counts(frame, label, MAX_CLASSES)
    quotas = stratified_quotas(counts, budget)
    if quotas == counts:
        return frame
    return draw(frame, [label], _quota_table(frame, label, counts, quotas), identity, seed)


def report_sample(
    frame: DataFrame, label: str, budget: int, identity: Column, seed: int
) -> DataFrame:
    """The sample behind plots; rows that are all open-set are drawn uniformly."""
    counts = _class_counts(frame, label, MAX_CLASSES)
    if set(counts) == {-1}:
        return uniform_sample(frame, budget, identity, seed)
    quotas = report_quotas(counts, budget)
    if quotas == counts:
        return frame
    return draw(frame, [label], _quota_table(frame, label, counts, quotas), identity, seed)


def uniform_sample(frame: DataFrame, budget: int, identity: Column, seed: int) -> DataFrame:
    """``budget`` rows drawn uniformly from the whole table."""
    one = frame.withColumn("_stratum", F.lit(0))
    sizes = one.groupBy("_stratum").agg(F.count("*").alias("rows"))
    quotas = sizes.withColumn("quota", F.least(F.col("rows"), F.lit(budget)))
    return draw(one, ["_stratum"], quotas, identity, seed).drop("_stratum")


def balanced_sample(
    frame: DataFrame, label: str, requested: int, identity: Column, seed: int
) -> DataFrame:
    """The same number of rows per class, ``max(1, requested // classes)``, capped by class size."""
    if requested <= 0:
        raise ValueError("The requested row count must be positive")
    counts = _class_counts(frame, label, MAX_CLASSES)
    per_class = max(1, requested // max(1, len(counts)))
    quotas = {c: min(n, per_class) for c, n in counts.items()}
    return draw(frame, [label], _quota_table(frame, label, counts, quotas), identity, seed)
