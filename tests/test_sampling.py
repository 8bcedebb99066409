import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import lookup
from plumbline.functions.hashing import seeded_hash
from plumbline.functions.text import canonical_text
from plumbline.operators import sampling


def quotas_of(spark, sizes, target):
    rows = spark.createDataFrame(list(sizes.items()), "path string, rows bigint")
    return {r["path"]: r["quota"] for r in sampling.proportional_quotas(rows, "path", target).collect()}


def test_largest_remainder(spark):
    assert quotas_of(spark, {"a": 7, "b": 5, "c": 2}, 10) == {"a": 5, "b": 4, "c": 1}
    assert quotas_of(spark, {"a": 70, "b": 50, "c": 20}, 70) == {"a": 35, "b": 25, "c": 10}
    assert quotas_of(spark, {"a": 1, "b": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 0}
    assert quotas_of(spark, {"a": 2, "b": 3}, 100) == {"a": 2, "b": 3}
    huge = quotas_of(spark, {"a": 4 * 10**12, "b": 3 * 10**12}, 10**12)
    assert sum(huge.values()) == 10**12
    with pytest.raises(ValueError):
        quotas_of(spark, {"a": 1}, 0)


@pytest.mark.parametrize("files", [1, 40, 3_000])
def test_quotas_of_many_files_equal_one_sorted_list(spark, files):
    """Random sizes, half of them alike, so that remainders tie."""
    rng = random.Random(files)
    sizes = {f"f{i:05d}": 12 if i % 2 else rng.randint(0, 900) for i in range(files)}
    total = sum(sizes.values())
    for target in (1, total // 3, total + 5):
        if not target:
            continue
        wanted = min(target, total)
        order = sorted(sizes, key=lambda f: (-(wanted * sizes[f] % total), f))
        expected = {f: wanted * n // total for f, n in sizes.items()}
        for f in order[: wanted - sum(expected.values())]:
            expected[f] += 1
        assert quotas_of(spark, sizes, target) == expected


def test_quotas_need_no_single_partition(spark):
    rows = spark.range(500).selectExpr("cast(id AS string) AS path", "id % 7 AS rows")
    plan = sampling.proportional_quotas(rows, "path", 100)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_plan_modes(spark):
    rows = spark.createDataFrame([("a", 640), ("b", 10)], "path string, rows bigint")
    plan = lambda **k: {r["path"]: r["planned_rows"] for r in sampling.sampling_plan(rows, "path", **k).collect()}
    assert plan() == {"a": 640, "b": 10}
    assert plan(samples_per_file=50) == {"a": 50, "b": 10}
    assert sum(plan(target_total_rows=91).values()) == 91
    with pytest.raises(ValueError):
        plan(samples_per_file=5, target_total_rows=5)
    with pytest.raises(ValueError):
        plan(samples_per_file=0)


def test_stratified_quotas():
    quotas = sampling.stratified_quotas({0: 8_200, 1: 770, 2: 4}, 640)
    assert sum(quotas.values()) == 640 and min(quotas.values()) >= 1
    assert sampling.stratified_quotas({0: 5, 1: 5}, 10) == {0: 5, 1: 5}
    with pytest.raises(ValueError):
        sampling.stratified_quotas({0: 5, 1: 5, 2: 5}, 2)
    # Many rare classes push the minimum of one over the budget: the largest is trimmed.
    counts = {0: 10_000, **{i: 1 for i in range(1, 60)}}
    trimmed = sampling.stratified_quotas(counts, 100)
    assert sum(trimmed.values()) == 100 and trimmed[0] == 41


def test_report_quotas():
    counts = {0: 10_000, 1: 10_000, **{i: 2 for i in range(2, 40)}}
    quotas = sampling.report_quotas(counts, 100)
    assert sum(quotas.values()) == 100 and min(quotas.values()) == 1
    assert quotas[0] + quotas[1] == 62


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.integers(1, 5_000), min_size=1), st.integers(1, 3_000))
def test_quotas_always_fit(counts, budget):
    for rule in (sampling.stratified_quotas, sampling.report_quotas):
        if sum(counts.values()) > budget and len(counts) > budget:
            with pytest.raises(ValueError):
                rule(counts, budget)
            continue
        quotas = rule(counts, budget)
        assert sum(quotas.values()) == min(budget, sum(counts.values()))
        assert all(1 <= quotas[c] <= counts[c] for c in counts)


def skewed(spark):
    """One stratum holds a third of the rows, some hold a handful."""
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 97).cast("string")))
    return spark.range(30_000).withColumn("stratum", key)


def brute_force(rows, stratum, quotas, seed):
    order = Window.partitionBy(stratum).orderBy(seeded_hash(seed, F.col("id")))
    return rows.withColumn("n", F.row_number().over(order)).join(quotas, stratum).where("n <= quota").select("id")


@pytest.mark.parametrize("rows_per_bucket", [65_536, 40, 1])
def test_draw_equals_a_full_sort(spark, monkeypatch, rows_per_bucket):
    """With whole strata as buckets, with prefixes of several digits, and where the tables are too large to broadcast."""
    monkeypatch.setattr(sampling, "ROWS_PER_BUCKET", rows_per_bucket)
    if rows_per_bucket == 1:
        monkeypatch.setattr(lookup, "SMALL_BYTES", 0)
    rows = skewed(spark)
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("rows"))
    quotas = sampling.proportional_quotas(sizes, "stratum", 4_321)
    drawn = sampling.draw(rows, ["stratum"], quotas, F.col("id"), 11).select("id")
    expected = brute_force(rows, "stratum", quotas.drop("rows"), 11)
    assert drawn.count() == 4_321
    assert drawn.exceptAll(expected).isEmpty() and expected.exceptAll(drawn).isEmpty()


def test_draw_does_not_depend_on_partitioning(spark):
    rows = skewed(spark)
    one = sampling.stratified_sample(rows, "stratum", 1_000, F.col("id"), 3).select("id")
    two = sampling.stratified_sample(rows.repartition(13), "stratum", 1_000, F.col("id"), 3).select("id")
    assert one.count() == 1_000 and one.exceptAll(two).isEmpty()


def test_final_step_does_not_move_the_rows(spark):
    rows = skewed(spark)
    drawn = sampling.stratified_sample(rows, "stratum", 1_000, F.col("id"), 3)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_wrong_quota_table_is_refused(spark):
    rows = skewed(spark)
    quotas = spark.createDataFrame([("hot", 50_000, 20_000)], "stratum string, rows bigint, quota bigint")
    with pytest.raises(ValueError):
        sampling.draw(rows, ["stratum"], quotas, F.col("id"), 1)


def test_uniform_and_balanced(spark):
    rows = skewed(spark)
    assert sampling.uniform_sample(rows, 777, F.col("id"), 1).count() == 777
    assert sampling.uniform_sample(rows, 10**6, F.col("id"), 1).count() == 30_000
    classes = rows.withColumn("c", F.when(F.col("id") < 5, 0).when(F.col("id") < 500, 1).otherwise(2))
    got = {r["c"]: r["count"] for r in sampling.balanced_sample(classes, "c", 300, F.col("id"), 1).groupBy("c").count().collect()}
    assert got == {0: 5, 1: 100, 2: 100}


def test_report_sample_of_open_set_rows(spark):
    rows = spark.range(1_000).withColumn("y", F.lit(-1))
    assert sampling.report_sample(rows, "y", 100, F.col("id"), 1).count() == 100


def test_null_strata_are_strata(spark):
    rows = spark.range(100).select(F.col("id"), F.when(F.col("id") % 10 > 0, "a").alias("k"))
    for target, expected in ((100, {"a": 90, None: 10}), (20, {"a": 18, None: 2})):
        drawn = sampling.exact_sample(rows, "k", target, F.col("id"), 3)
        assert {r["k"]: r["count"] for r in drawn.groupBy("k").count().collect()} == expected
    counts = lambda df: {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}
    assert sum(counts(sampling.stratified_sample(rows, "k", 30, F.col("id"), 3)).values()) == 30
    assert sum(counts(sampling.report_sample(rows, "k", 30, F.col("id"), 3)).values()) == 30
    assert counts(sampling.balanced_sample(rows, "k", 16, F.col("id"), 3)) == {"a": 8, None: 8}


def test_repeated_identities_are_refused(spark):
    rows = spark.range(40).select((F.col("id") % 2).alias("id"), F.lit("a").alias("k"))
    with pytest.raises(PySparkException, match="identities"):
        sampling.exact_sample(rows, "k", 15, F.col("id"), 3).count()


def test_decimal_keys_are_numbers(spark):
    rows = spark.sql("SELECT CAST(80 AS DECIMAL(9,2)) a UNION ALL SELECT CAST(80.5 AS DECIMAL(9,2)) UNION ALL SELECT CAST(0 AS DECIMAL(9,2))")
    texts = {r[0] for r in rows.select(canonical_text("a", rows.schema["a"].dataType)).collect()}
    assert texts == {"80", "80.5", "0"}
