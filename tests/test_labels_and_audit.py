import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.functions.numeric import clean_float
from plumbline.operators import accounting, audit, labels
from tests.fixtures import RENAMED


def test_merged_names(spark):
    raw = [" Bruise-OLD ", "bruise-new", "Bruised", "scab (dry)", "Sound", "Hail"]
    rows = spark.createDataFrame([(x,) for x in raw], "l string")
    merged = [r[0] for r in rows.select(labels.LabelPolicy(RENAMED).merged(F.col("l"))).collect()]
    assert merged == ["Bruised", "Bruised", "Bruised", "Scab", "Sound", "Hail"]


def test_policy_settings():
    with pytest.raises(ValueError):
        labels.LabelPolicy({}, ["Sound", " Hail"], ["Hail"])
    with pytest.raises(ValueError):
        labels.LabelPolicy({}, [])
    with pytest.raises(ValueError):
        labels.LabelPolicy.from_config({"merge_map": {}, "typo": []})


def test_open_rows_survive_keep_only(spark):
    rows = spark.createDataFrame([("Sound",), ("Hail",), ("Scab",)], "label string")
    got = labels.apply_policy(rows, labels.LabelPolicy({}, ["Sound"], ["Hail"])).collect()
    assert [(r["keep"], r["open_set"]) for r in got] == [(True, False), (True, True), (False, False)]


@pytest.mark.parametrize("bad", [None, "", " \t"])
def test_bad_labels_stop_the_query(spark, bad):
    rows = spark.createDataFrame([("a",), (bad,)], "l string")
    with pytest.raises(PySparkException, match="target label"):
        rows.select(labels.canonical_label(F.col("l"))).collect()
    with pytest.raises(ValueError):
        labels.missing_labels(rows, "l", fail=True)


def test_file_names(spark):
    rows = spark.createDataFrame([("spring/bruise-old.parquet",), ("a.b.parquet",), ("plain",)], "p string")
    got = [r[0] for r in rows.select(labels.label_from_file_name(F.col("p"))).collect()]
    assert got == ["bruise-old", "a.b", "plain"]


def test_clean_float(spark):
    rows = spark.createDataFrame([("1.5",), ("abc",), (None,), ("Infinity",), ("1e300",)], "x string")
    got = [r[0] for r in rows.select(clean_float(F.col("x"))).collect()]
    assert got[0] == 1.5 and all(v != v for v in got[1:])


def test_encoding(spark):
    rows = spark.createDataFrame([("b", False), ("a", False), ("z", True)], "label string, open_set boolean")
    mapping = labels.label_mapping(rows.where(~F.col("open_set")))
    got = {r["label"]: r["_label"] for r in labels.encode_labels(rows, mapping).collect()}
    assert got == {"a": 0, "b": 1, "z": -1}
    with pytest.raises(ValueError):
        labels.trainable_open_overlap(rows, rows, fail=True)


# ---- audit ---------------------------------------------------------------------------------------------


def ids(spark, spec):
    frames = [
        spark.range(a, b).select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.lit(split).alias("split"))
        for kind, a, b, split in spec
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def test_clean_splits_pass(spark):
    rows = ids(spark, [("sample", 0, 30_000, "train"), ("sample", 30_000, 40_000, "validation")])
    exact = audit.leakage_exact(rows).first()
    assert exact["passed"] and exact["cross_split"] == 0 and exact["identities"] == 40_000
    assert audit.leakage_sampled(rows, 8).first()["cross_split"] == 0


def test_planted_overlap_is_found(spark):
    rows = ids(spark, [("sample", 0, 30_000, "train"), ("sample", 29_000, 40_000, "validation")])
    exact = audit.leakage_exact(rows)
    assert exact.first()["cross_split"] == 1_000
    sampled = audit.leakage_sampled(rows, 8).first()
    assert 60 < sampled["cross_split"] < 200 and sampled["identities_seen"] == 41_000
    with pytest.raises(ValueError):
        audit.enforce_audit(exact, group_aware=True)
    off = {"fail_on_cross_split_overlap": False}
    assert audit.enforce_audit(exact, True, off).isEmpty()


def test_group_overlap_matters_only_when_group_aware(spark):
    rows = ids(spark, [("group", 0, 20_000, "train"), ("group", 0, 20_000, "test"), ("sample", 0, 10, "train")])
    assert not audit.leakage_exact(rows, True).where("kind = 'group'").first()["passed"]
    assert audit.leakage_exact(rows, False).where("kind = 'group'").first()["passed"]
    assert audit.enforce_audit(audit.leakage_exact(rows, False), False).isEmpty()
    scoped = audit.audit_scope(rows, "by_capture_day")
    assert audit.leakage_exact(scoped).where("kind = 'group'").first()["cross_split"] == 0


def test_repeats_inside_a_split(spark):
    rows = ids(spark, [("sample", 0, 100, "train"), ("sample", 0, 10, "train")])
    assert audit.leakage_exact(rows).first()["duplicates_within_split"] == 10
    assert audit.leakage_sampled(rows, 1).first()["duplicates_within_split"] == 10


def test_one_hot_identity(spark):
    """A third of all rows share one group; the audit still combines map-side."""
    hot = spark.range(9_000).select(
        F.lit("group").alias("kind"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"),
        F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"),
    )
    assert audit.leakage_exact(hot).first()["cross_split"] == 1
    plan = audit.leakage_exact(hot)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_tracked_limit(spark):
    sampled = audit.leakage_sampled(ids(spark, [("sample", 0, 1_000, "train")]), 1)
    with pytest.raises(ValueError):
        audit.tracked_limit(sampled, 10)
    with pytest.raises(ValueError):
        audit.leakage_sampled(sampled, 0)


# ---- account ---------------------------------------------------------------------------------------------


def counts(spark, rows):
    return spark.createDataFrame(rows, "label string, open_set boolean, split string, rows bigint")


def test_open_only_split_is_exempt(spark):
    table = counts(spark, [("a", False, "train", 5), ("a", False, "validation", 2), ("z", True, "test", 3)])
    assert accounting.missing_classes(table).isEmpty()
    assert [r["split"] for r in accounting.open_only_splits(table).collect()] == ["test"]
    short = counts(spark, [("a", False, "train", 5), ("b", False, "train", 2), ("a", False, "test", 3), ("a", False, "validation", 1)])
    assert {(r["split"], r["label"]) for r in accounting.missing_classes(short).collect()} == {("test", "b"), ("validation", "b")}
    with pytest.raises(ValueError):
        accounting.missing_classes(short, fail=True)


def inventory(spark, rows_read=100):
    return spark.createDataFrame([("f", 100, 100, rows_read, 60)], "path string, physical_rows bigint, planned_rows bigint, rows_read bigint, rows_written bigint")


def test_full_read_gate(spark):
    assert accounting.full_read_gate(inventory(spark), 60, 40).isEmpty()
    assert not accounting.full_read_gate(inventory(spark), 60, 20).isEmpty()
    with pytest.raises(ValueError):
        accounting.full_read_gate(inventory(spark, 90), 60, 40, fail=True)
    assert not accounting.full_read_gate(inventory(spark).limit(0), 0, 0).isEmpty()
    with pytest.raises(ValueError):
        accounting.sampling_count_check(inventory(spark, 90), fail=True)


def test_row_account(spark):
    rows = spark.createDataFrame(
        [(True, "train"), (True, "test"), (True, None), (False, None)], "keep boolean, split string"
    )
    account = accounting.row_accounting(rows, fail=True).first()
    assert (account["rows_read"], account["excluded_by_label"], account["excluded_by_split"], account["rows_written"]) == (4, 1, 1, 2)
    with pytest.raises(ValueError):
        accounting.split_sizes(rows, fail=True)


def test_label_integrity(spark):
    table = lambda rows: spark.createDataFrame(rows, "split string, _label int")
    assert accounting.label_integrity(table([("train", 0), ("test", 1), ("test", -1)])).isEmpty()
    with pytest.raises(ValueError):
        accounting.label_integrity(table([("train", -1), ("train", 0)]), fail=True)
    with pytest.raises(ValueError):
        accounting.label_integrity(table([("train", 0), ("train", 2)]), fail=True)
