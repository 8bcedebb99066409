import os

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.operators.splits import SPLITS
from plumbline.plans.prepare import Preparation, PrepareSettings, prepare_dataset
from plumbline.sources import integrity, scan, sink
from plumbline.streaming.incremental import IncrementalPreparation
from tests.fixtures import PLAIN, RENAMED, SEASONS, config, sheet, write_sheets


def sizes(result):
    return {r["split"]: r["count"] for r in result["splits"].groupBy("split").count().collect()}


def account(result):
    return result["row_account"].first()


def mapping(result):
    return {r["label"]: r["code"] for r in result["label_mapping"].collect()}


def balanced(total):
    return total["rows_read"] == total["rows_written"] + total["excluded_by_label"] + total["excluded_by_split"]


def test_proportional_preparation(spark, folder):
    source, out = write_sheets(f"{folder}/in", PLAIN), f"{folder}/out"
    run = Preparation(spark, config(source, dataset={"target_total_rows": 600}))
    assert (run.target, run.group_columns, run.features) == ("Grade", ["Tag"], ["Sugar", "Weight"])
    planned = {r["relative_path"]: r["planned_rows"] for r in run.plan.collect()}
    assert planned == {"Sound.parquet": 320, "bruise-old.parquet": 200, "Wormy.parquet": 80}
    result = run.write(out)
    assert sum(sizes(result).values()) == 600
    assert mapping(result) == {"Bruised": 0, "Sound": 1, "Wormy": 2}
    reasons = {r["column"]: r["reason"] for r in result["dropped_columns"].collect()}
    assert reasons.keys() == {"row no", "Tag", "Picked at", "Orchard", "Season", "Grade"}
    assert reasons["row no"] == reasons["Season"] == "excluded by name" and reasons["Grade"] == "target column"
    assert reasons["Tag"].startswith("group") and reasons["Orchard"] == "name pattern: ^orchard$"
    odd = result["splits"].agg(
        F.count_if(F.abs("Weight") == float("inf")).alias("infinite"), F.count_if(F.isnan("Sugar")).alias("missing")
    ).first()
    assert odd["infinite"] == 0 and odd["missing"] > 0
    assert max(r["rows"] for r in result["parts"].collect()) <= 150
    assert spark.read.json(f"{out}/row_account").first()["rows_written"] == 600


def test_repeat_run_gives_the_same_rows(spark, folder):
    source = write_sheets(folder, PLAIN)
    keys = [scan.FILE_ID, scan.ROW_ID, "_label", "split"]
    one, two = (
        Preparation(spark, config(source, dataset={"target_total_rows": 350})).prepared().select(*keys)
        for _ in range(2)
    )
    assert one.exceptAll(two).isEmpty() and one.count() == 350


def test_prefix_preparation(spark, folder):
    run = Preparation(spark, config(write_sheets(folder, PLAIN), dataset={"samples_per_file": 120}))
    assert {r["rows_read"] for r in run.inventory().collect()} == {120}
    assert run.narrow.where(F.col(scan.ROW_ID) >= 120).isEmpty()


def test_row_group_layout_does_not_matter(spark, folder):
    keys = [scan.FILE_ID, scan.ROW_ID, "label", "split"]
    fine, coarse = (
        Preparation(spark, config(write_sheets(f"{folder}/{size}", PLAIN, size))).narrow.select(*keys)
        for size in (50, 5_000)
    )
    assert fine.exceptAll(coarse).isEmpty()


def test_groups_over_all_seasons(spark, folder):
    """Renamed grades add up, every row is written, no tag is in two splits."""
    result = prepare_dataset(spark, config(write_sheets(f"{folder}/in", SEASONS)), f"{folder}/out")
    counted = result["class_counts"].groupBy("label").agg(F.sum("rows").alias("rows"))
    counted = {r["label"]: r["rows"] for r in counted.collect()}
    assert counted == {"Sound": 420, "Bruised": 470, "Scab": 240, "Wormy": 350, "Hail": 130}
    assert account(result)["rows_read"] == account(result)["rows_written"] == 1_610
    assert {r["kind"]: r["cross_split"] for r in result["leakage_audit"].collect()} == {"sample": 0, "group": 0}


def seasonal(days, **labels):
    split = {"strategy": "by_capture_day", "capture_day_column": "Season", "validation_fraction_of_train_day": 0.25}
    return {"split": {**split, "capture_day_assignment": days}, "labels": {"merge_map": RENAMED, **labels}}


def test_one_season_tests_the_other(spark, folder):
    changes = seasonal({"spring": "train_validation", "autumn": "test"}, keep_only=["Bruised", "Sound", "Wormy"])
    result = prepare_dataset(spark, config(write_sheets(f"{folder}/in", SEASONS), **changes), f"{folder}/out")
    got = sizes(result)
    assert (got["train"] + got["validation"], got["test"]) == (580, 660)
    assert balanced(account(result)) and account(result)["excluded_by_label"] == 240 + 130
    assert mapping(result) == {"Bruised": 0, "Sound": 1, "Wormy": 2}


def test_a_withheld_grade_is_the_whole_test_split(spark, folder):
    known = ["Bruised", "Scab", "Sound", "Wormy"]
    changes = seasonal({"spring": "train_validation"}, keep_only=known, open_set_labels=["Hail"])
    result = prepare_dataset(spark, config(write_sheets(f"{folder}/in", SEASONS), **changes), f"{folder}/out")
    test = result["splits"].where("split = 'test'").groupBy("_label").count().collect()
    assert [tuple(r) for r in test] == [(-1, 130)]
    assert sorted(mapping(result)) == known and balanced(account(result))
    assert [r["label"] for r in result["open_set_labels"].collect()] == ["Hail"]


def test_rare_class_fails_before_anything_is_written(spark, folder):
    run = Preparation(spark, config(write_sheets(f"{folder}/in", {"all": {"Sound": 350, "Hail": 1}})))
    with pytest.raises(ValueError, match="Classes missing"):
        run.write(f"{folder}/out")
    assert not os.path.exists(f"{folder}/out/splits")


def plain(table):
    return sorted(map(repr, table.collect()))


def scans(spark, work):
    """The result of ``work`` and the rows that Spark read from files meanwhile."""
    tracker, group = spark.sparkContext.statusTracker(), f"scan-{id(work)}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        return work(), len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_finished_preparation_is_read_back_without_its_sources(spark, folder):
    source = write_sheets(f"{folder}/in", PLAIN)
    settings = config(source, dataset={"target_total_rows": 300})
    first, jobs = scans(spark, lambda: prepare_dataset(spark, settings, f"{folder}/out"))
    rows, kept = plain(first["splits"]), {n: plain(t) for n, t in first.items() if n not in ("splits", "parts")}
    os.rename(source, f"{folder}/gone")
    again, jobs_again = scans(spark, lambda: prepare_dataset(spark, settings, f"{folder}/out"))
    assert jobs_again <= 3 < jobs
    assert set(again) == set(first) and plain(again["splits"]) == rows
    assert {n: plain(again[n]) for n in kept} == kept
    assert [again[n].dtypes for n in kept] == [first[n].dtypes for n in kept]
    with pytest.raises(ValueError, match="other settings"):
        prepare_dataset(spark, config(source), f"{folder}/out")


def test_a_killed_preparation_goes_on_after_its_last_stage(spark, folder, monkeypatch):
    source, out = write_sheets(f"{folder}/in", PLAIN), f"{folder}/out"
    settings = config(source, dataset={"target_total_rows": 300})
    whole = plain(prepare_dataset(spark, settings, f"{folder}/whole")["splits"])

    def killed(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as broken:
        broken.setattr(sink, "write_splits", killed)
        with pytest.raises(KeyboardInterrupt):
            prepare_dataset(spark, settings, out)
    assert not os.path.exists(f"{out}/splits")
    with monkeypatch.context() as broken:
        # The narrow passes are done: neither counts nor identities are looked at again.
        broken.setattr(Preparation, "narrow", property(killed))
        result = prepare_dataset(spark, settings, out)
    assert plain(result["splits"]) == whole and account(result)["rows_written"] == 300
    with monkeypatch.context() as broken:
        broken.setattr(sink, "write_splits", killed)
        with pytest.raises(KeyboardInterrupt):
            prepare_dataset(spark, settings, f"{folder}/other")
    write_sheets(f"{folder}/in", {"late": {"Sound": 40}})
    with pytest.raises(ValueError, match="other input files"):
        prepare_dataset(spark, settings, f"{folder}/other")


def even_sheets(folder, names=("one", "two", "three")):
    """Files of one layout, each with all grades, a repeated tag and a season."""
    os.makedirs(folder, exist_ok=True)
    for at, name in enumerate(names):
        n = 260 + 40 * at
        grade = [("Sound", "Wormy", "sound ", "Hail")[i % 4] for i in range(n)]
        tags = [f"t{at}-{i % 4}-{i // 20}" for i in range(n)]
        weight = [float("inf") if i % 50 == 7 else i / 7 for i in range(n)]
        frame = pd.DataFrame({"Tag": tags, "Grade": grade, "Weight": weight, "Sugar": [i % 9 * 1.5 for i in range(n)]})
        frame.to_parquet(f"{folder}/{name}.parquet", index=False)
    return folder


@pytest.mark.parametrize("total", [None, 500])
def test_incremental_preparation_equals_the_whole_one(spark, folder, total):
    """Rows, clean features, codes, quotas, account and audit over three files and a restart."""
    source = even_sheets(f"{folder}/in")
    settings = config(source, dataset={"target_total_rows": total}, labels={"open_set_labels": ["Hail"]})
    whole = prepare_dataset(spark, settings, f"{folder}/whole")
    step = IncrementalPreparation.of(Preparation(spark, settings), f"{folder}/step")
    calls, batch = [], step._batch

    def broken(rows, number):
        calls.append(number)
        if len(calls) == 3:
            raise RuntimeError("lost")
        batch(rows, number)

    step._batch = broken
    with pytest.raises(Exception, match="lost"):
        step.run()
    done = IncrementalPreparation.of(Preparation(spark, settings), f"{folder}/step").run()
    assert len(calls) == 3 and done.progress().count() == 3
    columns = ["Sugar", "Weight", scan.FILE_ID, scan.ROW_ID, "_label", F.col("split").cast("string").alias("split")]
    left, right = done.splits().select(*columns), whole["splits"].select(*columns)
    assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()
    tables = done.close()
    for name in ("label_mapping", "row_account", "source_inventory", "leakage_audit", "open_set_labels"):
        both = [c for c in whole[name].columns if c in tables[name].columns]
        assert plain(tables[name].select(*both)) == plain(whole[name].select(*both)), name
    if total is None:
        with pytest.raises(ValueError, match="other inputs or settings"):
            IncrementalPreparation.of(Preparation(spark, {**settings, "labels": {}}), f"{folder}/step").run()


def test_codes_stay_while_the_dictionary_grows(spark, folder):
    source = even_sheets(f"{folder}/in", ["first"])
    settings = config(source, split={"require_all_classes_each_split": False})
    done = IncrementalPreparation.of(Preparation(spark, settings), f"{folder}/out").run()
    before = {r["label"]: r["code"] for r in done.dictionary().collect()}
    assert before == {"Hail": 0, "Sound": 1, "Wormy": 2, "sound": 3}
    frame = pd.read_parquet(f"{source}/first.parquet")
    frame["Grade"] = ["Blight" if i % 2 else "Wormy" for i in range(len(frame))]
    frame.to_parquet(f"{source}/second.parquet", index=False)
    done = IncrementalPreparation.of(Preparation(spark, settings), f"{folder}/out").run()
    assert {r["label"]: r["code"] for r in done.dictionary().collect()} == {**before, "Blight": 4}
    coded = done.splits().select("label", "_label").distinct().collect()
    assert {r["label"]: r["_label"] for r in coded} == {**before, "Blight": 4}
    # The second file repeats the groups of the first, which hash alike: the audit over both still passes.
    assert done.close()["row_account"].first()["balanced"]


def test_covered_classes_pass(spark, folder):
    source = write_sheets(f"{folder}/in", {"all": {"Sound": 350, "Hail": 170}})
    result = prepare_dataset(spark, config(source), f"{folder}/out")
    assert set(sizes(result)) == set(SPLITS) and sum(sizes(result).values()) == 520


def test_label_from_file_names(spark, folder):
    for name in ("bruise-new", "Hail"):
        sheet(name, {name: 140}).drop(columns="Grade").to_parquet(f"{folder}/{name}.parquet")
    run = Preparation(spark, config(folder))
    assert run.target is None
    assert {r["label"] for r in run.narrow.select("label").distinct().collect()} == {"Bruised", "Hail"}
    with pytest.raises(ValueError, match="file-name labels"):
        Preparation(spark, config(folder, dataset={"label_from_filename_if_missing": False}))


def test_settings_are_checked(spark, folder):
    good = config(folder)
    with pytest.raises(ValueError, match="sections"):
        PrepareSettings.from_config({k: v for k, v in good.items() if k != "audit"})
    with pytest.raises(ValueError, match="scaled"):
        PrepareSettings.from_config(config(folder, preprocessing={"scaling": "standard"}))
    with pytest.raises(ValueError, match="sum to 1"):
        PrepareSettings.from_config(config(folder, split={"test": 0.5}))
    write_sheets(folder, SEASONS)
    with pytest.raises(ValueError, match="not in every source file"):
        split = seasonal({"spring": "train_validation"})["split"]
        Preparation(spark, config(folder, split={**split, "capture_day_column": "nope"}))
    with pytest.raises(ValueError, match="group_aware"):
        Preparation(spark, config(folder, dataset={"group_column_candidates": [["x"]]}, split={"strategy": "group_aware"}))


# ---- scans ---------------------------------------------------------------------------------------------------


def test_unified_schema(spark, folder):
    pd.DataFrame({" a": [1], "b ": [80], "only": ["x"]}).to_parquet(f"{folder}/1.parquet")
    pd.DataFrame({"b": [80.0, 81.5], "a": [2, 3]}).to_parquet(f"{folder}/2.parquet")
    source = scan.UnifiedSource(spark, folder)
    assert source.columns == ["a", "b"] and source.partial == ["only"]
    rows = source.table(text_columns=["b"]).orderBy("a").collect()
    assert [r["b"] for r in rows] == ["80", "80", "81.5"]
    assert [r["_sample_row_id"] for r in rows] == [0, 0, 1]
    assert {r["_relative_path"] for r in rows} == {"1.parquet", "2.parquet"}


@pytest.mark.parametrize("other", [[2.5, 3.0], [2**40, 3]])
def test_types_differ_between_files_of_the_same_names(spark, folder, other):
    pd.DataFrame({"port": pd.Series([80, 81], dtype="int32")}).to_parquet(f"{folder}/1.parquet")
    pd.DataFrame({"port": other}).to_parquet(f"{folder}/2.parquet")
    source = scan.UnifiedSource(spark, folder)
    assert sorted(r["port"] for r in source.table().collect()) == sorted([80, 81, *other])
    texts = sorted(r["port"] for r in source.table(text_columns=["port"]).collect())
    assert texts == sorted(["80", "81", *(str(int(x)) if x == int(x) else str(x) for x in other)])


def test_ids_are_of_the_path_below_the_root(spark, folder, monkeypatch):
    for name in ("a_data", "b_data", "data"):
        os.makedirs(f"{folder}/data/{name}")
        pd.DataFrame({"x": [1]}).to_parquet(f"{folder}/data/{name}/x.parquet")
    expected = {"a_data/x.parquet", "b_data/x.parquet", "data/x.parquet"}
    frame = scan.with_row_identity(scan.open_files(spark, f"{folder}/data"), f"{folder}/data")
    rows = frame.select(scan.RELATIVE_PATH, scan.FILE_ID).collect()
    assert {r[0] for r in rows} == expected and len({r[1] for r in rows}) == 3
    assert {r["relative_path"] for r in scan.list_files(spark, f"{folder}/data").collect()} == expected
    with pytest.raises(PySparkException, match="Not a file below"):
        scan.with_row_identity(scan.open_files(spark, f"{folder}/data"), f"{folder}/data/data").collect()


def test_a_folder_with_odd_characters(spark, folder):
    plain, odd = f"{folder}/plain", f"{folder}/a b+c%41"
    found = []
    for root in (plain, odd):
        os.makedirs(f"{root}/in 1")
        pd.DataFrame({"x": [1, 2]}).to_parquet(f"{root}/in 1/x y.parquet")
        rows = scan.UnifiedSource(spark, root).table().collect()
        found.append(sorted((r["x"], r[scan.RELATIVE_PATH], r[scan.FILE_ID], r[scan.ROW_ID]) for r in rows))
        assert [r["relative_path"] for r in integrity.integrity_manifest(spark, root).collect()] == ["in 1/x y.parquet"]
    assert found[0] == found[1] and found[0][0][1] == "in 1/x y.parquet"


def test_arrow_spelling_of_locations():
    assert scan.open_location("file:/a b/c.parquet")[1] == "/a b/c.parquet"
    assert scan.open_location("/plain/c.parquet")[1] == "/plain/c.parquet"
    assert scan.ARROW_SCHEMES["s3a"] == "s3"


def test_listing_errors(spark, folder):
    with pytest.raises(FileNotFoundError):
        scan.list_files(spark, f"{folder}/missing")
    with pytest.raises(FileNotFoundError):
        scan.list_files(spark, folder, "**/*.parquet")


def test_names():
    assert scan.clean_names([" a", "b\t"]) == ["a", "b"]
    with pytest.raises(ValueError):
        scan.clean_names(["a", " "])
    with pytest.raises(ValueError):
        scan.clean_names(["a", "a "])
    assert scan.find_column(["Label", "x"], None, ["target", "LABEL"]) == "Label"
    assert scan.find_column(["x"], None, ["y"]) is None
    with pytest.raises(ValueError):
        scan.find_column(["x"], "y", ["x"])
    assert scan.find_group_columns(["Crate", "shelf"], [["bin"], ["crate", "SHELF"]]) == ["Crate", "shelf"]
    assert scan.find_group_columns(["a"], [["q"]]) == []


def test_column_roles(spark):
    schema = spark.createDataFrame([], "t string, Flow string, n int, d decimal(9,2), b boolean, ts timestamp, x double").schema
    roles = {n: reason for n, _, reason in scan.column_roles(schema, "t", ["Flow"], ["N"], ["^x$"])}
    assert roles["t"] == "target column" and roles["n"] == "excluded by name"
    assert roles["Flow"].startswith("group") and roles["x"] == "name pattern: ^x$"
    assert roles["d"] == "non-numeric type: decimal(9,2)" and roles["ts"].startswith("non-numeric")
    assert roles["b"] is None
    with pytest.raises(ValueError):
        scan.feature_names([("a", "string", "no")])


def test_integrity(spark, folder):
    pd.DataFrame({"x": range(1000)}).to_parquet(f"{folder}/a.parquet")
    pd.DataFrame({"x": range(10)}).to_parquet(f"{folder}/b.parquet")
    recorded = spark.createDataFrame(integrity.integrity_manifest(spark, folder, "*.parquet").collect())
    assert integrity.integrity_check(integrity.integrity_manifest(spark, folder, "*.parquet"), recorded).isEmpty()
    import hashlib

    digest = hashlib.sha256(open(f"{folder}/a.parquet", "rb").read()).hexdigest()
    assert recorded.where("relative_path = 'a.parquet'").first()["sha256"] == digest
    with open(f"{folder}/b.parquet", "ab") as handle:
        handle.write(b"!")
    pd.DataFrame({"x": [1]}).to_parquet(f"{folder}/c.parquet")
    found = integrity.integrity_check(integrity.integrity_manifest(spark, folder, "*.parquet"), recorded)
    assert {r["relative_path"]: r["problem"] for r in found.collect()} == {
        "b.parquet": "size differs",
        "c.parquet": "not recorded",
    }


def test_fingerprint_ignores_order(spark):
    rows = [("a", 1, 10), ("b", 2, 20), ("c", 3, 30)]
    table = lambda r: spark.createDataFrame(r, "relative_path string, rows bigint, bytes bigint")
    one = integrity.input_fingerprint(table(rows), "s", ["x"], "y")
    two = integrity.input_fingerprint(table(rows[::-1]).repartition(3), "s", ["x"], "y")
    other = integrity.input_fingerprint(table([("a", 1, 10), ("b", 2, 20), ("c", 3, 31)]), "s", ["x"], "y")
    assert one.first()["fingerprint"] == two.first()["fingerprint"] != other.first()["fingerprint"]
    assert integrity.fingerprint_mismatch(one, two).isEmpty()
    with pytest.raises(ValueError):
        integrity.fingerprint_mismatch(one, other, fail=True)


def test_split_reader(spark, folder):
    rows = spark.range(100).withColumn("split", F.when(F.col("id") < 70, "train").otherwise("test")).withColumn("_label", F.lit(1))
    written = sink.write_splits(rows, f"{folder}/s", rows_per_part=16)
    assert sink.read_split(spark, f"{folder}/s", "train", ["_label", "id"], 70).columns == ["_label", "id"]
    with pytest.raises(ValueError):
        sink.read_split(spark, f"{folder}/s", "train", ["id"], 71)
    with pytest.raises(ValueError):
        sink.read_split(spark, f"{folder}/s", "holdout", ["id"])
    plan = sink.read_split(spark, f"{folder}/s", "train", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    wrong = spark.createDataFrame([("train", 70), ("test", 31)], "split string, rows bigint")
    with pytest.raises(ValueError):
        sink.check_written(written, wrong)


def test_export(spark, folder):
    table = spark.createDataFrame([(1, 0.123456789, None), (2, float("nan"), "x")], "a int, b double, c string")
    sink.export_table(table.coalesce(1), f"{folder}/t")
    text = "".join(open(f"{folder}/t/{f}").read() for f in os.listdir(f"{folder}/t") if f.endswith(".csv"))
    assert "1,0.123457," in text and "2,," in text
    sink.export_table(table, f"{folder}/j", "json")
    assert spark.read.json(f"{folder}/j").count() == 2
    with pytest.raises(ValueError):
        sink.export_table(table, f"{folder}/x", "xml")


