"""Ordered scans, importance, histories, decisions, models and streams."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import OneVsRest, RandomForestClassifier
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators import accounting, decisions, history, importance, metrics, ordered
from plumbline.operators.labels import LabelPolicy
from plumbline.plans.model import CentroidModel, MissingFill, _half_up, fit_multiclass
from plumbline.streaming.incremental import IncrementalPreparation, check_resume

# ---- ordered scans ---------------------------------------------------------------------------------------


def walked(spark):
    """One run holds a third of the records."""
    run = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11)
    return spark.range(5_000).select(run.alias("run"), "id", (F.col("id") * 7 % 13).alias("v"))


@pytest.mark.parametrize("rows_per_bucket", [10**6, 300])
def test_running_totals_equal_one_window(spark, rows_per_bucket):
    rows = ordered.with_range_bucket(walked(spark), "id", rows_per_bucket)
    assert (rows.select("_bucket").distinct().count() > 1) == (rows_per_bucket == 300)
    got = ordered.running_totals(rows, ["run"], "_bucket", [F.col("id")], {"v": "upto"})
    w = Window.partitionBy("run").orderBy("id")
    expected = walked(spark).select(
        "run", "id", F.sum("v").over(w).alias("upto"), F.sum("v").over(Window.partitionBy("run")).alias("upto_total")
    )
    assert got.select(*expected.columns).exceptAll(expected).isEmpty()
    placed = ordered.positions(rows, ["run"], "_bucket", [F.col("id")], "n")
    numbered = walked(spark).select("id", F.row_number().over(w).cast("bigint").alias("n"))
    assert placed.select("id", "n").exceptAll(numbered).isEmpty()


@pytest.mark.parametrize("rows_per_bucket", [10**6, 100])
def test_previous_equals_lag(spark, rows_per_bucket):
    rows = ordered.with_range_bucket(walked(spark), "id", rows_per_bucket)
    got = ordered.with_previous(rows, ["run"], "_bucket", ["id"], ["v", "id"])
    w = Window.partitionBy("run").orderBy("id")
    expected = walked(spark).select("id", F.lag("v").over(w).alias("prev_v"), F.lag("id").over(w).alias("prev_id"))
    assert got.count() == 5_000
    assert got.select(*expected.columns).exceptAll(expected).isEmpty()


def test_hot_run_is_spread_over_buckets(spark):
    rows = ordered.with_range_bucket(walked(spark), "id", 200)
    largest = rows.groupBy("run", "_bucket").count().agg(F.max("count")).first()[0]
    assert largest < 400


def test_hot_value_is_cut_along_the_tie(spark):
    """A third of one run's records carry the same time."""
    time = F.when(F.col("id") % 3 == 0, 2_500).otherwise(F.col("id"))
    rows = spark.range(5_000).select(F.lit(1).alias("run"), "id", time.alias("t"))
    bucketed = ordered.with_range_bucket(rows, "t", 200, tie="id")
    assert bucketed.groupBy("_bucket").count().agg(F.max("count")).first()[0] < 500
    got = ordered.with_previous(bucketed, ["run"], "_bucket", ["t", "id"], ["id"]).select("id", "prev_id")
    w = Window.partitionBy("run").orderBy("t", "id")
    expected = rows.select("id", F.lag("id").over(w).alias("prev_id"))
    assert got.count() == 5_000 and got.exceptAll(expected).isEmpty()


# ---- importance --------------------------------------------------------------------------------------------


def features(spark, values):
    return spark.createDataFrame(values, "feature string, gain double")


def test_gain_table(spark):
    table = importance.importance_gain(features(spark, [("a", 1.0), ("b", 3.0), ("c", 0.0)]))
    got = {r["feature"]: r for r in table.collect()}
    assert got["b"]["rank_gain"] == 1 and got["b"]["gain_percent"] == 75
    assert got["a"]["cumulative_gain_percent"] == 100 and got["c"]["rank_gain"] == 3
    zero = importance.importance_gain(features(spark, [("a", 0.0), ("b", 0.0)]))
    assert {r["gain_percent"] for r in zero.collect()} == {0.0}
    assert importance.importance_gain(features(spark, [("a", 1.0), ("b", 2.0)]), top=1).count() == 1


def test_consensus(spark):
    tables = {
        n: spark.createDataFrame([("a", 1), ("b", rank)], f"feature string, rank_{n} int")
        for n, rank in {"gain": 11, "split": 10, "permutation": 12, "contrib": 2}.items()
    }
    got = {r["feature"]: r for r in importance.importance_join(tables).collect()}
    assert got["a"]["top10_method_count"] == 4 and got["a"]["top10_consensus"]
    assert got["b"]["top10_method_count"] == 2 and not got["b"]["top10_consensus"]


def blobs(spark, n=600, seed=1):
    """Two informative features and one that is noise."""
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 3
    frame = pd.DataFrame(
        {
            "row_id": np.arange(n),
            "_label": y.astype(np.int32),
            "a": y * 2.0 + rng.normal(scale=0.4, size=n),
            "b": (y == 1) * 1.5 + rng.normal(scale=0.6, size=n),
            "noise": rng.normal(size=n) * 0.1,
            "split": np.where(np.arange(n) % 4 == 0, "validation", "train"),
        }
    )
    return spark.createDataFrame(frame)


def test_permuted_copies_are_permutations(spark):
    rows = blobs(spark).select("row_id", "_label", "a", "b")
    copies = importance.permuted_copies(rows, "row_id", ["a", "b"], 2, 7)
    assert copies.count() == 600 * 5
    for feature, repeat in (("a", 1), ("b", 2)):
        copy = copies.where((F.col("feature") == feature) & (F.col("repeat") == repeat))
        other = "b" if feature == "a" else "a"
        assert copy.select(feature).exceptAll(rows.select(feature)).isEmpty()
        joined = copy.join(rows.withColumnsRenamed({"a": "a0", "b": "b0", "_label": "l0"}), "row_id")
        assert joined.where(F.col(other) != F.col(f"{other}0")).isEmpty()
        assert joined.where(F.col(feature) != F.col(f"{feature}0")).count() > 550
    one, two = (copies.where((F.col("feature") == "a") & (F.col("repeat") == k)).select("row_id", "a") for k in (1, 2))
    assert one.exceptAll(two).count() > 500


def test_permutation_finds_the_useful_features(spark):
    rows = blobs(spark)
    names = ["a", "b", "noise"]
    model = CentroidModel.fit(rows.where("split = 'train'"), names)
    score = lambda c: model.score(c, names, 2.0).withColumnRenamed("_label", "y_true")
    held = rows.where("split = 'validation'")
    table = {r["feature"]: r for r in importance.permutation_importance(held, "row_id", names, score, 3, 3, 1).collect()}
    assert table["a"]["rank"] == 1 and table["a"]["mean_decrease_macro_f1"] > 0.3
    assert abs(table["noise"]["mean_decrease_macro_f1"]) < 0.05
    assert table["noise"]["within_noise"] or table["noise"]["rank"] == 3
    single = importance.permutation_importance(held, "row_id", names, score, 3, 1, 1).collect()
    assert {r["std_decrease_macro_f1"] for r in single} == {0.0}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 997, 20_000])
def test_scrambled_numbers_are_permutations(spark, n):
    keys = F.array(*[F.lit(k).cast("long") for k in importance._round_keys(5, "a", 1)])
    frame = spark.range(n).withColumn("_keys", keys)
    found = [r[0] for r in frame.select(importance.bijection("id", n)).collect()]
    assert sorted(found) == list(range(n))
    assert n < 50 or sum(x != i for i, x in enumerate(found)) > 0.9 * n


def test_copies_have_no_window_and_no_rows_of_nothing(spark):
    rows = blobs(spark).select("row_id", "_label", "a", "b")
    plan = importance.permuted_copies(rows, "row_id", ["a", "b"], 2, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert importance.permuted_copies(rows.limit(0), "row_id", ["a"], 2, 7).count() == 0


def ranked_blobs(spark, **settings):
    rows = blobs(spark)
    names = ["noise", "b", "a"]
    model = CentroidModel.fit(rows.where("split = 'train'"), names)
    score = lambda c: model.score(c, names, 2.0).withColumnRenamed("_label", "y_true")
    return rows, names, model, importance.rank_on_validation(rows, "row_id", names, score, 3, **settings)


def test_ranking_of_a_sample_is_written_and_read(spark, folder):
    rows, names, _, found = ranked_blobs(spark, maximum_rows=60, repeats=3, run_id="r7")
    held = rows.where("split = 'validation'").count()
    assert (found.header["split_rows_available"], found.header["split_rows_scored"]) == (held, 60)
    assert found.header["candidate_feature_count"] == 3 and found.header["run_id"] == "r7"
    assert 0.5 < found.header["baseline_macro_f1"] <= 1
    assert found.header["features_within_noise"] == found.table.where("within_noise").count()
    importance.write_ranking(found, folder)
    loaded = importance.load_ranking(spark, folder)
    assert loaded.header == found.header
    assert sorted(map(tuple, loaded.table.select("rank", "feature").collect())) == sorted(
        map(tuple, found.table.select("rank", "feature").collect())
    )
    assert importance.ranked_features(names, loaded)[-1] == "noise"
    with pytest.raises(ValueError):
        importance.ranked_features(["a", "b"], loaded)
    importance.write_ranking(importance.Ranking(found.table, {**found.header, "scored_split": "test"}), folder)
    with pytest.raises(ValueError, match="validation"):
        importance.load_ranking(spark, folder)


def test_permuted_values_meet_without_lists(spark):
    rows = spark.range(500).select("id", (F.col("id") % 7).cast("double").alias("a"), F.col("id").cast("double").alias("b"))
    rows = rows.withColumn("b", F.when(F.col("id") % 5 > 0, F.col("b")))
    copies = importance.permuted_copies(rows, "id", ["a", "b"], 2, 1)
    assert "collect_list" not in copies._jdf.queryExecution().optimizedPlan().toString()
    for feature in "ab":
        want = sorted(str(r[feature]) for r in rows.collect())
        for repeat in (1, 2):
            copy = copies.where((F.col("feature") == feature) & (F.col("repeat") == repeat)).collect()
            assert sorted(str(r[feature]) for r in copy) == want and len({r["id"] for r in copy}) == 500


def test_shares_round_like_round(spark):
    shares = spark.range(5000).select((F.col("id") / 4096).alias("x")).union(spark.range(5000).select(F.rand(3)))
    off = shares.where(_half_up(F.col("x") * 1e4) / 1e4 != F.round("x", 4))
    assert off.isEmpty()
    assert spark.range(1).select(_half_up(F.lit(312.5)).alias("x"), F.isnan(_half_up(F.lit(float("nan")))).alias("y")).first() == (313.0, True)


def test_ranked_sweep_scores_every_k_like_a_model_of_its_own(spark):
    rows, names, model, found = ranked_blobs(spark, repeats=2)
    order = importance.ranked_features(names, found)
    held = rows.where("split = 'validation'").withColumn("y_true", F.col("_label"))
    nested = model.score_nested(held, names, order, [1, 2, 3], 2.0)
    for k in (1, 2, 3):
        alone = CentroidModel.fit(rows.where("split = 'train'"), order[:k]).score(held, order[:k], 2.0)
        both = nested.where(F.col("k") == k).join(alone.select("row_id", F.col("y_prob").alias("q")), "row_id")
        far = both.where(F.exists(F.zip_with("y_prob", "q", lambda x, y: F.abs(x - y)), lambda d: d > 2e-6))
        assert both.count() == held.count() and far.isEmpty()
    gap = held.limit(1).withColumn("a", F.lit(None).cast("double"))
    assert {r["y_prob"] for r in model.score_nested(gap, names, order, [3]).collect()} == {None}
    with pytest.raises(ValueError, match="counts"):
        model.score_nested(held, names, order, [4])
    score = lambda h, o, ks: model.score_nested(h, names, o, ks, 2.0)
    given = rows.withColumn("y_true", F.col("_label"))
    table = decisions.sweep_ranked(given, names, found, [1, 2, 3, 9], score, 3, 0.02, 0.05)
    got = {r["k"]: r for r in table.collect()}
    assert set(got) == {1, 2, 3} and got[3]["is_baseline"] and got[3]["delta_macro_f1"] == 0
    for k in (1, 2):
        mine = metrics.validation_scores(nested.where(F.col("k") == k), 3).first()
        assert got[k]["macro_f1"] == pytest.approx(mine["macro_f1"])
        assert got[k]["accepted"] == (got[k]["delta_macro_f1"] <= 0.02 and got[k]["worst_class_recall_drop"] <= 0.05)
    passing = [k for k in (1, 2) if got[k]["accepted"]]
    # The rows were scored once; what is left reads a row per k and class.
    assert "nested" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert passing and decisions.choose_k(table).first()["chosen_k"] == min(passing)
    opened = given.withColumn("y_true", F.when(F.col("row_id") < 40, -1).otherwise(F.col("y_true")))
    with pytest.raises(ValueError):
        decisions.sweep_ranked(opened, names, found, [1], score, 3, 0.02, 0.05).collect()


def test_vectors_of_another_length_get_no_scores(spark):
    model = CentroidModel({0: [0.0, 0.0], 1: [1.0, 1.0]})
    rows = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.1]), (3, [0.1, 0.2, 0.3]), (4, None)], "id int, v array<double>")
    assert {r["id"]: r["y_prob"] is not None for r in model.score_vectors(rows, "v").collect()} == {1: True, 2: False, 3: False, 4: False}


def ranking(spark, names):
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "rank int, feature string")


GOOD = {"format_version": 1, "scored_split": "validation"}


def test_ranking_selection(spark):
    candidates = spark.createDataFrame(list(enumerate("abcd")), "position int, feature string")
    picked = importance.select_topk_ranking(candidates, ranking(spark, "dbca"), 2, GOOD)
    assert importance.feature_list(picked) == ["b", "d"]
    for bad in ({"format_version": 2, "scored_split": "validation"}, {"format_version": 1, "scored_split": "test"}, {}):
        with pytest.raises(ValueError):
            importance.check_ranking_header(bad)
    for names in ("abc", "abcde"):
        with pytest.raises(ValueError):
            importance.select_topk_ranking(candidates, ranking(spark, names), 2, GOOD)
    with pytest.raises(ValueError):
        importance.select_topk_ranking(candidates, ranking(spark, "abcd").limit(0), 2)
    for k in (0, 5):
        with pytest.raises(ValueError):
            importance.select_topk_ranking(candidates, ranking(spark, "abcd"), k)
    gains = features(spark, [("a", 1.0), ("b", 5.0), ("c", 5.0), ("d", 0.0)])
    assert importance.feature_list(importance.select_topk_gain(candidates, gains, 1)) == ["b"]


# ---- histories and decisions ---------------------------------------------------------------------------------


def run_history(spark, rounds=100):
    rows = [("r", i, "s1" if i <= 50 else "s2", 1.0 + i / 100, 2.0 if i % 10 == 0 else 0.0, 0.1) for i in range(1, rounds + 1)]
    return spark.createDataFrame(
        rows, "run string, round int, session_id string, iteration_seconds double, checkpoint_seconds double, val_macro_f1 double"
    )


def test_session_changes(spark):
    changed = history.session_changes(ordered.with_range_bucket(run_history(spark), "round", 7), "_bucket")
    assert [r["round"] for r in changed.collect()] == [51]


def test_continuity(spark):
    whole = history.history_continuity(run_history(spark), expected=100)
    assert whole.first()["continuous"]
    assert not history.history_continuity(run_history(spark, 99), expected=100).first()["continuous"]
    gap = run_history(spark).where("round <> 5")
    with pytest.raises(ValueError):
        history.broken_histories(history.history_continuity(gap), fail=True)
    twice = run_history(spark).unionByName(run_history(spark).where("round = 7"))
    assert not history.history_continuity(twice).first()["continuous"]


def test_final_scores(spark):
    done = history.final_scores(run_history(spark), ["val_macro_f1"], expected_rounds=100, fail=True).first()
    assert done["last_round"] == 100 and done["training_seconds"] == pytest.approx(sum(1 + i / 100 for i in range(1, 101)))
    with pytest.raises(ValueError):
        history.final_scores(run_history(spark, 99), ["val_macro_f1"], expected_rounds=100, fail=True)


def test_timing(spark):
    row = history.round_timing(run_history(spark, 40), 100, 30).first()
    assert row["checkpoints"] == 4 and row["total_checkpoint_seconds"] == 8.0
    assert row["remaining_sessions"] == -(-60 * row["mean_seconds"] // 30)


def test_learning_curve_columns(spark):
    rows = [(s, 1, v) for s, v in (("train", 0.1), ("val", 0.2), ("monitor", 0.4))]
    long = spark.createDataFrame(rows, "eval_set string, round int, e double").select(
        F.lit("r").alias("run"), "round", "eval_set",
        *[F.col("e").alias(f) for f in history.FIGURES],
    )
    row = history.learning_curve(history.wide_history(long)).first()
    assert row["train_accuracy"] == pytest.approx(0.9)
    assert row["val_minus_train_multi_logloss"] == pytest.approx(0.1)
    assert row["monitor_minus_val_multi_logloss"] == pytest.approx(0.2)
    assert row["val_minus_monitor_macro_f1"] == pytest.approx(-0.2)
    named = spark.createDataFrame([("r", "a"), ("r", "b")], "run string, monitor_name string")
    with pytest.raises(ValueError):
        history.mixed_monitors(named, fail=True)


def test_heartbeats(spark):
    rows = [
        ("alive", "running", "2024-01-01 11:55:00"), ("alive", "complete", "2024-01-01 10:00:00"),
        ("old", "running", "2024-01-01 01:00:00"), ("done", "Complete", "2024-01-01 01:00:00"),
        ("paused", "paused", "2024-01-01 11:59:00"),
    ]
    beats = spark.createDataFrame(rows, "run string, status string, t string").withColumn("updated_at", F.to_timestamp("t"))
    expected = spark.createDataFrame([(n,) for n in ("alive", "old", "done", "paused", "never")], "run string")
    got = history.heartbeat_status(beats, F.lit("2024-01-01 12:00:00").cast("timestamp"), 30, expected=expected)
    assert {r["run"]: r["worker_status"] for r in got.collect()} == {
        "alive": "alive", "old": "stale", "done": "complete", "paused": "stale", "never": "missing",
    }


def test_progress(spark):
    rows = [(1, "running", 0, 0), (2, "running", 3, 0), (3, "running", 3, 0), (4, "paused", 3, 0), (5, "paused", 3, 1), (6, "running", 3, 1)]
    seen = spark.createDataFrame(rows, "observed_at int, status string, current int, files int").withColumn("run", F.lit("r"))
    got = history.durable_progress(ordered.with_range_bucket(seen, "observed_at", 2), "_bucket", ["current", "files"])
    assert {r["observed_at"]: r["progress"] for r in got.collect()} == {1: False, 2: True, 3: False, 4: True, 5: True, 6: False}


def sweep(spark, recalls):
    rows = [(k, c, v) for k, values in recalls.items() for c, v in enumerate(values)]
    recall = spark.createDataFrame(rows, "k int, class int, recall double")
    scores = recall.groupBy("k").agg(F.avg("recall").alias("macro_f1"), F.avg("recall").alias("balanced_accuracy"))
    return decisions.sweep_table(scores, recall, 80, 0.02, 0.05)


def test_sweep(spark):
    table = sweep(spark, {80: [0.9, 0.9], 20: [0.9, 0.89], 15: [0.95, 0.84], 10: [0.5, 0.9], 99: [1.0, 1.0]})
    got = {r["k"]: r for r in table.collect()}
    assert set(got) == {80, 20, 15, 10}
    assert got[80]["accepted"] and got[80]["is_baseline"] and got[80]["delta_macro_f1"] == 0
    assert got[20]["accepted"] and got[20]["worst_class"] == 1
    assert not got[15]["accepted"] and not got[10]["accepted"]
    assert got[10]["worst_class_recall_drop"] == pytest.approx(0.4)
    assert decisions.choose_k(table).first()["chosen_k"] == 20
    assert decisions.choose_k(sweep(spark, {80: [0.9], 10: [0.1]})).first()["chosen_k"] is None


# ---- models ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("learner", ["boosted", "forest"])
def test_fit_with_missing_values(spark, folder, learner):
    rows = blobs(spark).withColumn("a", F.when(F.col("row_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("a")))
    names = ["a", "b", "noise"]
    fitted = fit_multiclass(rows.where("split = 'train'"), names, learner=learner, rounds=5, depth=3, learning_rate=0.3)
    assert fitted.prepare.flagged == ["a"] and fitted.n_classes == 3
    scored = fitted.score(rows.where("split = 'validation'"))
    total = scored.select(F.aggregate("y_prob", F.lit(0.0), lambda t, p: t + p).alias("t")).agg(F.min("t"), F.max("t")).first()
    assert total[0] == pytest.approx(1, abs=1e-5) and total[1] == pytest.approx(1, abs=1e-5)
    from plumbline.operators.metrics import accuracy

    assert accuracy(scored).first()["accuracy"] > 0.8
    gains = {r["feature"]: r for r in fitted.importance(spark, f"{folder}/model").collect()}
    assert set(gains) == {"a", "b", "noise", "a__missing"}
    assert gains["a"]["gain"] > gains["noise"]["gain"] and gains["a"]["split_count"] > 0


def test_label_codes_are_checked(spark):
    with pytest.raises(ValueError):
        fit_multiclass(blobs(spark).withColumn("_label", F.col("_label") * 2), ["a"])
    with pytest.raises(ValueError):
        fit_multiclass(blobs(spark), ["a"], learner="linear")


def test_boosting_sees_equal_bins_once(spark, monkeypatch):
    """Ten times the rows make the same weighted rows, and the same scores."""
    train = blobs(spark).where("split = 'train'").withColumns({c: F.round(c) for c in "ab"})
    more = train.crossJoin(spark.range(10).select(F.col("id").alias("copy")))
    sizes, fit = [], OneVsRest.fit

    def counted(self, rows):
        sizes.append((rows.count(), rows.agg(F.sum("weight")).first()[0]))
        return fit(self, rows)

    monkeypatch.setattr(OneVsRest, "fit", counted)
    models = [fit_multiclass(t, ["a", "b"], rounds=2, depth=2, learning_rate=0.3) for t in (train, more)]
    n = train.count()
    assert sizes[0][0] == sizes[1][0] and [w for _, w in sizes] == [n, 10 * n]
    first, second = (sorted(map(str, m.score(train).select("row_id", "y_prob").collect())) for m in models)
    assert first == second


def test_few_values_and_heavy_ones_keep_their_bins(spark):
    rows = spark.range(4000).select(
        F.lit(0).alias("_label"),
        F.when(F.col("id") == 7, 5.0).otherwise(F.lit(9.0)).alias("rare"),
        F.when(F.col("id") < 100, F.col("id").cast("double")).otherwise(F.lit(1e6)).alias("heavy"),
        F.lit(None).cast("double").alias("none"),
    )
    prepare = MissingFill(rows, ["rare", "heavy", "none"])
    seen = prepare.binned(rows).groupBy("_b0").count().orderBy("_b0").collect()
    assert [r["count"] for r in seen] == [1, 3999]
    assert prepare.binned(rows).where("heavy < 1e6").agg(F.max("_b1")).first()[0] < prepare.binned(rows).agg(F.max("_b1")).first()[0]
    assert prepare.cells(rows, "_label").agg(F.sum("weight")).first()[0] == 4000


def test_bags_are_drawn_for_rows_not_for_cells(spark, monkeypatch):
    """A tree's bag of 10,000 rows in one cell is Poisson(10,000) large: close to 10,000, and never left out."""
    rows = spark.range(20_000).select((F.col("id") % 2).cast("int").alias("_label"), (F.col("id") % 2).cast("double").alias("x"))
    bags, fit = [], RandomForestClassifier.fit

    def drawn(self, bag):
        bags.append([r["weight"] for r in bag.collect()])
        return fit(self, bag)

    monkeypatch.setattr(RandomForestClassifier, "fit", drawn)
    fitted = fit_multiclass(rows, ["x"], learner="forest", rounds=8, depth=2)
    assert fitted.model.getNumTrees == 8 and len(bags) == 8 and all(len(b) == 2 for b in bags)
    weights = [w for b in bags for w in b]
    assert all(9_500 < w < 10_500 for w in weights) and len(set(weights)) > 1
    assert {tuple(r["y_prob"]) for r in fitted.score(rows).where("y_true = 1").collect()} == {(0.0, 1.0)}


# ---- streams -----------------------------------------------------------------------------------------------------


def write_flows(folder, names, rows=200):
    os.makedirs(folder, exist_ok=True)
    for name in names:
        pd.DataFrame(
            {"flow": [f"{name}-{i % 50}" for i in range(rows)], "x": np.arange(rows) * 1.0, "label": ["a", "b"] * (rows // 2)}
        ).to_parquet(f"{folder}/{name}.parquet", index=False)


def stream(spark, source, out, group=("flow",)):
    schema = spark.read.parquet(source).schema

    def assign(batch):
        return accounting.classify_and_split(
            batch, LabelPolicy(), strategy="group_aware" if group else "row_hash", seed=2026, group_columns=list(group)
        )

    return IncrementalPreparation(spark, source, schema, assign, out, ["x"], group_aware=bool(group))


def test_files_are_taken_in_once(spark, folder):
    source, out = f"{folder}/in", f"{folder}/out"
    write_flows(source, ["f1", "f2", "f3"])
    first = stream(spark, source, out).run()
    assert first.splits().count() == 600
    assert first.progress().count() == 3
    assert len(os.listdir(f"{out}/splits")) >= 3  # one folder per file
    status = first.status(4).first()
    assert status["status"] == "preparing" and status["completed_files"] == 3
    write_flows(source, ["f4"])
    again = stream(spark, source, out).run()
    assert again.splits().count() == 800 and again.progress().count() == 4
    stream(spark, source, out).run()
    assert again.splits().count() == 800
    assert again.status(4).first()["status"] == "complete"
    audit = {r["kind"]: r for r in again.audit().collect()}
    assert audit["group"]["identities"] == 200 and audit["group"]["passed"] and audit["sample"]["passed"]


def test_a_batch_is_written_once_and_not_cached(spark, folder, monkeypatch):
    source, out = f"{folder}/in", f"{folder}/out"
    write_flows(source, ["f1"])

    def refused(self, *args):
        raise AssertionError("A batch is as large as its files")

    monkeypatch.setattr(type(spark.range(1)), "persist", refused)
    prepared = stream(spark, source, out).run()
    figures = prepared.progress().drop("finished_at").first()
    assert figures["rows_read"] == figures["rows_written"] == 200
    assert figures["excluded_by_label"] == figures["excluded_by_split"] == 0
    stored = {r["kind"]: r for r in spark.read.parquet(f"{out}/identities").groupBy("kind").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).collect()}
    assert (stored["sample"]["n"], stored["sample"]["rows"]) == (200, 200)
    assert (stored["group"]["n"], stored["group"]["rows"]) == (50, 200)
    audit = {r["kind"]: r for r in prepared.audit().collect()}
    assert audit["sample"]["identities"] == 200 and audit["group"]["identities"] == 50


def test_overlap_across_sessions_is_found(spark, folder):
    """The second session splits by row: groups of the first one now cross splits."""
    source, out = f"{folder}/in", f"{folder}/out"
    write_flows(source, ["f1"])
    stream(spark, source, out).run()
    frame = pd.read_parquet(f"{source}/f1.parquet")
    frame.to_parquet(f"{source}/f2.parquet", index=False)

    def careless(batch):
        moved = accounting.classify_and_split(batch, LabelPolicy(), strategy="group_aware", seed=1, group_columns=["flow"])
        return moved

    second = stream(spark, source, out)
    second.assign = careless
    second.run()
    audit = {r["kind"]: r for r in second.audit().collect()}
    assert not audit["group"]["passed"] and audit["group"]["cross_split"] > 0
    assert audit["sample"]["passed"]


def test_resume_needs_the_same_inputs(spark, folder):
    one = spark.createDataFrame([("abc",)], "fingerprint string")
    other = spark.createDataFrame([("xyz",)], "fingerprint string")
    assert check_resume(spark, one, f"{folder}/fp") is False
    assert check_resume(spark, one, f"{folder}/fp") is True
    with pytest.raises(ValueError):
        check_resume(spark, other, f"{folder}/fp")


def test_ragged_and_missing_vectors_get_no_scores(spark):
    model = CentroidModel({0: [0.0, 0.0], 1: [1.0, 1.0]})
    rows = spark.createDataFrame([(1, [0.0, 0.0, 9.0]), (2, [1.0]), (3, None), (4, [1.0, 1.0]), (5, [])], "id int, v array<float>")
    got = {r["id"]: r["y_prob"] for r in model.score_vectors(rows, "v", 5.0).collect()}
    assert got[4][1] > 0.99 and got[1] is got[2] is got[3] is got[5] is None


def test_incremental_refuses_other_settings(spark, folder):
    source, out = f"{folder}/in", f"{folder}/out"
    write_flows(source, ["f1"])
    first = stream(spark, source, out)
    first.features, first.identity_divisor = ["x"], 4
    first.run()
    assert dict(first.splits().dtypes)["x"] == "float"
    kept = spark.read.parquet(f"{out}/identities").where("kind = 'sample'").count()
    assert 0 < kept < 200
    with pytest.raises(ValueError, match="other inputs or settings"):
        stream(spark, source, out).run()
