"""Figures against plain numpy on small scored tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import curves, metrics
from plumbline.operators.ordered import LOG_STEPS, score_bucket
from plumbline.plans.report import report_tables, summary_metrics, write_report

N = 3


def scored_rows(n=90, classes=N, seed=5, digits=2, absent=None):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % classes
    if absent is not None:
        y = np.where(y == absent, 0, y)
    p = rng.dirichlet(np.ones(classes), size=n)
    p[np.arange(n), y] += 0.3
    p = np.round(p / p.sum(axis=1, keepdims=True), digits).astype(np.float32)
    return y, p


def table(spark, y, p, **extra):
    rows = [(int(a), [float(v) for v in b], i) for i, (a, b) in enumerate(zip(y, p, strict=True))]
    frame = spark.createDataFrame(rows, "y_true int, y_prob array<float>, row_id long")
    for name, value in extra.items():
        frame = frame.withColumn(name, F.lit(value))
    return frame


def confusion(y, p, n=N):
    matrix = np.zeros((n, n), dtype=int)
    for a, b in zip(y, p.argmax(axis=1), strict=True):
        matrix[a, b] += 1
    return matrix


def brute(y, p, n=N):
    m = confusion(y, p, n)
    hit, support, predicted = np.diag(m), m.sum(axis=1), m.sum(axis=0)
    safe = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    precision, recall = safe(hit, predicted), safe(hit, support)
    return support, precision, recall, safe(2 * hit, support + predicted), m


@pytest.mark.parametrize("absent", [None, 2])
def test_per_class_and_summary(spark, absent):
    y, p = scored_rows(absent=absent)
    scored = table(spark, y, p)
    support, precision, recall, f1, m = brute(y, p)
    got = metrics.per_class_metrics(scored, N).orderBy("class").collect()
    assert [r["support"] for r in got] == list(support)
    assert np.allclose([[r["precision"], r["recall"], r["f1"]] for r in got], np.c_[precision, recall, f1])
    row = summary_metrics(scored, N).first()
    assert row["macro_f1"] == pytest.approx(f1.mean())
    assert row["macro_recall"] == pytest.approx(recall.mean())
    assert row["balanced_accuracy"] == pytest.approx(recall[support > 0].mean())
    assert row["weighted_f1"] == pytest.approx((f1 * support).sum() / support.sum())
    assert row["accuracy"] == pytest.approx(np.trace(m) / m.sum())
    s, c = m.sum(), np.trace(m)
    t, q = m.sum(axis=1).astype(float), m.sum(axis=0).astype(float)
    expected = (c * s - t @ q) / math.sqrt((s * s - q @ q) * (s * s - t @ t))
    assert row["mcc"] == pytest.approx(expected)
    minority = min((v, i) for i, v in enumerate(support) if v > 0)
    assert (row["minority_support"], row["minority_class"]) == minority
    chosen = np.clip(p[np.arange(len(y)), y].astype(float), metrics.FLOAT32_EPS, 1 - metrics.FLOAT32_EPS)
    assert row["log_loss"] == pytest.approx(-np.log(chosen).mean())


def test_known_case(spark):
    p = np.array([[0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8], [0.2, 0.7, 0.1]], dtype=np.float32)
    scored = table(spark, [0, 1, 2, 1], p)
    assert metrics.macro_scores(metrics.per_class_metrics(scored, 3)).first()["macro_f1"] == 1.0
    assert metrics.accuracy(scored).first()["multi_error"] == 0.0


def test_argmax_takes_the_first_of_equals(spark):
    scored = table(spark, [0, 1], np.array([[0.4, 0.4, 0.2], [0.1, 0.45, 0.45]], dtype=np.float32))
    assert [r["y_pred"] for r in metrics.with_prediction(scored).orderBy("row_id").collect()] == [0, 1]


def test_confusion_is_zero_filled(spark):
    y, p = scored_rows()
    grid = metrics.confusion_matrix(table(spark, y, p), 5)
    assert grid.count() == 25 and grid.agg(F.sum("rows")).first()[0] == len(y)
    m = confusion(y, p, 5)
    assert all(m[r["y_true"], r["y_pred"]] == r["rows"] for r in grid.collect())
    shares = metrics.confusion_normalized(grid).groupBy("y_true").agg(F.sum("share").alias("s"))
    assert {r["y_true"]: round(r["s"], 9) for r in shares.collect()} == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0}


def test_keys_split_every_figure(spark):
    y, p = scored_rows()
    z, q = scored_rows(seed=9)
    both = table(spark, y, p, part="a").unionByName(table(spark, z, q, part="b"))
    for part, (a, b) in {"a": (y, p), "b": (z, q)}.items():
        per_class = metrics.per_class_metrics(both, N, ["part"]).where(F.col("part") == part)
        assert np.allclose([r["f1"] for r in per_class.orderBy("class").collect()], brute(a, b)[3])
        area = curves.roc_auc_ovr(both, ["part"], micro=False).where(F.col("part") == part)
        assert np.allclose([r["roc_auc"] for r in area.orderBy("class").collect()], [auc(a == c, b[:, c]) for c in range(N)])


# ---- curves -------------------------------------------------------------------------------------------------


def auc(positive, score):
    """Probability that a positive outranks a negative, ties counting half."""
    a, b = score[positive].astype(float), score[~positive].astype(float)
    return ((a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()) / (len(a) * len(b))


def walk(positive, score):
    """Cumulative (tp, fp) per distinct score, falling."""
    out = []
    for s in sorted(set(score.tolist()), reverse=True):
        out.append((s, int((positive & (score >= s)).sum()), int((~positive & (score >= s)).sum())))
    return out


def average_precision(positive, score):
    total, before, area = positive.sum(), 0, 0.0
    for _, tp, fp in walk(positive, score):
        area += (tp - before) / total * tp / (tp + fp)
        before = tp
    return area


def roc_points(positive, score):
    points = [(s, tp, fp) for s, tp, fp in walk(positive, score)]
    kept = []
    for i, (s, tp, fp) in enumerate(points):
        if 0 < i < len(points) - 1:
            before, after = points[i - 1], points[i + 1]
            if after[1] - 2 * tp + before[1] == 0 and after[2] - 2 * fp + before[2] == 0:
                continue
        kept.append((fp / (~positive).sum(), tp / positive.sum(), s))
    return [(0.0, 0.0, math.inf), *kept]


def micro(y, p):
    hits = (np.arange(p.shape[1])[None, :] == y[:, None]).ravel()
    return hits, p.ravel()


@pytest.mark.parametrize("digits,n", [(1, 60), (2, 200), (6, 150)])
def test_areas(spark, digits, n):
    y, p = scored_rows(n, digits=digits)
    scored = table(spark, y, p)
    expected = {c: (auc(y == c, p[:, c]), average_precision(y == c, p[:, c])) for c in range(N)}
    expected[-1] = (auc(*micro(y, p)), average_precision(*micro(y, p)))
    for r in curves.class_areas(scored).collect():
        assert (r["roc_auc"], r["average_precision"]) == pytest.approx(expected[r["class"]])
    for r in curves.roc_auc_ovr(scored).collect():
        assert r["roc_auc"] == pytest.approx(expected[r["class"]][0])
    for r in curves.average_precision_ovr(scored).collect():
        assert r["average_precision"] == pytest.approx(expected[r["class"]][1])
    row = curves.auc_summary(scored).first()
    weights = [(y == c).sum() for c in range(N)]
    assert row["roc_macro"] == pytest.approx(np.mean([expected[c][0] for c in range(N)]))
    assert row["pr_weighted"] == pytest.approx(np.average([expected[c][1] for c in range(N)], weights=weights))
    assert row["roc_micro"] == pytest.approx(expected[-1][0])


def test_one_sided_classes_have_no_area(spark):
    y, p = scored_rows(absent=2)
    areas = {r["class"]: r for r in curves.class_areas(table(spark, y, p)).collect()}
    assert areas[2]["roc_auc"] is None and areas[2]["average_precision"] is None
    assert curves.roc_curve(table(spark, y, p)).where("class = 2").isEmpty()
    assert curves.pr_curve(table(spark, y, p)).where("class = 2").isEmpty()
    all_one = table(spark, [0] * 10, p[:10])
    assert curves.class_areas(all_one).where("class = 0").first()["roc_auc"] is None
    assert curves.pr_curve(all_one).where("class = 0").count() > 0


@pytest.mark.parametrize("digits", [1, 3])
def test_roc_and_pr_points(spark, digits):
    y, p = scored_rows(120, digits=digits)
    scored = table(spark, y, p)
    roc = curves.roc_curve(scored).collect()
    pr = curves.pr_curve(scored).collect()
    sides = {c: (y == c, p[:, c]) for c in range(N)}
    sides[-1] = micro(y, p)
    for c, (positive, score) in sides.items():
        got = sorted((r["fpr"], r["tpr"], r["threshold"]) for r in roc if r["class"] == c)
        assert np.allclose(got, sorted(roc_points(positive, score)))
        expected = [(tp / positive.sum(), tp / (tp + fp), s) for s, tp, fp in walk(positive, score)]
        points = [(r["recall"], r["precision"], r["threshold"]) for r in pr if r["class"] == c]
        assert (0.0, 1.0, None) in points
        assert np.allclose(sorted(x for x in points if x[2] is not None), sorted(expected))


def test_macro_curve_is_the_mean_of_interpolations(spark):
    y, p = scored_rows(150, digits=2)
    grid = np.linspace(0, 1, curves.MACRO_GRID + 1)
    expected = np.zeros_like(grid)
    for c in range(N):
        points = roc_points(y == c, p[:, c])
        expected += np.interp(grid, [x[0] for x in points], [x[1] for x in points]) / N
    got = curves.roc_macro_curve(table(spark, y, p)).orderBy("fpr").collect()
    assert len(got) == len(grid)
    # At a grid point that meets a vertical step exactly, float interpolation may take either end.
    close = np.isclose([r["tpr"] for r in got], expected, atol=1e-9)
    assert close.mean() > 0.995


def test_score_buckets_follow_the_order(spark):
    values = [1.0, 0.999, 0.5, 0.4999, 1e-3, 1e-30, 0.0, -1e-30, -0.5, -3.0, 7.5]
    rows = spark.createDataFrame([(v,) for v in values], "s float").select("s", score_bucket(F.col("s")).alias("b"))
    by_score = [r["b"] for r in sorted(rows.collect(), key=lambda r: -r["s"])]
    assert by_score == sorted(by_score)
    assert len(set(by_score)) == len(values) - 0
    assert LOG_STEPS == 64


def test_thinning_keeps_even_points(spark):
    n = 12_345
    curve = spark.range(n).select(F.lit("a").alias("k"), "id", (F.col("id") / 100).cast("int").alias("_bucket"))
    short = spark.range(100).select(F.lit("b").alias("k"), "id", F.lit(0).alias("_bucket"))
    thin = curves.thin_curve(curve.unionByName(short), ["k"], [F.col("id")], "_bucket", 1_000)
    kept = sorted(r["id"] for r in thin.where("k = 'a'").collect())
    assert kept == sorted({i * (n - 1) // 999 for i in range(1_000)})
    assert kept[0] == 0 and kept[-1] == n - 1
    assert thin.where("k = 'b'").count() == 100


@pytest.mark.parametrize("bucket", [10**6, 50])
def test_percentiles(spark, bucket):
    rng = np.random.default_rng(3)
    values = {"a": np.round(rng.exponential(10, 2_001), 1), "b": rng.normal(size=500), "c": np.array([4.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs]
    frame = spark.createDataFrame(rows, "k string, v double")
    got = curves.percentiles(frame, "v", {"p50": 0.5, "p95": 0.95}, ["k"], bucket).collect()
    for r in got:
        assert (r["p50"], r["p95"]) == pytest.approx(tuple(np.percentile(values[r["k"]], [50, 95])))
    whole = curves.percentiles(frame, "v", {"p50": 0.5}, (), bucket).first()
    assert whole["p50"] == pytest.approx(np.percentile([v for _, v in rows], 50))


# ---- withheld classes and reports ------------------------------------------------------------------------------


def test_open_set_tables(spark):
    _, p = scored_rows()
    scored = table(spark, [-1] * len(p), p)
    spread = {r["y_pred"]: r for r in metrics.open_set_distribution(scored, 4).collect()}
    counted = np.bincount(p.argmax(axis=1), minlength=4)
    assert [spread[c]["rows"] for c in range(4)] == list(counted)
    assert sum(r["share"] for r in spread.values()) == pytest.approx(1)
    row = metrics.open_set_confidence(scored, N).first()
    q = p.astype(float)
    assert row["mean_max_probability"] == pytest.approx(q.max(axis=1).mean())
    assert row["mean_entropy"] == pytest.approx(-(q * np.log(np.clip(q, 1e-12, None))).sum(axis=1).mean())
    assert row["maximum_entropy"] == pytest.approx(math.log(N))
    assert row["dominant_class"] == counted.argmax()


def test_mixed_tables_are_refused(spark):
    y, p = scored_rows()
    y = np.where(np.arange(len(y)) < 5, -1, y)
    with pytest.raises(ValueError):
        metrics.mixed_open_set(table(spark, y, p), fail=True)
    with pytest.raises(ValueError):
        report_tables(table(spark, y, p), N)
    with pytest.raises(ValueError):
        metrics.validation_scores(table(spark, y, p, split="validation"), N)


def test_validation_scores_ignore_other_splits(spark):
    y, p = scored_rows()
    z, q = scored_rows(seed=8)
    rows = table(spark, y, p, split="validation").unionByName(table(spark, z, q, split="test"))
    got = metrics.validation_scores(rows, N).orderBy("class").collect()
    assert np.allclose([r["recall"] for r in got], brute(y, p)[2])
    assert got[0]["macro_f1"] == pytest.approx(brute(y, p)[3].mean()) and got[0]["rows_scored"] == 90


def test_report_is_repeatable(spark, folder):
    y, p = scored_rows()
    scored = table(spark, y, p)
    names = spark.createDataFrame([(0, "low"), (1, "mid"), (2, "high")], "class int, name string")
    first, second = (
        report_tables(scored.repartition(k), N, names) for k in (1, 5)
    )
    assert set(first) == {
        "per_class_metrics", "confusion_matrix", "confusion_normalized", "classification_report",
        "summary_metrics", "roc_curve", "roc_macro_curve", "pr_curve",
    }
    for name in first:
        assert first[name].count() == second[name].count()
    one, two = (t["summary_metrics"].first().asDict() for t in (first, second))
    assert one == pytest.approx(two, abs=1e-12)
    assert [r["name"] for r in first["per_class_metrics"].collect()] == ["low", "mid", "high"]
    write_report(first, folder)
    back = spark.read.option("header", True).csv(f"{folder}/confusion_matrix")
    assert back.count() == 9
    opened = report_tables(table(spark, [-1] * len(p), p), N, names)
    assert set(opened) == {"open_set_distribution", "open_set_confidence"}


def test_classification_report_lines(spark):
    y, p = scored_rows()
    lines = {r["name"]: r for r in metrics.classification_report(metrics.per_class_metrics(table(spark, y, p), N)).collect()}
    support, _, recall, f1, m = brute(y, p)
    assert lines["accuracy"]["f1"] == pytest.approx(np.trace(m) / m.sum())
    assert lines["macro avg"]["recall"] == pytest.approx(recall.mean())
    assert lines["weighted avg"]["f1"] == pytest.approx((f1 * support).sum() / support.sum())
    assert lines["0"]["support"] == 30


def split_scores(spark, opened=0):
    rows = [(i, "validation" if i % 3 else "test", i % 4 % 3, [0.6, 0.3, 0.1] if i % 5 else [0.1, 0.2, 0.7]) for i in range(400)]
    rows += [(1000 + i, "test", -1, [0.5, 0.3, 0.2]) for i in range(opened)]
    return spark.createDataFrame(rows, "row long, split string, y_true int, y_prob array<float>")


def test_validation_scores_of_a_sample(spark):
    scored = split_scores(spark)
    whole = metrics.validation_scores(scored, 3).collect()
    held = scored.where("split = 'validation'").count()
    assert {(r["rows_scored"], r["rows_available"]) for r in whole} == {(held, held)}
    sample = metrics.validation_scores(scored, 3, maximum_rows=50, seed=4, identity=F.col("row")).collect()
    assert {(r["rows_scored"], r["rows_available"]) for r in sample} == {(50, held)}
    again = metrics.validation_scores(scored.repartition(7), 3, maximum_rows=50, seed=4, identity=F.col("row")).collect()
    assert sorted(sample) == sorted(again) and min(r["support"] for r in sample) >= 1
    with pytest.raises(ValueError, match="identity"):
        metrics.validation_scores(scored, 3, maximum_rows=50)


def test_monitored_sets(spark):
    scored = split_scores(spark)
    got = metrics.monitor_set(scored, 40, F.col("row"), name="otherday").collect()
    assert len(got) == 40 and {r["eval_set"] for r in got} == {"otherday"} and {r["split"] for r in got} == {"test"}
    for wrong in ({"name": "val"}, {"name": ""}, {"split": "holdout"}, {"maximum_rows": 0}):
        with pytest.raises(ValueError):
            metrics.monitor_set(scored, **{"maximum_rows": 40, "identity": F.col("row"), **wrong})
    with pytest.raises(ValueError, match="open-set"):
        metrics.monitor_set(split_scores(spark, opened=3), 40, F.col("row"))
    assert metrics.monitor_set(split_scores(spark, opened=3), 40, F.col("row"), split="validation").count() == 40
