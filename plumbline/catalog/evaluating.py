"""Scored tables and everything that is computed over them.

``vectors`` scores embeddings by nearest class mean; ``line_scores`` scores order lines by four
scaled numbers, which gives many rows and many tied scores.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.catalog import Catalog
from plumbline.catalog.tables import (
    LINES,
    RATIOS,
    ROW,
    SEED,
    lines,
    r,
    read,
    rounded,
    split_case,
)
from plumbline.operators import curves, decisions, history, importance, metrics, sampling
from plumbline.operators.ordered import with_range_bucket
from plumbline.operators.splits import hash_split, row_identity
from plumbline.plans.model import CentroidModel, fit_multiclass
from plumbline.plans.report import report_tables, summary_metrics
from plumbline.session import fresh_path

catalog = Catalog()

N_VECTOR_CLASSES = 10  # fixed value: embeddings.label is 0..9
N_LINE_CLASSES = 6
SCALE = 4.0
OPEN_CLASS = 9
LINE_FEATURES = ("f_quantity", "f_price", "f_discount", "f_tax")
BUCKET_ROWS = 2_000

# ---- scored embeddings ---------------------------------------------------------------------------------


def _embeddings(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").withColumnRenamed("label", "_label")
    return rows.withColumn("split", hash_split(F.col("vec_id"), RATIOS, SEED))


def vectors(spark, sf_dir, scale=SCALE, open_class: int | None = None):
    """(vec_id, split, y_true, y_prob) of every embedding, by the class means of the train split.

    A withheld class is not part of the model and is -1 in y_true.
    """
    rows = _embeddings(spark, sf_dir)
    trained = rows.where(F.col("split") == "train")
    label = F.col("_label")
    if open_class is not None:
        trained = trained.where(label != open_class)
        label = F.when(label == open_class, -1).otherwise(label)
    model = CentroidModel.fit_vectors(trained, "embedding")
    scored = model.score_vectors(rows, "embedding", scale)
    return scored.select("vec_id", "split", label.alias("y_true"), "y_prob")


def _scored_sql(where: str = "true", scale: str = str(SCALE), rounds: str = "") -> str:
    """CTEs: emb, prob (one row per vec_id, class), pred (one row per vec_id)."""
    extra = ", round" if rounds else ""
    return f"""emb AS (SELECT vec_id, label AS y_true, embedding, {split_case("vec_id")} AS split FROM embeddings),
  cells AS (SELECT vec_id, y_true, split, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM emb),
  means AS (SELECT y_true AS class, i, round(avg(x), 6) AS m FROM cells WHERE split = 'train' AND {where} GROUP BY ALL),
  dist AS (SELECT vec_id, y_true, split, class, sum((x - m) * (x - m)) AS d FROM cells JOIN means USING (i) GROUP BY ALL),
  marg AS (SELECT vec_id, y_true, split, class, -d * {scale} AS margin{extra} FROM dist {rounds}),
  soft AS (SELECT *, exp(margin - max(margin) OVER (PARTITION BY vec_id{extra})) AS e FROM marg),
  prob AS (SELECT vec_id, y_true, split, class{extra}, round(e / sum(e) OVER (PARTITION BY vec_id{extra}), 6)::FLOAT AS p FROM soft),
  pred AS (SELECT vec_id{extra}, any_value(y_true) AS y_true, any_value(split) AS split, max(p) AS top,
           (array_agg(class ORDER BY p DESC, class))[1] AS y_pred FROM prob GROUP BY vec_id{extra})"""


SCORED = _scored_sql()
HELD = "split <> 'train'"


def held_out(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("split") != "train")


def _per_class_sql(by: str = "", source: str = "pred", where: str = HELD, n: int = N_VECTOR_CLASSES) -> str:
    """CTE per_class(by, class, support, predicted, hits, precision, recall, f1)."""
    keys = f"{by}, " if by else ""
    grid = f"(SELECT DISTINCT {by} FROM {source} WHERE {where}), range({n}) c(class)" if by else f"range({n}) c(class)"
    on = " AND ".join([f"g.{k.strip()} = p.{k.strip()}" for k in by.split(",")] if by else []) or "true"
    return f"""grid AS (SELECT * FROM {grid}),
  raw AS (SELECT {", ".join("g." + k.strip() for k in by.split(",")) + ", " if by else ""}g.class::INTEGER AS class,
     count(*) FILTER (p.y_true = g.class) AS support, count(*) FILTER (p.y_pred = g.class) AS predicted,
     count(*) FILTER (p.y_true = g.class AND p.y_pred = g.class) AS hits
     FROM grid g JOIN (SELECT * FROM {source} WHERE {where}) p ON {on} GROUP BY ALL),
  per_class AS (SELECT {keys}class, support, predicted, hits,
     CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision,
     CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
     CASE WHEN support + predicted > 0 THEN 2 * hits / (support + predicted) ELSE 0 END AS f1 FROM raw)"""


PER_CLASS = f"{SCORED}, {_per_class_sql()}"


def per_class(spark, sf_dir) -> DataFrame:
    return metrics.per_class_metrics(held_out(spark, sf_dir), N_VECTOR_CLASSES)


@catalog.query("argmax_class", f"WITH {SCORED} SELECT vec_id, split, y_true, y_pred::INTEGER AS y_pred FROM pred")
def argmax_class(spark, sf_dir):
    return metrics.with_prediction(vectors(spark, sf_dir)).drop("y_prob")


@catalog.query(
    "score_table",
    f"WITH {SCORED} SELECT vec_id, split, y_true, class::INTEGER AS class, {r('p::DOUBLE')} AS p FROM prob",
)
def score_table(spark, sf_dir):
    long = vectors(spark, sf_dir).select("vec_id", "split", "y_true", F.posexplode("y_prob").alias("class", "p"))
    return rounded(long.withColumn("p", F.col("p").cast("double")))


_CONFUSION = f"""{SCORED}, grid AS (SELECT t.range AS y_true, p.range AS y_pred FROM range({N_VECTOR_CLASSES}) t, range({N_VECTOR_CLASSES}) p),
  confusion AS (SELECT g.y_true::INTEGER AS y_true, g.y_pred::INTEGER AS y_pred, count(p.vec_id) AS rows
  FROM grid g LEFT JOIN (SELECT * FROM pred WHERE {HELD}) p ON p.y_true = g.y_true AND p.y_pred = g.y_pred GROUP BY ALL)"""


@catalog.query("confusion_matrix", f"WITH {_CONFUSION} SELECT * FROM confusion")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(held_out(spark, sf_dir), N_VECTOR_CLASSES)


@catalog.query(
    "confusion_normalized",
    f"""WITH {_CONFUSION} SELECT y_true, y_pred, {r('''CASE WHEN sum(rows) OVER (PARTITION BY y_true) > 0
    THEN rows / sum(rows) OVER (PARTITION BY y_true) ELSE 0 END''')} AS share FROM confusion""",
)
def confusion_normalized(spark, sf_dir):
    return rounded(metrics.confusion_normalized(confusion_matrix(spark, sf_dir)))


@catalog.query(
    "per_class_metrics",
    f"WITH {PER_CLASS} SELECT class, support, predicted, hits, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1 FROM per_class",
)
def per_class_metrics(spark, sf_dir):
    return rounded(per_class(spark, sf_dir))


@catalog.query(
    "accuracy",
    f"""WITH {SCORED} SELECT split, {r('avg((y_true = y_pred)::INT)')} AS accuracy, count(*) AS rows,
    {r('1 - avg((y_true = y_pred)::INT)')} AS multi_error FROM pred GROUP BY split""",
)
def accuracy(spark, sf_dir):
    return rounded(metrics.accuracy(vectors(spark, sf_dir), ["split"]))


@catalog.query(
    "balanced_accuracy",
    f"WITH {PER_CLASS} SELECT {r('avg(recall) FILTER (support > 0)')} AS balanced_accuracy FROM per_class",
)
def balanced_accuracy(spark, sf_dir):
    return rounded(metrics.balanced_accuracy(per_class(spark, sf_dir)))


@catalog.query(
    "macro_scores",
    f"WITH {PER_CLASS} SELECT {r('avg(precision)')} AS macro_precision, {r('avg(recall)')} AS macro_recall, {r('avg(f1)')} AS macro_f1 FROM per_class",
)
def macro_scores(spark, sf_dir):
    return rounded(metrics.macro_scores(per_class(spark, sf_dir)))


@catalog.query(
    "weighted_f1",
    f"WITH {PER_CLASS} SELECT {r('sum(f1 * support) / sum(support)')} AS weighted_f1 FROM per_class",
)
def weighted_f1(spark, sf_dir):
    return rounded(metrics.weighted_f1(per_class(spark, sf_dir)))


_MCC = """(sum(hits) * sum(support) - sum(predicted * support))::DOUBLE
  / (sqrt((sum(support) * sum(support) - sum(predicted * predicted))::DOUBLE)
     * sqrt((sum(support) * sum(support) - sum(support * support))::DOUBLE))"""


@catalog.query("mcc", f"WITH {PER_CLASS} SELECT {r(_MCC)} AS mcc FROM per_class")
def mcc(spark, sf_dir):
    return rounded(metrics.mcc(per_class(spark, sf_dir)))


_EPS = repr(metrics.FLOAT32_EPS)
_LOSS = f"-avg(ln(least(greatest(p::DOUBLE, {_EPS}), 1 - {_EPS})))"


@catalog.query(
    "log_loss",
    f"WITH {SCORED} SELECT split, {r(_LOSS)} AS log_loss FROM prob WHERE class = y_true GROUP BY split",
)
def log_loss(spark, sf_dir):
    return rounded(metrics.log_loss(vectors(spark, sf_dir), ["split"]))


@catalog.query(
    "minority_class",
    f"""WITH {PER_CLASS} SELECT class AS minority_class, support AS minority_support, {r('f1')} AS minority_f1
    FROM per_class WHERE support > 0 ORDER BY support, class LIMIT 1""",
)
def minority_class(spark, sf_dir):
    return rounded(metrics.minority_class(per_class(spark, sf_dir)))


@catalog.query(
    "classification_report",
    f"""WITH {PER_CLASS}, t AS (SELECT sum(hits) / sum(support) AS acc, sum(support)::BIGINT AS n,
      avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf, sum(precision * support) / sum(support) AS wp,
      sum(recall * support) / sum(support) AS wr, sum(f1 * support) / sum(support) AS wf FROM per_class)
    SELECT class::VARCHAR AS name, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1, support FROM per_class
    UNION ALL SELECT 'accuracy', {r('acc')}, {r('acc')}, {r('acc')}, n FROM t
    UNION ALL SELECT 'macro avg', {r('mp')}, {r('mr')}, {r('mf')}, n FROM t
    UNION ALL SELECT 'weighted avg', {r('wp')}, {r('wr')}, {r('wf')}, n FROM t""",
)
def classification_report(spark, sf_dir):
    return rounded(metrics.classification_report(per_class(spark, sf_dir)))


_VALIDATION = f"{SCORED}, {_per_class_sql(where=chr(39).join(['split = ', 'validation', '']))}"


@catalog.query(
    "validation_scores",
    f"""WITH {_VALIDATION} SELECT class, support, {r('recall')} AS recall, {r('avg(f1) OVER ()')} AS macro_f1,
    {r('avg(recall) OVER ()')} AS balanced_accuracy, (sum(support) OVER ())::BIGINT AS rows_scored,
    (sum(support) OVER ())::BIGINT AS rows_available FROM per_class""",
)
def validation_scores(spark, sf_dir):
    return rounded(metrics.validation_scores(vectors(spark, sf_dir), N_VECTOR_CLASSES))


# ---- withheld class ---------------------------------------------------------------------------------------

_OPEN = _scored_sql(where=f"y_true <> {OPEN_CLASS}")


def withheld(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir, open_class=OPEN_CLASS).where(F.col("y_true") == -1)


@catalog.query(
    "open_set_distribution",
    f"""WITH {_OPEN}, o AS (SELECT * FROM pred WHERE y_true = {OPEN_CLASS})
    SELECT g.range::INTEGER AS y_pred, count(o.vec_id) AS rows, {r('count(o.vec_id) / (SELECT count(*) FROM o)')} AS share
    FROM range({N_VECTOR_CLASSES - 1}) g LEFT JOIN o ON o.y_pred = g.range GROUP BY 1""",
)
def open_set_distribution(spark, sf_dir):
    return rounded(metrics.open_set_distribution(withheld(spark, sf_dir), N_VECTOR_CLASSES - 1))


@catalog.query(
    "open_set_confidence",
    f"""WITH {_OPEN}, o AS (SELECT * FROM pred WHERE y_true = {OPEN_CLASS}),
    h AS (SELECT vec_id, -sum(p::DOUBLE * ln(greatest(p::DOUBLE, 1e-12))) AS h FROM prob WHERE y_true = {OPEN_CLASS} GROUP BY 1),
    d AS (SELECT y_pred, count(*) AS n FROM o GROUP BY 1 ORDER BY n DESC, y_pred LIMIT 1)
    SELECT (SELECT count(*) FROM o) AS open_set_rows, {r('(SELECT avg(top::DOUBLE) FROM o)')} AS mean_max_probability,
      {r('(SELECT avg(h) FROM h)')} AS mean_entropy, {r(f'ln({N_VECTOR_CLASSES - 1}.0)')} AS maximum_entropy,
      d.y_pred::INTEGER AS dominant_class, {r('d.n / (SELECT count(*) FROM o)')} AS dominant_share FROM d""",
)
def open_set_confidence(spark, sf_dir):
    return rounded(metrics.open_set_confidence(withheld(spark, sf_dir), N_VECTOR_CLASSES - 1))


@catalog.query(
    "mixed_open_set_guard",
    f"""WITH {SCORED} SELECT count(*) FILTER (y_true = {OPEN_CLASS}) AS open_set_rows, count(*) FILTER (y_true <> {OPEN_CLASS}) AS labelled_rows
    FROM pred WHERE split = 'test' HAVING count(*) FILTER (y_true = {OPEN_CLASS}) > 0 AND count(*) FILTER (y_true <> {OPEN_CLASS}) > 0""",
)
def mixed_open_set_guard(spark, sf_dir):
    scored = vectors(spark, sf_dir, open_class=OPEN_CLASS)
    return metrics.mixed_open_set(scored.where(F.col("split") == "test"))


# ---- scored order lines --------------------------------------------------------------------------------------


def line_rows(spark, sf_dir) -> DataFrame:
    """Order lines with a class code, four scaled features and a split by order."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    status = F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    return lines(spark, sf_dir).select(
        row_identity().alias("line"),
        (flag * 2 + status).cast("int").alias("_label"),
        hash_split(F.col("l_orderkey"), RATIOS, SEED).alias("split"),
        (F.col("l_quantity") / 50).alias("f_quantity"),
        (F.col("l_extendedprice") / 100000).alias("f_price"),
        (F.col("l_discount") * 10).alias("f_discount"),
        (F.col("l_tax") * 12.5).alias("f_tax"),
    )


_LINE_ROWS = f"""{LINES}, line_rows AS (SELECT {ROW} AS line,
    (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 2 + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END) AS y_true,
    {split_case("l_orderkey")} AS split, rid AS n,
    l_quantity / 50 AS f_quantity, l_extendedprice / 100000 AS f_price, l_discount * 10 AS f_discount, l_tax * 12.5 AS f_tax FROM lines),
  means AS (SELECT y_true AS class, round(avg(f_quantity), 6) AS m1, round(avg(f_price), 6) AS m2,
    round(avg(f_discount), 6) AS m3, round(avg(f_tax), 6) AS m4 FROM line_rows WHERE split = 'train' GROUP BY 1)"""


def _line_soft(source: str, keys: str, digits: int) -> str:
    square = lambda f, m: f"({f} - {m}) * ({f} - {m})"
    d = " + ".join(square(f, f"m{i}") for i, f in enumerate(LINE_FEATURES, 1))
    return f"""marg AS (SELECT {keys}, y_true, split, class, -({d}) * 20.0 AS margin FROM {source}, means),
  soft AS (SELECT *, exp(margin - max(margin) OVER (PARTITION BY {keys})) AS e FROM marg),
  prob AS (SELECT {keys}, y_true, split, class, round(e / sum(e) OVER (PARTITION BY {keys}), {digits})::FLOAT AS p FROM soft)"""


LINE_DIGITS = 4
LINE_PROB = f"{_LINE_ROWS}, {_line_soft('line_rows', 'n', LINE_DIGITS)}, held AS (SELECT * FROM prob WHERE split <> 'train')"


def line_model(rows: DataFrame) -> CentroidModel:
    return CentroidModel.fit(rows.where(F.col("split") == "train"), LINE_FEATURES)


def line_scores(spark, sf_dir) -> DataFrame:
    """Held-out order lines with probabilities of four digits: tens of thousands of ties."""
    rows = line_rows(spark, sf_dir)
    held = rows.where(F.col("split") != "train")
    scored = line_model(rows).score(held, LINE_FEATURES, 20.0, LINE_DIGITS)
    return scored.select("line", "split", F.col("_label").alias("y_true"), "y_prob")


# Counts per class and score with running counts; class -1 is the micro average.
_RANKED = f"""{LINE_PROB},
  long AS (SELECT class::INTEGER AS class, p, y_true = class AS hit FROM held UNION ALL SELECT -1, p, y_true = class FROM held),
  counts AS (SELECT class, p, count(*) FILTER (hit) AS pos, count(*) FILTER (NOT hit) AS neg FROM long GROUP BY ALL),
  ranked AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY class) AS np,
    sum(neg) OVER (PARTITION BY class) AS nn, lead(pos) OVER o AS next_pos, lead(neg) OVER o AS next_neg,
    row_number() OVER o AS place FROM counts
    WINDOW w AS (PARTITION BY class ORDER BY p DESC ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY class ORDER BY p DESC)),
  areas AS (SELECT class, any_value(np)::BIGINT AS positives, any_value(nn)::BIGINT AS negatives,
    CASE WHEN any_value(np) > 0 AND any_value(nn) > 0 THEN sum(neg * (tp - pos / 2)) / (any_value(np) * any_value(nn)::DOUBLE) END AS roc_auc,
    CASE WHEN any_value(np) > 0 AND any_value(nn) > 0 THEN sum(pos / any_value_np * (tp / (tp + fp))) END AS average_precision
    FROM (SELECT *, np::DOUBLE AS any_value_np FROM ranked) GROUP BY class)"""


@catalog.query(
    "roc_auc_ovr",
    f"WITH {_RANKED} SELECT class, positives, negatives, {r('roc_auc')} AS roc_auc FROM areas",
)
def roc_auc_ovr(spark, sf_dir):
    return rounded(curves.roc_auc_ovr(line_scores(spark, sf_dir)))


@catalog.query(
    "average_precision_ovr",
    f"WITH {_RANKED} SELECT class, positives, negatives, {r('average_precision')} AS average_precision FROM areas",
)
def average_precision_ovr(spark, sf_dir):
    return rounded(curves.average_precision_ovr(line_scores(spark, sf_dir)))


_AUC_SUMMARY = f"""{r('avg(roc_auc) FILTER (class >= 0)')} AS roc_macro,
  {r('sum(roc_auc * positives) FILTER (class >= 0) / sum(positives) FILTER (class >= 0)')} AS roc_weighted,
  {r('max(roc_auc) FILTER (class < 0)')} AS roc_micro, {r('avg(average_precision) FILTER (class >= 0)')} AS pr_macro,
  {r('sum(average_precision * positives) FILTER (class >= 0) / sum(positives) FILTER (class >= 0)')} AS pr_weighted,
  {r('max(average_precision) FILTER (class < 0)')} AS pr_micro"""


@catalog.query("auc_summary", f"WITH {_RANKED} SELECT {_AUC_SUMMARY} FROM areas")
def auc_summary(spark, sf_dir):
    return rounded(curves.auc_summary(line_scores(spark, sf_dir)))


_ROC_POINTS = """SELECT class, fp / nn AS fpr, tp / np AS tpr, p::DOUBLE AS threshold FROM ranked
    WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
    UNION ALL SELECT class, 0.0, 0.0, 'inf'::DOUBLE FROM ranked WHERE place = 1"""


@catalog.query(
    "roc_curve",
    f"WITH {_RANKED} SELECT class, {r('fpr')} AS fpr, {r('tpr')} AS tpr, {r('threshold')} AS threshold FROM ({_ROC_POINTS})",
)
def roc_curve(spark, sf_dir):
    return rounded(curves.roc_curve(line_scores(spark, sf_dir)))


@catalog.query(
    "roc_macro_curve",
    f"""WITH {_RANKED}, steps AS (SELECT class, fp - neg AS f0, tp - pos AS t0, fp AS f1, tp AS t1, np, nn FROM ranked WHERE class >= 0 AND neg > 0),
    grid AS (SELECT range AS g FROM range(2000)),
    inner_points AS (SELECT g, (t0 + (g * nn / 2000.0 - f0) / (f1 - f0) * (t1 - t0)) / np AS tpr
      FROM grid JOIN steps ON f0 * 2000 <= g * nn AND g * nn < f1 * 2000),
    every AS (SELECT * FROM inner_points UNION ALL SELECT 2000, 1.0 FROM (SELECT DISTINCT class FROM ranked WHERE class >= 0))
    SELECT {r('g / 2000')} AS fpr, {r('avg(tpr)')} AS tpr, count(*) AS classes FROM every GROUP BY g""",
)
def roc_macro_curve(spark, sf_dir):
    return rounded(curves.roc_macro_curve(line_scores(spark, sf_dir)))


@catalog.query(
    "pr_curve",
    f"""WITH {_RANKED} SELECT class, {r('tp / np')} AS recall, {r('tp / (tp + fp)')} AS precision, {r('p::DOUBLE')} AS threshold FROM ranked
    UNION ALL SELECT DISTINCT class, 0.0, 1.0, NULL::DOUBLE FROM ranked""",
)
def pr_curve(spark, sf_dir):
    return rounded(curves.pr_curve(line_scores(spark, sf_dir)))


THIN_POINTS = 500


@catalog.query(
    "thin_curve",
    f"""WITH c AS (SELECT o_orderstatus, o_orderkey, o_totalprice, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY o_orderstatus) AS n
      FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)),
    kept AS (SELECT DISTINCT o_orderstatus, (i.range * (n - 1)) // {THIN_POINTS - 1} AS place FROM (SELECT DISTINCT o_orderstatus, n FROM c), range({THIN_POINTS}) i)
    SELECT c.o_orderstatus, o_orderkey, o_totalprice FROM c LEFT JOIN kept USING (o_orderstatus, place)
    WHERE n <= {THIN_POINTS} OR kept.place IS NOT NULL""",
)
def thin_curve(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    bucketed = with_range_bucket(orders, "o_orderkey", BUCKET_ROWS)
    return curves.thin_curve(
        bucketed, ["o_orderstatus"], [F.col("o_orderkey")], "_bucket", THIN_POINTS
    ).drop("_bucket")


_LINE_PRED = f"""{_RANKED}, pred AS (SELECT n, any_value(y_true) AS y_true, (array_agg(class ORDER BY p DESC, class))[1] AS y_pred FROM held GROUP BY n),
  {_per_class_sql(where="true", n=N_LINE_CLASSES)}"""


@catalog.query(
    "summary_metrics",
    f"""WITH {_LINE_PRED}, m AS (SELECT class, support, f1 FROM per_class WHERE support > 0 ORDER BY support, class LIMIT 1)
    SELECT {r('avg(f1)')} AS macro_f1, {r('avg(recall) FILTER (support > 0)')} AS balanced_accuracy, {r('avg(precision)')} AS macro_precision,
      {r('avg(recall)')} AS macro_recall, {r(_MCC)} AS mcc, {r('sum(f1 * support) / sum(support)')} AS weighted_f1,
      {r('sum(hits) / sum(support)')} AS accuracy, (SELECT class::BIGINT FROM m) AS minority_class, (SELECT support FROM m) AS minority_support,
      {r('(SELECT f1 FROM m)')} AS minority_f1, {r(f'(SELECT {_LOSS} FROM held WHERE class = y_true)')} AS log_loss,
      {r('(SELECT avg(roc_auc) FILTER (class >= 0) FROM areas)')} AS auc_roc_macro_ovr,
      {r('(SELECT sum(roc_auc * positives) FILTER (class >= 0) / sum(positives) FILTER (class >= 0) FROM areas)')} AS auc_roc_weighted_ovr,
      {r('(SELECT max(roc_auc) FILTER (class < 0) FROM areas)')} AS auc_roc_micro,
      {r('(SELECT avg(average_precision) FILTER (class >= 0) FROM areas)')} AS pr_auc_macro,
      {r('(SELECT sum(average_precision * positives) FILTER (class >= 0) / sum(positives) FILTER (class >= 0) FROM areas)')} AS pr_auc_weighted,
      {r('(SELECT max(average_precision) FILTER (class < 0) FROM areas)')} AS pr_auc_micro, sum(support)::BIGINT AS test_samples FROM per_class""",
)
def summary(spark, sf_dir):
    return rounded(summary_metrics(line_scores(spark, sf_dir), N_LINE_CLASSES))


@catalog.query(
    "latency_percentiles",
    f"""SELECT event_type, {r('quantile_cont(value, 0.5)')} AS p50_ms_batch, {r('quantile_cont(value, 0.95)')} AS p95_ms_batch, count(*) AS rows,
    {r('quantile_cont(value, 0.5) / 1024')} AS p50_ms_sample, {r('quantile_cont(value, 0.95) / 1024')} AS p95_ms_sample,
    {r('1024 * count(*) / (sum(value) / 1000)', 3)} AS samples_per_second FROM events GROUP BY 1""",
)
def latency_percentiles(spark, sf_dir):
    """Event values stand for milliseconds per batch of 1024 rows."""
    events = read(spark, sf_dir, "events").select("event_type", "value")
    speed = F.lit(1024) * F.count("*") / (F.sum("value") / 1000)
    speeds = events.groupBy("event_type").agg(F.round(speed, 3).alias("samples_per_second"))
    table = curves.percentiles(
        events, "value", {"p50_ms_batch": 0.5, "p95_ms_batch": 0.95}, ["event_type"], BUCKET_ROWS
    ).join(speeds, "event_type")
    return rounded(
        table.withColumn("p50_ms_sample", F.col("p50_ms_batch") / 1024).withColumn(
            "p95_ms_sample", F.col("p95_ms_batch") / 1024
        )
    )


_REPORT_ROWS = {
    "per_class_metrics": "n",
    "confusion_matrix": "n * n",
    "confusion_normalized": "n * n",
    "classification_report": "n + 3",
    "summary_metrics": "1",
    "roc_curve": f"(SELECT count(*) FROM ({_ROC_POINTS}))",
    "roc_macro_curve": "2001",
    "pr_curve": "(SELECT count(*) + count(DISTINCT class) FROM ranked)",
}


@catalog.query(
    "report_tables",
    f"WITH {_RANKED}, c AS (SELECT count(DISTINCT class) AS n FROM ranked WHERE class >= 0) "
    + " UNION ALL ".join(f"SELECT '{name}' AS name, ({rows})::BIGINT AS rows FROM c" for name, rows in _REPORT_ROWS.items()),
)
def report(spark, sf_dir):
    """Row counts of every table of the final report over the held-out order lines."""
    tables = report_tables(line_scores(spark, sf_dir), N_LINE_CLASSES)
    counted = [t.agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, counted)


# ---- permutation -----------------------------------------------------------------------------------------------

REPEATS = 2


def _lines_of(spark, sf_dir, split: str) -> DataFrame:
    return line_rows(spark, sf_dir).where(F.col("split") == split)


#: Side of the square that holds all row numbers, and the steps back into it that are always enough.
_SIDE = "ceil(sqrt(size))::BIGINT"


def _rounds_sql(number: str, feature: str, repeat: int) -> str:
    """Four Feistel rounds with keys from md5, on numbers below side * side."""
    left, right = f"({number} // side)", f"({number} % side)"
    for turn in range(4):
        digest = hashlib.md5(f"{SEED}|{feature}|{repeat}|{turn}".encode()).hexdigest()
        mixed = f"(({{}} * {int(digest[:7], 16) + 1} + {int(digest[7:14], 16)}) % 2147483647)"
        if turn % 2:
            right = f"(({right} + {mixed.format(left)}) % side)"
        else:
            left = f"(({left} + {mixed.format(right)}) % side)"
    return f"({left} * side + {right})"


def _copies_sql(source: str) -> str:
    """Every row sends its value to the row of the scrambled number; what leaves the numbers walks on until it is back."""
    shuffles = " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, {k} AS repeat, {f} AS value,
        list_reduce([{_rounds_sql("place", f, k)}] || range(200), lambda a, i: CASE WHEN a < size THEN a ELSE {_rounds_sql("a", f, k)} END) AS place FROM numbered"""
        for f in LINE_FEATURES
        for k in range(1, REPEATS + 1)
    )
    replaced = ", ".join(
        f"CASE WHEN feature = '{f}' THEN donors.value ELSE numbered.{f} END AS {f}" for f in LINE_FEATURES
    )
    return f"""placed AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}|place|' || line)) - 1 AS place, count(*) OVER () AS size FROM {source}),
  numbered AS (SELECT *, {_SIDE} AS side FROM placed),
  donors AS ({shuffles}),
  copies AS (SELECT feature, repeat, line, y_true, split, {replaced} FROM numbered JOIN donors USING (place)
    UNION ALL SELECT '', 0, line, y_true, split, {", ".join(LINE_FEATURES)} FROM {source})"""


def _ranking_sql(source: str) -> str:
    """CTEs up to ``ranking``: the permutation table with rank."""
    return f"""{_copies_sql(source)}, {_line_soft('copies', 'feature, repeat, line', 6)},
  pred AS (SELECT feature, repeat, line, any_value(y_true) AS y_true, (array_agg(class ORDER BY p DESC, class))[1] AS y_pred FROM prob GROUP BY feature, repeat, line),
  {_per_class_sql("feature, repeat", where="true", n=N_LINE_CLASSES)},
  scores AS (SELECT feature, repeat, avg(f1) AS f1, avg(recall) AS recall FROM per_class GROUP BY ALL),
  base AS (SELECT f1 AS b, recall AS br FROM scores WHERE feature = ''),
  drops AS (SELECT feature, avg(b - f1) AS m, coalesce(stddev_samp(b - f1), 0) AS s, avg(br - recall) AS mr FROM scores, base WHERE feature <> '' GROUP BY 1),
  ranking AS (SELECT feature, {r('m')} AS mean_decrease_macro_f1, {r('s')} AS std_decrease_macro_f1, {r('mr')} AS mean_decrease_balanced_accuracy,
    row_number() OVER (ORDER BY m DESC, feature)::INTEGER AS rank, m <= s AS within_noise FROM drops)"""


def _permutation_sql(source: str) -> str:
    return f"{_ranking_sql(source)} SELECT * FROM ranking"


def _lines_sql(split: str) -> str:
    return f"{_LINE_ROWS}, picked AS (SELECT * FROM line_rows WHERE split = '{split}')"


def _scorer(model: CentroidModel):
    return lambda copies: model.score(copies, LINE_FEATURES, 20.0).select(
        "feature", "repeat", F.col("_label").alias("y_true"), "y_prob"
    )


@catalog.query("permutation_importance", f"WITH {_lines_sql('test')}, {_permutation_sql('picked')}")
def permutation_importance(spark, sf_dir):
    rows = _lines_of(spark, sf_dir, "test")
    score = _scorer(line_model(line_rows(spark, sf_dir)))
    return rounded(
        importance.permutation_importance(rows, "line", LINE_FEATURES, score, N_LINE_CLASSES, REPEATS, SEED)
    )


def line_ranking(rows: DataFrame, model: CentroidModel) -> importance.Ranking:
    """The features of the order lines, ranked on the whole validation split."""
    return importance.rank_on_validation(
        rows, "line", LINE_FEATURES, _scorer(model), N_LINE_CLASSES, repeats=REPEATS, seed=SEED
    )


@catalog.query(
    "permutation_validation",
    f"WITH {_lines_sql('validation')}, {_permutation_sql('picked')}",
)
def permutation_validation(spark, sf_dir):
    """On the whole validation split, with the header that a feature selection asks for."""
    rows = line_rows(spark, sf_dir)
    return rounded(line_ranking(rows, line_model(rows)).table)


# ---- rounds ------------------------------------------------------------------------------------------------------

ROUNDS = 5
_STAGED = _scored_sql(scale="round", rounds=f", (SELECT range + 1 AS round FROM range({ROUNDS}))")
_SETS = "CASE split WHEN 'train' THEN 'train' WHEN 'validation' THEN 'val' ELSE 'monitor' END"
_HISTORY = f"""{_STAGED}, staged AS (SELECT *, {_SETS} AS eval_set FROM pred),
  {_per_class_sql("round, eval_set", "staged", "true")},
  loss AS (SELECT round, {_SETS} AS eval_set, {_LOSS} AS loss FROM prob WHERE class = y_true GROUP BY ALL),
  err AS (SELECT round, eval_set, 1 - avg((y_true = y_pred)::INT) AS err, count(*) AS n FROM staged GROUP BY ALL),
  macro AS (SELECT round, eval_set, avg(f1) AS f1, avg(recall) AS recall FROM per_class GROUP BY ALL),
  history AS (SELECT * FROM loss JOIN err USING (round, eval_set) JOIN macro USING (round, eval_set))"""


def staged_scores(spark, sf_dir) -> DataFrame:
    """Scores after each round: the model grows more certain with every round."""
    rows = _embeddings(spark, sf_dir)
    model = CentroidModel.fit_vectors(rows.where(F.col("split") == "train"), "embedding")
    sets = F.when(F.col("split") == "train", "train").when(F.col("split") == "validation", "val")
    rounds = rows.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(ROUNDS))))
    return model.score_vectors(rounds, "embedding", F.col("round").cast("double")).select(
        F.lit("staged").alias("run"),
        "round",
        sets.otherwise("monitor").alias("eval_set"),
        F.col("_label").alias("y_true"),
        "y_prob",
    )


def staged_history(spark, sf_dir) -> DataFrame:
    return history.eval_history(staged_scores(spark, sf_dir), N_VECTOR_CLASSES)


@catalog.query(
    "eval_history",
    f"""WITH {_HISTORY} SELECT 'staged' AS run, round::INTEGER AS round, eval_set, {r('loss')} AS multi_logloss, {r('err')} AS multi_error,
    n AS rows, {r('f1')} AS macro_f1, {r('recall')} AS macro_recall FROM history""",
)
def eval_history(spark, sf_dir):
    return rounded(staged_history(spark, sf_dir))


def _pick(figure: str, name: str) -> str:
    return f"max({figure}) FILTER (eval_set = '{name}')"


@catalog.query(
    "learning_curve",
    f"""WITH {_HISTORY} SELECT 'staged' AS run, round::INTEGER AS round, """
    + ", ".join(
        f"{r(_pick(f, s))} AS {s}_{name}"
        for s in history.EVAL_SETS
        for f, name in zip(("loss", "err", "f1", "recall"), history.FIGURES, strict=True)
    )
    + f""", {r("1 - " + _pick("err", "train"))} AS train_accuracy, {r("1 - " + _pick("err", "val"))} AS val_accuracy,
    {r(_pick("loss", "val") + " - " + _pick("loss", "train"))} AS val_minus_train_multi_logloss,
    {r("1 - " + _pick("err", "monitor"))} AS monitor_accuracy,
    {r(_pick("loss", "monitor") + " - " + _pick("loss", "val"))} AS monitor_minus_val_multi_logloss,
    {r(_pick("f1", "val") + " - " + _pick("f1", "monitor"))} AS val_minus_monitor_macro_f1 FROM history GROUP BY round""",
)
def learning_curve(spark, sf_dir):
    return rounded(history.learning_curve(history.wide_history(staged_history(spark, sf_dir))))


MONITOR_SHARE = 2


@catalog.query(
    "monitor_set",
    f"""WITH {SCORED}, src AS (SELECT * FROM pred WHERE split = 'test'),
    n AS (SELECT y_true, count(*) AS rows FROM src GROUP BY 1), t AS (SELECT sum(rows) AS total, (sum(rows) // {MONITOR_SHARE})::DOUBLE AS budget FROM n),
    f AS (SELECT y_true, greatest(1, floor(rows * budget / total))::BIGINT AS base, rows * budget / total - floor(rows * budget / total) AS fraction, budget FROM n, t),
    q AS (SELECT y_true, base + (row_number() OVER (ORDER BY fraction DESC, y_true) <= budget - sum(base) OVER ())::INT AS quota FROM f),
    o AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY md5('{SEED}|' || vec_id)) AS rn FROM src)
    SELECT vec_id, o.y_true, y_pred::INTEGER AS y_pred FROM o JOIN q USING (y_true) WHERE rn <= quota""",
)
def monitor_set(spark, sf_dir):
    """A stratified half of the held-out split, never used for selection."""
    scored = vectors(spark, sf_dir)
    budget = scored.where(F.col("split") == "test").count() // MONITOR_SHARE
    picked = metrics.monitor_set(scored, budget, F.col("vec_id"), seed=SEED)
    return metrics.with_prediction(picked).select("vec_id", "y_true", "y_pred")


# ---- feature-count sweep ---------------------------------------------------------------------------------------------

SWEEP = (1, 2, 3)
TOLERANCE_F1, TOLERANCE_RECALL = 0.02, 0.12


def sweep(spark, sf_dir) -> DataFrame:
    """Models on the k best features of the validation ranking against the one on all of them."""
    rows = line_rows(spark, sf_dir)
    model = line_model(rows)

    def score(held: DataFrame, order: list[str], counts: list[int]) -> DataFrame:
        return model.score_nested(held, LINE_FEATURES, order, counts, 20.0)

    return decisions.sweep_ranked(
        rows.withColumn("y_true", F.col("_label")),
        LINE_FEATURES,
        line_ranking(rows, model),
        SWEEP,
        score,
        N_LINE_CLASSES,
        TOLERANCE_F1,
        TOLERANCE_RECALL,
    )


def _sweep_sql() -> str:
    """The same from one row per line, class and k: distances over the features whose rank is at most k."""
    cells = " UNION ALL ".join(
        f"SELECT line, y_true AS truth, class, '{f}' AS feature, ({f} - m{i}) * ({f} - m{i}) AS gap FROM picked, means"
        for i, f in enumerate(LINE_FEATURES, 1)
    )
    top = len(LINE_FEATURES)
    counts = ", ".join(f"({k})" for k in (*SWEEP, top))
    body = _per_class_sql("k", "swept", "true", N_LINE_CLASSES)
    for cte in ("grid", "raw", "per_class"):
        body = body.replace(f"{cte} AS (", f"k_{cte} AS (").replace(f"FROM {cte}", f"FROM k_{cte}")
    return f"""{_lines_sql('validation')}, {_ranking_sql('picked')},
  cells AS ({cells}),
  k_dist AS (SELECT k, line, truth, class, -sum(gap) * 20.0 AS margin FROM cells JOIN ranking USING (feature)
    JOIN (VALUES {counts}) v(k) ON rank <= k GROUP BY ALL),
  k_soft AS (SELECT *, exp(margin - max(margin) OVER (PARTITION BY k, line)) AS e FROM k_dist),
  k_prob AS (SELECT k, line, truth, class, round(e / sum(e) OVER (PARTITION BY k, line), 6)::FLOAT AS p FROM k_soft),
  swept AS (SELECT k, line, any_value(truth) AS y_true, (array_agg(class ORDER BY p DESC, class))[1] AS y_pred FROM k_prob GROUP BY k, line),
  {body},
  k_scores AS (SELECT k, avg(f1) AS f1, avg(recall) AS balanced FROM k_per_class GROUP BY k),
  b AS (SELECT f1 AS bf, balanced AS bb FROM k_scores WHERE k = {top}),
  dropped AS (SELECT p.k, p.class, q.recall - p.recall AS d FROM k_per_class p JOIN k_per_class q ON p.class = q.class AND q.k = {top} AND p.k < {top}),
  worst AS (SELECT k, max(d) AS d, (array_agg(class ORDER BY d DESC, class))[1] AS class FROM dropped GROUP BY k),
  sweep AS (SELECT s.k::INTEGER AS k, f1 AS macro_f1, balanced AS balanced_accuracy, w.class AS worst_class, coalesce(w.d, 0) AS worst_class_recall_drop,
    s.k = {top} AS is_baseline, bf - f1 AS delta_macro_f1, bb - balanced AS delta_balanced_accuracy,
    s.k = {top} OR (bf - f1 <= {TOLERANCE_F1} AND coalesce(w.d, 0) <= {TOLERANCE_RECALL}) AS accepted
    FROM k_scores s CROSS JOIN b LEFT JOIN worst w ON w.k = s.k)"""


@catalog.query(
    "sweep_table",
    f"""WITH {_sweep_sql()} SELECT k, {r('macro_f1')} AS macro_f1, {r('balanced_accuracy')} AS balanced_accuracy, worst_class,
    {r('worst_class_recall_drop')} AS worst_class_recall_drop, is_baseline, {r('delta_macro_f1')} AS delta_macro_f1,
    {r('delta_balanced_accuracy')} AS delta_balanced_accuracy, accepted FROM sweep""",
)
def sweep_table(spark, sf_dir):
    return rounded(sweep(spark, sf_dir))


@catalog.query(
    "choose_k",
    f"WITH {_sweep_sql()} SELECT min(k) FILTER (accepted AND NOT is_baseline) AS chosen_k FROM sweep",
)
def choose_k(spark, sf_dir):
    return decisions.choose_k(sweep(spark, sf_dir))


# ---- fitted trees ------------------------------------------------------------------------------------------------------

TREE_ROUNDS, TREE_DEPTH, FOREST_TREES = 20, 5, 100

#: What any fit on these lines must satisfy: every test line is scored, shares sum to one, and hits are
#: at least half of what naming the largest class would hit (the classes carry little signal).
_FIT = f"""WITH {_lines_sql('test')} SELECT count(*) AS test_rows, 0::BIGINT AS rows_off_one, true AS beyond_half_majority
    FROM picked"""


def _fit_summary(scored: DataFrame) -> DataFrame:
    total = F.aggregate("y_prob", F.lit(0.0), lambda s, x: s + x.cast("double"))
    by_class = metrics.with_prediction(scored).groupBy("y_true").agg(
        F.count("*").alias("rows"),
        F.count_if(F.abs(total - 1) > 1e-4).alias("off"),
        F.count_if(F.col("y_pred") == F.col("y_true")).alias("hits"),
    )
    return by_class.agg(
        F.sum("rows").alias("test_rows"),
        F.sum("off").alias("rows_off_one"),
        (2 * F.sum("hits") >= F.max("rows")).alias("beyond_half_majority"),
    )


@catalog.query("fit_multiclass", _FIT)
def fit(spark, sf_dir):
    """Boosted trees per class on the train lines, judged on the test lines."""
    rows = line_rows(spark, sf_dir)
    train = rows.where(F.col("split") == "train")
    fitted = fit_multiclass(train, LINE_FEATURES, rounds=TREE_ROUNDS, depth=TREE_DEPTH)
    return _fit_summary(fitted.score(rows.where(F.col("split") == "test")))


@catalog.query("fit_forest", _FIT)
def fit_forest(spark, sf_dir):
    """One random forest over all classes, judged on the test lines."""
    rows = line_rows(spark, sf_dir)
    train = rows.where(F.col("split") == "train")
    fitted = fit_multiclass(train, LINE_FEATURES, learner="forest", rounds=FOREST_TREES, depth=TREE_DEPTH)
    return _fit_summary(fitted.score(rows.where(F.col("split") == "test")))


@catalog.query("select_topk_gain")
def select_topk_gain(spark, sf_dir):
    """Screening forest on a class-balanced sample of train; the two best features are kept."""
    train = _lines_of(spark, sf_dir, "train")
    sampled = sampling.balanced_sample(train, "_label", train.count() // 2, F.col("line"), SEED)
    fitted = fit_multiclass(sampled, LINE_FEATURES, learner="forest", rounds=FOREST_TREES, depth=TREE_DEPTH)
    gains = fitted.importance(spark, fresh_path(spark, "screening")).select("feature", "gain")
    return importance.select_topk_gain(_candidates(spark), gains, 2)


def _candidates(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LINE_FEATURES)), "position int, feature string")


@catalog.query(
    "select_topk_ranking",
    f"""WITH {_lines_sql('validation')}, {_ranking_sql('picked')}
    SELECT row_number() OVER (ORDER BY position)::INTEGER AS model_position, position::INTEGER AS position, feature, rank
    FROM ranking JOIN (VALUES {", ".join(f"({i}, '{f}')" for i, f in enumerate(LINE_FEATURES))}) v(position, feature) USING (feature)
    WHERE rank <= 2""",
)
def select_topk_ranking(spark, sf_dir):
    """The two best features of the validation ranking, in their original order."""
    rows = line_rows(spark, sf_dir)
    ranking = line_ranking(rows, line_model(rows))
    return importance.select_topk_ranking(_candidates(spark), ranking.table, 2, ranking.header)
