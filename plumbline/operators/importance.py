"""Feature importance tables, ranks and permutation scores."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.checks import guard
from plumbline.functions.hashing import seeded_hash
from plumbline.functions.lookup import bounded_rows
from plumbline.operators.metrics import per_class_metrics
from plumbline.operators.ordered import ROWS_PER_BUCKET, positions
from plumbline.operators.sampling import stratified_sample
from plumbline.session import written

MAX_FEATURES = 100_000
TOP_RANK = 10
CONSENSUS = 3
RANKING_VERSION = 1
RANKING_SPLIT = "validation"
RANKING_SCHEMA = (
    "feature string, mean_decrease_macro_f1 double, std_decrease_macro_f1 double, "
    "mean_decrease_balanced_accuracy double, rank int, within_noise boolean"
)


def importance_table(
    values: DataFrame, value: str, short: str, cumulative: bool = False, top: int | None = None
) -> DataFrame:
    """One row per feature: value, percent of the total, rank, optionally cumulative percent.

    ``values`` has one row per feature of a model.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.desc(value), F.asc("feature"))
    total = F.sum(value).over(everything)
    percent = F.when(total > 0, F.col(value) / total * 100).otherwise(F.lit(0.0))
    table = values.withColumn(f"{short}_percent", percent).withColumn(
        f"rank_{short}", F.row_number().over(order)
    )
    if cumulative:
        upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        table = table.withColumn(
            f"cumulative_{short}_percent", F.sum(f"{short}_percent").over(upto)
        )
    return table if top is None else table.where(F.col(f"rank_{short}") <= top)


def importance_gain(values: DataFrame, value: str = "gain", top: int | None = None) -> DataFrame:
    return importance_table(values, value, "gain", cumulative=True, top=top)


def importance_split(values: DataFrame, value: str = "split_count") -> DataFrame:
    return importance_table(values, value, "split")


def importance_contrib(contributions: DataFrame, bias: str | None = None) -> DataFrame:
    """Mean |contribution| over rows and classes from a long (feature, contribution) table."""
    rows = contributions if bias is None else contributions.where(F.col("feature") != bias)
    mean = rows.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    return importance_table(mean, "mean_abs", "contrib")


def importance_join(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Ranks of several methods side by side, and how many put a feature in their top 10."""
    ranks = [f"rank_{name}" for name in tables]
    frames = [table.select("feature", f"rank_{name}") for name, table in tables.items()]
    joined = reduce(lambda left, right: left.join(right, "feature"), frames)
    votes = sum((F.col(r) <= TOP_RANK).cast("int") for r in ranks)
    return joined.withColumn("top10_method_count", votes).withColumn(
        "top10_consensus", F.col("top10_method_count") >= CONSENSUS
    )


# ---- permutation ----------------------------------------------------------------------------------


#: A prime above every half of a row number that is scrambled.
PRIME = 2**31 - 1
#: Rows from which on so many steps of a cycle walk are enough: each step leaves the rows with chance 2 / sqrt(n).
WALK_ROWS, WALK_STEPS = 10_000, 16


def _round_keys(seed: int, feature: str, repeat: int) -> list[int]:
    """Factor and summand of each of four rounds."""
    out = []
    for turn in range(4):
        digest = hashlib.md5(f"{seed}|{feature}|{repeat}|{turn}".encode()).hexdigest()
        out += [int(digest[:7], 16) + 1, int(digest[7:14], 16)]
    return out


def _scrambled(number: str, side: int) -> str:
    """SQL: four Feistel rounds on a number below side * side, with the job's ``_keys``. A bijection for any keys."""
    left, right = f"({number} div {side}L)", f"({number} % {side}L)"
    for turn in (0, 2):
        left = f"(({left} + ({right} * _keys[{2 * turn}] + _keys[{2 * turn + 1}]) % {PRIME}L) % {side}L)"
        right = f"(({right} + ({left} * _keys[{2 * turn + 2}] + _keys[{2 * turn + 3}]) % {PRIME}L) % {side}L)"
    return f"({left} * {side}L + {right})"


def bijection(number: str, n: int) -> Column:
    """A keyed permutation of 0..n-1: where the row of this ``number`` sends its value.

    The rounds permute the smallest square that holds n numbers; what leaves 0..n-1 is scrambled again until it is back,
    which follows a cycle and so stays a permutation.
    """
    side = max(1, math.isqrt(max(0, n - 1)) + 1)
    steps = side * side - n + 1 if n < WALK_ROWS else WALK_STEPS
    inside = f"acc < {n}L"
    walk = f"aggregate(sequence(1, {steps}), _out, (acc, s) -> CASE WHEN {inside} THEN acc ELSE {_scrambled('acc', side)} END)"
    first = _scrambled(number, side)
    safe = walk.replace("_out", first)
    return F.expr(f"CASE WHEN {first} < {n}L THEN {first} ELSE {safe} END")


def permuted_copies(
    rows: DataFrame, row_id: str, features: Sequence[str], repeats: int, seed: int
) -> DataFrame:
    """Every (feature, repeat) copy of the rows with that one feature shuffled.

    Rows are numbered once, in an order of hashes. A copy is a keyed bijection on these numbers, so nothing is
    sorted for it: each row sends its value to the row of the scrambled number, and only numbers and values move.
    The wide copies are made where the row is and are never shuffled. The copy with feature NULL and
    repeat 0 is the table as it is.
    """
    features = list(features)
    n = rows.count()
    digits = max(2, math.ceil(math.log(max(1, n) / ROWS_PER_BUCKET, 16)) + 1)
    numbered = positions(
        rows.withColumn("_h", seeded_hash(f"{seed}|place", F.col(row_id))).withColumn(
            "_bucket", F.substring("_h", 1, digits)
        ),
        [],
        "_bucket",
        [F.asc("_h")],
        "_place",
    ).drop("_h", "_bucket", "_place_total")
    numbered = written(numbered.withColumn("_place", F.col("_place") - 1), "numbered")
    todo = [(at, f, r) for at, f in enumerate(features) for r in range(1, repeats + 1)]
    jobs = F.array(
        *[
            F.struct(
                F.lit(j).alias("_job"),
                F.lit(at).alias("_at"),
                F.array(*[F.lit(k).cast("long") for k in _round_keys(seed, f, r)]).alias("_keys"),
            )
            for j, (at, f, r) in enumerate(todo)
        ]
    )
    values = F.array(*[F.col(f).cast("double") for f in features])
    # A number gets one value for each job, so the largest is that one. Before the shuffle there is nothing to combine.
    got = [F.max(F.when(F.col("_job") == j, F.col("_value"))).alias(f"_v{j}") for j in range(len(todo))]
    sent = (
        numbered.select("_place", values.alias("_values"), F.inline(jobs))
        .select(bijection("_place", n).alias("_target"), "_job", F.get("_values", F.col("_at")).alias("_value"))
        .repartition("_target")
        .groupBy("_target")
        .agg(*got)
    )
    each = F.array(*[F.struct(F.lit(j).alias("_job"), F.col(f"_v{j}").alias("_value")) for j in range(len(todo))])
    received = numbered.join(sent, F.col("_place") == F.col("_target")).select(*rows.columns, F.inline(each))
    per = F.floor(F.col("_job") / repeats).cast("int")
    names = F.array(*[F.lit(f) for f in features])
    replaced = [
        F.when(per == features.index(c), F.col("_value")).otherwise(F.col(c).cast("double")).alias(c)
        if c in features
        else F.col(c)
        for c in rows.columns
    ]
    copies = received.select(
        F.get(names, per).alias("feature"), (F.col("_job") % repeats + 1).cast("int").alias("repeat"), *replaced
    )
    own = [F.col(f).cast("double").alias(f) if f in features else F.col(f) for f in rows.columns]
    baseline = rows.select(F.lit(None).cast("string").alias("feature"), F.lit(0).alias("repeat"), *own)
    return copies.unionByName(baseline)


def permutation_scores(
    rows: DataFrame,
    row_id: str,
    features: Sequence[str],
    score: Callable[[DataFrame], DataFrame],
    n_classes: int,
    repeats: int = 5,
    seed: int = 2026,
) -> DataFrame:
    """(feature, repeat, f1, recall) of every copy; the rows as they are have feature NULL.

    ``score`` turns rows into a scored table (y_true, y_prob) and keeps the other columns.
    All copies are scored in one plan.
    """
    by = ["feature", "repeat"]
    per_class = per_class_metrics(score(permuted_copies(rows, row_id, features, repeats, seed)), n_classes, by)
    return per_class.groupBy(*by).agg(F.avg("f1").alias("f1"), F.avg("recall").alias("recall"))


def drops_of(scores: DataFrame) -> DataFrame:
    """The ranking of :func:`permutation_scores`: mean drops, their spread, rank and whether they are noise."""
    # One row per copy; the baseline is the copy without a feature.
    whole = Window.partitionBy()
    base = lambda c: F.max(F.when(F.col("feature").isNull(), F.col(c))).over(whole)
    drops = scores.select(
        "feature",
        (base("f1") - F.col("f1")).alias("_f1"),
        (base("recall") - F.col("recall")).alias("_recall"),
    ).where(F.col("feature").isNotNull())
    spread = F.coalesce(F.stddev_samp("_f1"), F.lit(0.0))
    order = Window.orderBy(F.desc("mean_decrease_macro_f1"), F.asc("feature"))
    return (
        drops.groupBy("feature")
        .agg(
            F.avg("_f1").alias("mean_decrease_macro_f1"),
            spread.alias("std_decrease_macro_f1"),
            F.avg("_recall").alias("mean_decrease_balanced_accuracy"),
        )
        .withColumn("rank", F.row_number().over(order))
        .withColumn(
            "within_noise", F.col("mean_decrease_macro_f1") <= F.col("std_decrease_macro_f1")
        )
    )


def permutation_importance(
    rows: DataFrame,
    row_id: str,
    features: Sequence[str],
    score: Callable[[DataFrame], DataFrame],
    n_classes: int,
    repeats: int = 5,
    seed: int = 2026,
) -> DataFrame:
    """Mean drop in macro F1 and balanced accuracy when one feature is shuffled."""
    rows = written(rows, "permuted-rows")
    return drops_of(permutation_scores(rows, row_id, features, score, n_classes, repeats, seed))


@dataclass(frozen=True)
class Ranking:
    """Features ranked on validation: ``table`` has a row per feature, ``header`` says how it was measured."""

    table: DataFrame
    header: dict


def rank_on_validation(
    scored_rows: DataFrame,
    row_id: str,
    features: Sequence[str],
    score: Callable[[DataFrame], DataFrame],
    n_classes: int,
    label: str = "_label",
    maximum_rows: int = 0,
    repeats: int = 5,
    seed: int = 2026,
    run_id: str = "",
) -> Ranking:
    """Rank features by what their destruction costs on the validation rows of ``scored_rows`` (by ``split``).

    ``maximum_rows`` draws a class-proportional sample with at least one row per class; 0 takes all. The
    figures of the copies, one row for each, are written once; table and header come from there.
    """
    rows = scored_rows.where(F.col("split") == RANKING_SPLIT)
    if maximum_rows <= 0:
        # Read several times below; the source is scanned for them once.
        rows = written(rows, "ranking-rows")
    available = rows.count()
    sampled = 0 < maximum_rows < available
    if sampled:
        rows = written(stratified_sample(rows, label, maximum_rows, F.col(row_id), seed), "ranking-rows")
    scores = written(permutation_scores(rows, row_id, features, score, n_classes, repeats, seed), "permutation-scores")
    table = drops_of(scores)
    baseline = scores.where(F.col("feature").isNull()).first()
    return Ranking(
        table,
        {
            "format_version": RANKING_VERSION,
            "method": "permutation_importance",
            "scored_split": RANKING_SPLIT,
            "scored_by": "macro_f1",
            "run_id": run_id,
            "split_rows_available": available,
            "split_rows_scored": rows.count() if sampled else available,
            "repeats": repeats,
            "seed": seed,
            "baseline_macro_f1": baseline["f1"] if baseline else 0.0,
            "candidate_feature_count": len(features),
            "features_within_noise": table.where("within_noise").count(),
        },
    )


def write_ranking(ranking: Ranking, path: str) -> None:
    """The table and its header, as JSON lines below ``path``."""
    spark = ranking.table.sparkSession
    ranking.table.coalesce(1).write.mode("overwrite").json(f"{path}/ranking")
    header = spark.createDataFrame([(json.dumps(ranking.header),)], "value string")
    header.coalesce(1).write.mode("overwrite").text(f"{path}/header")


def load_ranking(spark: SparkSession, path: str) -> Ranking:
    """A written ranking; refused when it has no rows or was not measured on validation in the known format."""
    header = json.loads(spark.read.text(f"{path}/header").first()["value"])
    check_ranking_header(header)
    table = spark.read.schema(RANKING_SCHEMA).json(f"{path}/ranking")
    if table.isEmpty():
        raise ValueError("The ranking is empty")
    return Ranking(table, header)


# ---- consuming a ranking ----------------------------------------------------------------------------


def check_ranking_header(header: Mapping) -> None:
    """A ranking is refused unless it was measured on validation in the known format."""
    if int(header.get("format_version", 0)) != RANKING_VERSION:
        raise ValueError(f"Unsupported ranking version {header.get('format_version')!r}")
    if header.get("scored_split") != RANKING_SPLIT:
        raise ValueError(
            f"A ranking must be measured on {RANKING_SPLIT}, not on {header.get('scored_split')!r}"
        )


def ranking_gaps(candidates: DataFrame, ranking: DataFrame, fail: bool = False) -> DataFrame:
    """Features that only the candidates or only the ranking know."""
    left = candidates.select("feature", F.lit(1).alias("_c"))
    right = ranking.select("feature", F.lit(1).alias("_r"))
    gaps = (
        left.join(right, "feature", "full_outer")
        .where(F.col("_c").isNull() | F.col("_r").isNull())
        .select(
            "feature",
            F.when(F.col("_r").isNull(), "missing from the ranking")
            .otherwise("unknown to the dataset")
            .alias("problem"),
        )
    )
    return guard(gaps, fail, "The ranking does not match the candidate features")


def select_topk_ranking(
    candidates: DataFrame, ranking: DataFrame, k: int, header: Mapping | None = None
) -> DataFrame:
    """The k best ranked features in their original order.

    ``candidates`` is (position, feature), ``ranking`` is (rank, feature).
    """
    if header is not None:
        check_ranking_header(header)
    n = candidates.count()
    if not 1 <= k <= n:
        raise ValueError(f"k={k} is outside 1..{n}")
    if ranking.isEmpty():
        raise ValueError("The ranking is empty")
    ranking_gaps(candidates, ranking, fail=True)
    best = ranking.where(F.col("rank") <= k)
    order = Window.orderBy("position")
    return candidates.join(best, "feature").select(
        F.row_number().over(order).alias("model_position"), "position", "feature", "rank"
    )


def select_topk_gain(candidates: DataFrame, gains: DataFrame, k: int) -> DataFrame:
    """The k features with the largest gain (ties by name) in their original order."""
    order = Window.orderBy(F.desc("gain"), F.asc("feature"))
    ranking = candidates.join(gains, "feature").select(
        "feature", F.row_number().over(order).alias("rank")
    )
    return select_topk_ranking(candidates, ranking, k)


def feature_list(selected: DataFrame) -> list[str]:
    rows = bounded_rows(selected.select("position", "feature"), MAX_FEATURES)
    return [r["feature"] for r in sorted(rows, key=lambda r: r["position"])]


def ranked_features(candidates: Sequence[str], ranking: Ranking) -> list[str]:
    """All candidates, the best first. The ranking has to name exactly them."""
    check_ranking_header(ranking.header)
    spark = ranking.table.sparkSession
    named = spark.createDataFrame(list(enumerate(candidates)), "position int, feature string")
    ranking_gaps(named, ranking.table, fail=True)
    rows = bounded_rows(ranking.table.select("rank", "feature"), MAX_FEATURES)
    return [r["feature"] for r in sorted(rows, key=lambda r: r["rank"])]
