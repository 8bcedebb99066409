"""Tables over run histories: one record per round of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.checks import guard
from plumbline.operators.metrics import per_class_of, prediction_counts
from plumbline.operators.ordered import with_previous
from plumbline.session import written

EVAL_SETS = ("train", "val", "monitor")
FIGURES = ("multi_logloss", "multi_error", "macro_f1", "macro_recall")
TERMINAL = ("paused", "ready_for_report", "complete")  # fixed values
ALIVE = ("preparing", "running")  # fixed values


def eval_history(staged: DataFrame, n_classes: int) -> DataFrame:
    """(run, round, eval_set) -> logloss, error, macro F1, macro recall of staged scores."""
    by = ["run", "round", "eval_set"]
    # Rows are scored and counted once; all figures come from the counts.
    counted = written(prediction_counts(staged, by), "history")
    rows = F.sum("rows")
    right = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("rows")).otherwise(0))
    figures = counted.groupBy(*by).agg(
        (F.sum("loss") / F.sum(F.when(F.col("loss").isNotNull(), F.col("rows")))).alias("multi_logloss"),
        (1 - right / rows).alias("multi_error"),
        rows.alias("rows"),
    )
    per_class = (
        per_class_of(counted.drop("loss"), n_classes, by)
        .groupBy(*by)
        .agg(F.avg("f1").alias("macro_f1"), F.avg("recall").alias("macro_recall"))
    )
    return figures.join(per_class, by)


def wide_history(history: DataFrame, eval_sets: Sequence[str] = EVAL_SETS) -> DataFrame:
    """One row per (run, round) with <set>_<figure> columns."""
    pivoted = (
        history.groupBy("run", "round")
        .pivot("eval_set", list(eval_sets))
        .agg(*[F.first(f, ignorenulls=True).alias(f) for f in FIGURES])
    )
    return pivoted


def learning_curve(wide: DataFrame, monitor: bool = True) -> DataFrame:
    """Accuracy per set and the gaps between sets, named by what they hold."""
    curve = (
        wide.withColumn("train_accuracy", 1 - F.col("train_multi_error"))
        .withColumn("val_accuracy", 1 - F.col("val_multi_error"))
        .withColumn(
            "val_minus_train_multi_logloss",
            F.col("val_multi_logloss") - F.col("train_multi_logloss"),
        )
    )
    if monitor:
        curve = (
            curve.withColumn("monitor_accuracy", 1 - F.col("monitor_multi_error"))
            .withColumn(
                "monitor_minus_val_multi_logloss",
                F.col("monitor_multi_logloss") - F.col("val_multi_logloss"),
            )
            .withColumn(
                "val_minus_monitor_macro_f1", F.col("val_macro_f1") - F.col("monitor_macro_f1")
            )
        )
    return curve


def mixed_monitors(history: DataFrame, fail: bool = False) -> DataFrame:
    """Runs whose records name more than one monitoring set."""
    mixed = (
        history.where(F.col("monitor_name").isNotNull())
        .groupBy("run")
        .agg(F.count_distinct("monitor_name").alias("monitors"))
        .where(F.col("monitors") > 1)
    )
    return guard(mixed, fail, "The history mixes monitoring sets")


def session_changes(
    history: DataFrame,
    bucket: str,
    keys: Sequence[str] = ("run",),
    order: Sequence[str] = ("round",),
    session: str = "session_id",
) -> DataFrame:
    """Records whose session differs from the record before."""
    linked = with_previous(history, keys, bucket, order, [session, *order])
    changed = F.col(f"prev_{order[0]}").isNotNull() & ~F.col(session).eqNullSafe(
        F.col(f"prev_{session}")
    )
    return linked.where(changed).drop(*[f"prev_{o}" for o in order])


def round_timing(
    history: DataFrame,
    target_rounds: int,
    session_seconds: float,
    keys: Sequence[str] = ("run",),
    seconds: Column | str = "iteration_seconds",
    checkpoint_seconds: Column | str = "checkpoint_seconds",
) -> DataFrame:
    """Mean and total seconds per run, and how many sessions the remaining rounds need.

    A session loses the time of its checkpoints: one mean pause for each block of rounds between
    checkpoints. At least one session is expected.
    """
    seconds = F.col(seconds) if isinstance(seconds, str) else seconds
    pause = F.col(checkpoint_seconds) if isinstance(checkpoint_seconds, str) else checkpoint_seconds
    remaining = F.greatest(F.lit(target_rounds) - F.col("rounds"), F.lit(0))
    pauses = F.coalesce(F.col("total_checkpoint_seconds"), F.lit(0.0)) / F.greatest(F.col("rounds"), F.lit(1))
    needed = remaining * (F.col("mean_seconds") + pauses)
    sessions = F.greatest(F.lit(1), F.ceil(needed / F.lit(float(session_seconds))))
    return (
        history.groupBy(*keys)
        .agg(
            F.count("*").alias("rounds"),
            F.avg(seconds).alias("mean_seconds"),
            F.sum(seconds).alias("total_seconds"),
            F.sum(pause).alias("total_checkpoint_seconds"),
            F.count_if(pause > 0).alias("checkpoints"),
        )
        .withColumn("remaining_sessions", sessions.cast("bigint"))
    )


def history_continuity(
    history: DataFrame,
    keys: Sequence[str] = ("run",),
    round_column: str = "round",
    expected: int | None = None,
) -> DataFrame:
    """Per run: are the rounds exactly 1..n (or 1..expected), each once?

    Repeats combine before anything else moves, so a run of any length is one short row.
    """
    once = history.groupBy(*keys, round_column).agg(F.count("*").alias("_times"))
    last = F.col("last_round") if expected is None else F.lit(expected)
    return (
        once.groupBy(*keys)
        .agg(
            F.sum("_times").alias("records"),
            F.count("*").alias("distinct_rounds"),
            F.min(round_column).cast("bigint").alias("first_round"),
            F.max(round_column).cast("bigint").alias("last_round"),
        )
        .withColumn(
            "continuous",
            (F.col("first_round") == 1)
            & (F.col("last_round") == last)
            & (F.col("distinct_rounds") == last)
            & (F.col("records") == last),
        )
    )


def broken_histories(continuity: DataFrame, fail: bool = False) -> DataFrame:
    return guard(continuity.where(~F.col("continuous")), fail, "Rounds are not continuous")


def final_scores(
    history: DataFrame,
    figures: Sequence[str],
    keys: Sequence[str] = ("run",),
    order: Sequence[str] = ("round",),
    seconds: str = "iteration_seconds",
    expected_rounds: int | None = None,
    fail: bool = False,
) -> DataFrame:
    """Figures of the last round of each run and its total seconds; unfinished runs are refused.

    With ``expected_rounds`` only runs whose last round is that round are finished.
    """
    last = F.max_by(F.struct(*figures), F.struct(*order))
    scores = history.groupBy(*keys).agg(
        last.alias("_last"),
        F.max(order[0]).alias("last_round"),
        F.sum(seconds).alias("training_seconds"),
    )
    scores = scores.select(*keys, "_last.*", "last_round", "training_seconds")
    if expected_rounds is None:
        return scores
    finished = F.col("last_round") == expected_rounds
    guard(scores.where(~finished).select(*keys, "last_round"), fail, "Unfinished runs")
    return scores.where(finished)


def heartbeat_status(
    heartbeats: DataFrame,
    now: Column,
    stale_minutes: float,
    keys: Sequence[str] = ("run",),
    time: str = "updated_at",
    status: str = "status",
    tie: Sequence[str] = (),
    live: Sequence[str] = ALIVE,
    expected: DataFrame | None = None,
) -> DataFrame:
    """Latest heartbeat per key -> missing, alive, stale or complete.

    ``expected`` lists keys that should have one; those without are missing.
    """
    latest = heartbeats.groupBy(*keys).agg(
        F.lit(True).alias("_seen"),
        F.max(time).alias("last_seen"),
        F.max_by(F.lower(status), F.struct(time, *tie)).alias("last_status"),
    )
    if expected is not None:
        latest = expected.select(*keys).distinct().join(latest, list(keys), "left")
    age = (F.unix_micros(now) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 60e6
    worker = (
        F.when(F.col("_seen").isNull(), "missing")
        .when(F.col("last_status") == "complete", "complete")
        .when(F.col("last_status").isin(list(live)) & (F.col("age_minutes") < stale_minutes), "alive")
        .otherwise("stale")
    )
    return (
        latest.withColumn("age_minutes", age).withColumn("worker_status", worker).drop("_seen")
    )


def durable_progress(
    observations: DataFrame,
    bucket: str,
    counters: Sequence[str],
    keys: Sequence[str] = ("run",),
    order: Sequence[str] = ("observed_at",),
    status: str = "status",
    terminal: Sequence[str] = TERMINAL,
) -> DataFrame:
    """Did a counter rise, or the status reach a terminal state, since the observation before?

    Before the first observation every counter is 0 and the status is missing; so is a NULL counter 0.
    """
    linked = with_previous(observations, keys, bucket, order, [status, *counters])
    rose = [F.coalesce(F.col(c), F.lit(0)) > F.coalesce(F.col(f"prev_{c}"), F.lit(0)) for c in counters]
    state = F.lower(F.coalesce(F.col(status), F.lit("missing")))
    before = F.lower(F.coalesce(F.col(f"prev_{status}"), F.lit("missing")))
    progress = (state != before) & state.isin(list(terminal))
    for flag in rose:
        progress = progress | flag
    return linked.withColumn("progress", progress)
