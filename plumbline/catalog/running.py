"""Importance tables, run histories and incremental preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.catalog import Catalog
from plumbline.catalog.tables import (
    ASSIGNED_DEFAULT,
    POLICY,
    RATIOS,
    SEED,
    r,
    read,
    rounded,
)
from plumbline.operators import accounting, history, importance
from plumbline.operators.ordered import with_micros, with_range_bucket
from plumbline.session import fresh_path
from plumbline.sources.scan import ROW_ID, list_files
from plumbline.streaming.incremental import IncrementalPreparation

catalog = Catalog()
BUCKET_ROWS = 2_000

# ---- importance -------------------------------------------------------------------------------------

# 42 features: flag, status and line number; each method ranks them by another figure.
_FEATURE = "l_returnflag || l_linestatus || l_linenumber"
_PRICE = "l_extendedprice::DECIMAL(18,2)"


def _featured(spark, sf_dir) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    return lines.withColumn(
        "feature",
        F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")),
    ).withColumn("price", F.col("l_extendedprice").cast("decimal(18,2)"))


def _gains(spark, sf_dir) -> DataFrame:
    total = F.sum("price").cast("double")
    return _featured(spark, sf_dir).groupBy("feature").agg(total.alias("gain"))


def _split_counts(spark, sf_dir) -> DataFrame:
    # Counted by supplier parity, so that the ranks differ from those by gain.
    odd = F.count_if(F.col("l_suppkey") % 2 == 1)
    return _featured(spark, sf_dir).groupBy("feature").agg(odd.alias("split_count"))


def _contributions(spark, sf_dir) -> DataFrame:
    """One contribution per line and class, with a bias row."""
    cells = F.array(
        F.struct("feature", (F.col("l_tax") * 100 - 4).alias("contribution")),
        F.struct("feature", (F.col("l_discount") * 100 - 5).alias("contribution")),
        F.struct(F.lit("bias").alias("feature"), F.lit(0.5).alias("contribution")),
    )
    return _featured(spark, sf_dir).select(F.inline(cells))


def _drops(spark, sf_dir) -> DataFrame:
    mean = F.avg(F.col("l_quantity"))
    return _featured(spark, sf_dir).groupBy("feature").agg(F.round(mean, 9).alias("mean_decrease"))


def _ranked_sql(value: str, short: str, source: str) -> str:
    return f"""SELECT *, {value} / sum({value}) OVER () * 100 AS {short}_percent,
    row_number() OVER (ORDER BY {value} DESC, feature) AS rank_{short} FROM ({source})"""


_GAIN = _ranked_sql("gain", "gain", f"SELECT {_FEATURE} AS feature, sum({_PRICE})::DOUBLE AS gain FROM lineitem GROUP BY 1")
_SPLIT = _ranked_sql(
    "split_count", "split", f"SELECT {_FEATURE} AS feature, count(*) FILTER (l_suppkey % 2 = 1) AS split_count FROM lineitem GROUP BY 1"
)
_CONTRIB = _ranked_sql(
    "mean_abs",
    "contrib",
    f"""SELECT feature, avg(abs(v)) AS mean_abs FROM (SELECT {_FEATURE} AS feature, l_tax * 100 - 4 AS v FROM lineitem
    UNION ALL SELECT {_FEATURE}, l_discount * 100 - 5 FROM lineitem) GROUP BY 1""",
)
_DROP = _ranked_sql(
    "mean_decrease", "permutation", f"SELECT {_FEATURE} AS feature, round(avg(l_quantity), 9) AS mean_decrease FROM lineitem GROUP BY 1"
)


@catalog.query(
    "importance_gain",
    f"""SELECT feature, {r('gain', 2)} AS gain, {r('gain_percent')} AS gain_percent, rank_gain::INTEGER AS rank_gain,
    {r('sum(gain_percent) OVER (ORDER BY rank_gain)')} AS cumulative_gain_percent FROM ({_GAIN})""",
)
def importance_gain(spark, sf_dir):
    table = importance.importance_gain(_gains(spark, sf_dir))
    return rounded(table.withColumn("gain", F.round("gain", 2)))


@catalog.query(
    "importance_split",
    f"SELECT feature, split_count, {r('split_percent')} AS split_percent, rank_split::INTEGER AS rank_split FROM ({_SPLIT})",
)
def importance_split(spark, sf_dir):
    return rounded(importance.importance_split(_split_counts(spark, sf_dir)))


@catalog.query(
    "importance_contrib",
    f"SELECT feature, {r('mean_abs')} AS mean_abs, {r('contrib_percent')} AS contrib_percent, rank_contrib::INTEGER AS rank_contrib FROM ({_CONTRIB})",
)
def importance_contrib(spark, sf_dir):
    return rounded(importance.importance_contrib(_contributions(spark, sf_dir), bias="bias"))


@catalog.query(
    "importance_join",
    f"""SELECT feature, rank_gain::INTEGER AS rank_gain, rank_split::INTEGER AS rank_split, rank_permutation::INTEGER AS rank_permutation,
    rank_contrib::INTEGER AS rank_contrib,
    (rank_gain <= 10)::INTEGER + (rank_split <= 10)::INTEGER + (rank_permutation <= 10)::INTEGER + (rank_contrib <= 10)::INTEGER AS top10_method_count,
    (rank_gain <= 10)::INTEGER + (rank_split <= 10)::INTEGER + (rank_permutation <= 10)::INTEGER + (rank_contrib <= 10)::INTEGER >= 3 AS top10_consensus
    FROM ({_GAIN}) JOIN ({_SPLIT}) USING (feature) JOIN ({_DROP}) USING (feature) JOIN ({_CONTRIB}) USING (feature)""",
)
def importance_join(spark, sf_dir):
    drops = importance.importance_table(_drops(spark, sf_dir), "mean_decrease", "permutation")
    return importance.importance_join(
        {
            "gain": importance.importance_gain(_gains(spark, sf_dir)),
            "split": importance.importance_split(_split_counts(spark, sf_dir)),
            "permutation": drops,
            "contrib": importance.importance_contrib(_contributions(spark, sf_dir), bias="bias"),
        }
    )


# ---- histories: a user of events is a run, an event is a record ------------------------------------------


def records(spark, sf_dir) -> DataFrame:
    events = with_micros(read(spark, sf_dir, "events"), "ts")
    return events.select(
        F.col("user_id").alias("run"),
        F.col("_micros").alias("observed_at"),
        "event_id",
        F.date_format("ts", "yyyy-MM-dd").alias("session_id"),
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("counter"),
        F.col("value").alias("iteration_seconds"),
    )


def ordered_records(spark, sf_dir) -> DataFrame:
    return with_range_bucket(records(spark, sf_dir), "observed_at", BUCKET_ROWS, tie="event_id")


_RECORDS = """records AS (SELECT user_id AS run, epoch_us(ts) AS observed_at, event_id, strftime(ts, '%Y-%m-%d') AS session_id, event_type,
  json_extract_string(props, '$.k')::INTEGER AS counter, value AS iteration_seconds FROM events)"""


@catalog.query(
    "session_changes",
    f"""WITH {_RECORDS} SELECT run, observed_at, event_id, session_id, lag(session_id) OVER w AS prev_session_id FROM records
    WINDOW w AS (PARTITION BY run ORDER BY observed_at, event_id) QUALIFY lag(session_id) OVER w <> session_id""",
)
def session_changes(spark, sf_dir):
    """Events whose day differs from the user's event before."""
    changes = history.session_changes(
        ordered_records(spark, sf_dir), "_bucket", order=("observed_at", "event_id")
    )
    return changes.select("run", "observed_at", "event_id", "session_id", "prev_session_id")


@catalog.query(
    "round_timing",
    f"""WITH {_RECORDS} SELECT run, count(*) AS rounds, {r('avg(iteration_seconds)')} AS mean_seconds, {r('sum(iteration_seconds)')} AS total_seconds,
    {r("sum(CASE WHEN event_type = 'error' THEN iteration_seconds / 10 ELSE 0 END)")} AS total_checkpoint_seconds,
    count(*) FILTER (event_type = 'error' AND iteration_seconds > 0) AS checkpoints,
    greatest(1, ceil(greatest(100 - count(*), 0) * (avg(iteration_seconds)
      + sum(CASE WHEN event_type = 'error' THEN iteration_seconds / 10 ELSE 0 END) / count(*)) / 600))::BIGINT AS remaining_sessions
    FROM records GROUP BY run""",
)
def round_timing(spark, sf_dir):
    pause = F.when(F.col("event_type") == "error", F.col("iteration_seconds") / 10).otherwise(0.0)
    return rounded(
        history.round_timing(
            records(spark, sf_dir), target_rounds=100, session_seconds=600, checkpoint_seconds=pause
        )
    )


@catalog.query(
    "history_continuity",
    """WITH o AS (SELECT l_orderkey AS run, l_linenumber AS round, count(*) AS n FROM lineitem GROUP BY ALL),
    c AS (SELECT run, sum(n)::BIGINT AS records, count(*) AS distinct_rounds, min(round)::BIGINT AS first_round, max(round)::BIGINT AS last_round FROM o GROUP BY run)
    SELECT *, first_round = 1 AND last_round = distinct_rounds AND records = last_round AS continuous FROM c""",
)
def history_continuity(spark, sf_dir):
    """Are the line numbers of an order exactly 1..n?"""
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("round")
    )
    return history.history_continuity(lines)


@catalog.query(
    "sweep_history_scores",
    f"""WITH {_RECORDS} SELECT run, (array_agg(event_type ORDER BY observed_at DESC, event_id DESC))[1] AS event_type,
    {r("(array_agg(iteration_seconds ORDER BY observed_at DESC, event_id DESC))[1]")} AS iteration_seconds,
    max(observed_at) AS last_round, {r('sum(iteration_seconds)')} AS training_seconds FROM records GROUP BY run""",
)
def sweep_history_scores(spark, sf_dir):
    return rounded(
        history.final_scores(
            records(spark, sf_dir),
            ["event_type", "iteration_seconds"],
            order=("observed_at", "event_id"),
        )
    )


LIVE_EVENTS = ("view", "click")


@catalog.query(
    "heartbeat_status",
    f"""WITH expected AS (SELECT DISTINCT c_custkey AS run FROM customer),
    latest AS (SELECT user_id AS run, max(ts) AS last_seen, (array_agg(CASE event_type WHEN 'purchase' THEN 'complete' ELSE event_type END
      ORDER BY ts DESC, event_id DESC))[1] AS last_status FROM events GROUP BY 1),
    j AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_seen)) / 60e6 AS age FROM expected LEFT JOIN latest USING (run))
    SELECT run, last_status, {r('age')} AS age_minutes, CASE WHEN last_seen IS NULL THEN 'missing' WHEN last_status = 'complete' THEN 'complete'
      WHEN last_status IN ('view', 'click') AND age < 600 THEN 'alive' ELSE 'stale' END AS worker_status FROM j""",
)
def heartbeat_status(spark, sf_dir):
    """The last event of every customer; after ten hours a worker counts as stale."""
    beats = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        F.col("ts").cast("timestamp").alias("updated_at"),
        "event_id",
        F.when(F.col("event_type") == "purchase", "complete").otherwise(F.col("event_type")).alias("status"),
    )
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run"))
    status = history.heartbeat_status(
        beats,
        F.lit("2024-01-31 00:00:00").cast("timestamp"),
        stale_minutes=600,
        tie=["event_id"],
        live=LIVE_EVENTS,
        expected=customers,
    )
    return rounded(status.drop("last_seen"))


@catalog.query(
    "durable_progress",
    f"""WITH {_RECORDS}, l AS (SELECT *, lag(event_type) OVER w AS prev_event_type, lag(counter) OVER w AS prev_counter FROM records
      WINDOW w AS (PARTITION BY run ORDER BY observed_at, event_id))
    SELECT run, event_id, counter, prev_counter, coalesce(counter, 0) > coalesce(prev_counter, 0)
      OR (event_type <> coalesce(prev_event_type, 'missing') AND event_type IN ('purchase', 'signup')) AS progress FROM l""",
)
def durable_progress(spark, sf_dir):
    table = history.durable_progress(
        ordered_records(spark, sf_dir),
        "_bucket",
        ["counter"],
        order=("observed_at", "event_id"),
        status="event_type",
        terminal=("purchase", "signup"),
    )
    return table.select("run", "event_id", "counter", "prev_counter", "progress")


# ---- incremental preparation -----------------------------------------------------------------------------------


def incremental(spark, sf_dir) -> IncrementalPreparation:
    """Take in the lineitem file as a stream, split by order with the label policy."""
    schema = read(spark, sf_dir, "lineitem").schema

    def assign(batch: DataFrame) -> DataFrame:
        labelled = batch.withColumn("label", F.concat_ws("-", "l_returnflag", "l_linestatus"))
        return accounting.classify_and_split(
            labelled,
            POLICY,
            strategy="group_aware",
            seed=SEED,
            ratios=RATIOS,
            group_columns=["l_orderkey"],
        )

    return IncrementalPreparation(
        spark,
        sf_dir,
        schema,
        assign,
        fresh_path(spark, "incremental"),
        ["l_orderkey", "l_linenumber", "l_quantity", ROW_ID],
        pattern="lineitem.parquet",
    ).run()


@catalog.query(
    "incremental_prepare",
    f"""WITH {ASSIGNED_DEFAULT} SELECT split, label, open_set, count(*) AS rows, sum(rid)::BIGINT AS rid_sum, {r('sum(l_quantity)')} AS quantity
    FROM assigned WHERE split IS NOT NULL GROUP BY ALL""",
)
def incremental_prepare(spark, sf_dir):
    done = incremental(spark, sf_dir)
    done.run()  # nothing is left, so nothing is taken in twice
    return rounded(
        done.splits()
        .groupBy("split", "label", "open_set")
        .agg(
            F.count("*").alias("rows"),
            F.sum(ROW_ID).alias("rid_sum"),
            F.sum("l_quantity").alias("quantity"),
        )
    )


@catalog.query(
    "incremental_audit",
    f"""WITH {ASSIGNED_DEFAULT}, ids AS (SELECT 'sample' AS kind, rid::VARCHAR AS id, split FROM assigned WHERE split IS NOT NULL
      UNION ALL SELECT 'group', l_orderkey::VARCHAR, split FROM assigned WHERE split IS NOT NULL),
    per_id AS (SELECT kind, id, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'validation') AS b,
               count(*) FILTER (split = 'test') AS c FROM ids GROUP BY ALL)
    SELECT kind, count(*) AS identities, count(*) FILTER ((a > 0)::INT + (b > 0)::INT + (c > 0)::INT > 1) AS cross_split,
      sum(CASE WHEN kind = 'sample' THEN greatest(a - 1, 0) + greatest(b - 1, 0) + greatest(c - 1, 0) ELSE 0 END)::BIGINT AS duplicates_within_split,
      count(*) FILTER (a > 0 AND b > 0) AS train_validation, count(*) FILTER (a > 0 AND c > 0) AS train_test, count(*) FILTER (b > 0 AND c > 0) AS validation_test,
      count(*) FILTER ((a > 0)::INT + (b > 0)::INT + (c > 0)::INT > 1) = 0 AS passed FROM per_id GROUP BY kind""",
)
def incremental_audit(spark, sf_dir):
    """Open-set rows go to test whatever their group, so groups cross splits here."""
    return incremental(spark, sf_dir).audit()


@catalog.query(
    "prepare_status",
    f"""WITH {ASSIGNED_DEFAULT} SELECT 1::BIGINT AS completed_files, count(*) AS rows_read, count(*) FILTER (split IS NOT NULL) AS rows_written,
    true AS has_parts, 'complete' AS status FROM assigned""",
)
def prepare_status(spark, sf_dir):
    source_files = list_files(spark, sf_dir, "lineitem.parquet").count()
    status = incremental(spark, sf_dir).status(source_files)
    parts = [F.col(f"parts_{s}") > 0 for s in ("train", "validation", "test")]
    return status.select(
        "completed_files",
        "rows_read",
        "rows_written",
        (parts[0] & parts[1] & parts[2]).alias("has_parts"),
        "status",
    )


