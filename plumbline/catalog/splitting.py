"""Labels, splits, audits and the row account, on lineitem."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog import Catalog
from plumbline.catalog.tables import (
    ASSIGNED_DEFAULT,
    CLASSIFIED,
    DAY_ROLES,
    DAY_SPLIT,
    GROUP_SPLIT,
    LINES,
    POLICY,
    RATIOS,
    ROW_SPLIT,
    SEED,
    SPACE,
    VALIDATION_FRACTION,
    assigned_sql,
    lines,
    r,
    read,
    rounded,
    split_case,
    text_key,
    unit,
)
from plumbline.functions.hashing import seeded_hash, unit_value
from plumbline.functions.numeric import clean_float
from plumbline.functions.text import canonical_text
from plumbline.operators import accounting, audit, labels
from plumbline.operators.splits import (
    STRATEGIES,
    assign_split,
    day_split,
    drop_unassigned,
    group_identity,
    group_text,
    hash_split,
    unassigned_count,
)
from plumbline.sources.scan import ROW_ID

catalog = Catalog()
AUDIT_DIVISOR = 8


def assigned(
    spark: SparkSession, sf_dir: str, strategy: str = "group_aware", identity: bool = False
) -> DataFrame:
    """lineitem with policy flags and a split, as every check below takes it."""
    return accounting.classify_and_split(
        lines(spark, sf_dir, identity or strategy == "row_hash"),
        POLICY,
        strategy=strategy,
        seed=SEED,
        ratios=RATIOS,
        group_columns=["l_orderkey"],
        day_column="day",
        day_roles=DAY_ROLES,
        validation_fraction=VALIDATION_FRACTION,
    )


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.apply_policy(lines(spark, sf_dir, False), POLICY)


# ---- labels -----------------------------------------------------------------------------------------


@catalog.query(
    "canonical_label",
    f"""WITH raw AS (SELECT chr(9) || ' ' || l_returnflag || '-' || l_linestatus || chr(160) AS raw FROM lineitem)
    SELECT trim(raw, {SPACE}) AS label, count(*) AS rows, min(length(raw))::INTEGER AS raw_length FROM raw GROUP BY 1""",
)
def canonical_label(spark, sf_dir):
    padded = F.concat(F.lit("\t "), "l_returnflag", F.lit("-"), "l_linestatus", F.lit("\xa0"))
    raw = read(spark, sf_dir, "lineitem").select(padded.alias("raw"))
    return (
        raw.withColumn("label", labels.canonical_label(F.col("raw")))
        .groupBy("label")
        .agg(F.count("*").alias("rows"), F.min(F.length("raw")).alias("raw_length"))
    )


@catalog.query(
    "label_guard",
    "SELECT 'empty' AS problem, count(*) AS rows FROM orders WHERE o_orderpriority LIKE '5%' HAVING count(*) > 0",
)
def label_guard(spark, sf_dir):
    blanked = F.when(F.col("o_orderpriority").startswith("5"), F.lit(" \t")).otherwise(
        F.col("o_orderpriority")
    )
    return labels.missing_labels(read(spark, sf_dir, "orders").select(blanked.alias("l")), "l")


@catalog.query(
    "merge_labels",
    f"WITH {CLASSIFIED} SELECT label, count(*) AS rows FROM merged GROUP BY 1",
)
def merge_labels(spark, sf_dir):
    merged = lines(spark, sf_dir, False).withColumn("label", POLICY.merged(F.col("label")))
    return merged.groupBy("label").agg(F.count("*").alias("rows"))


@catalog.query(
    "label_policy",
    f"WITH {CLASSIFIED} SELECT label, keep, open_set, count(*) AS rows FROM classified GROUP BY ALL",
)
def label_policy(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("label", "keep", "open_set").agg(
        F.count("*").alias("rows")
    )


@catalog.query(
    "excluded_label_counts",
    f"WITH {CLASSIFIED} SELECT label, count(*) AS rows FROM classified WHERE NOT keep GROUP BY 1",
)
def excluded_label_counts(spark, sf_dir):
    return labels.excluded_label_counts(classified(spark, sf_dir))


@catalog.query(
    "clean_numeric",
    f"""WITH v AS (
      SELECT l_linenumber, CASE WHEN l_quantity = 7 THEN 'nan'::DOUBLE WHEN l_quantity = 11 THEN 'inf'::DOUBLE
             WHEN l_quantity = 13 THEN '-inf'::DOUBLE WHEN l_quantity = 17 THEN 1e300 ELSE l_quantity END AS x
      FROM lineitem),
    c AS (SELECT l_linenumber, CASE WHEN isfinite(x) AND abs(x) < 3.5e38 THEN x::FLOAT END AS f FROM v),
    e AS (SELECT try_cast(replace(json_extract_string(props, '$.k'), '5', 'x') AS DOUBLE) AS f FROM events)
    SELECT 'line ' || l_linenumber AS part, count(*) AS rows, count(*) - count(f) AS missing, {r("sum(f::DOUBLE)")} AS total
    FROM c GROUP BY 1 UNION ALL
    SELECT 'props', count(*), count(*) - count(f), {r("sum(f::FLOAT::DOUBLE)")} FROM e""",
)
def clean_numeric(spark, sf_dir):
    quantity = F.col("l_quantity")
    planted = (
        F.when(quantity == 7, F.lit(float("nan")))
        .when(quantity == 11, F.lit(float("inf")))
        .when(quantity == 13, F.lit(float("-inf")))
        .when(quantity == 17, F.lit(1e300))
        .otherwise(quantity)
    )
    numbers = read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("part"),
        clean_float(planted).alias("f"),
    )
    text = F.regexp_replace(F.get_json_object("props", "$.k"), "5", "x")
    texts = read(spark, sf_dir, "events").select(
        F.lit("props").alias("part"), clean_float(text).alias("f")
    )
    value = F.when(~F.isnan("f"), F.col("f").cast("double"))
    return rounded(
        numbers.unionByName(texts)
        .groupBy("part")
        .agg(
            F.count("*").alias("rows"),
            F.count_if(F.isnan("f")).alias("missing"),
            F.sum(value).alias("total"),
        )
    )


MAPPING = f"""{ASSIGNED_DEFAULT},
mapping AS (SELECT label, (row_number() OVER (ORDER BY label) - 1)::INTEGER AS code
            FROM (SELECT DISTINCT label FROM assigned WHERE keep AND NOT open_set))"""


@catalog.query(
    "encode_labels",
    f"""WITH {MAPPING} SELECT label, coalesce(code, -1)::INTEGER AS _label, count(*) AS rows
    FROM assigned LEFT JOIN mapping USING (label) WHERE split IS NOT NULL GROUP BY ALL""",
)
def encode_labels(spark, sf_dir):
    rows = drop_unassigned(assigned(spark, sf_dir))
    mapping = labels.label_mapping(rows.where(~F.col("open_set")))
    return labels.encode_labels(rows, mapping).groupBy("label", "_label").agg(
        F.count("*").alias("rows")
    )


@catalog.query(
    "open_set_labels",
    f"WITH {CLASSIFIED} SELECT DISTINCT label, (-1)::INTEGER AS code FROM classified WHERE open_set",
)
def open_set_labels(spark, sf_dir):
    return labels.open_set_labels(classified(spark, sf_dir))


@catalog.query(
    "drop_unassigned",
    f"""WITH {assigned_sql(DAY_SPLIT)}
    SELECT count(*) FILTER (split IS NULL) AS rows_unassigned, count(*) FILTER (split IS NOT NULL) AS rows_assigned
    FROM assigned""",
)
def drop_unassigned_query(spark, sf_dir):
    return unassigned_count(assigned(spark, sf_dir, "by_capture_day"))


# ---- splits -------------------------------------------------------------------------------------------


@catalog.query(
    "hash_to_split",
    f"""SELECT o_orderkey, {r(unit("o_orderkey"), 9)} AS unit, {split_case("o_orderkey")} AS split FROM orders""",
)
def hash_to_split(spark, sf_dir):
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.round(unit_value(seeded_hash(SEED, key)), 9) + F.lit(0.0)).alias("unit"),
        hash_split(key, RATIOS, SEED).alias("split"),
    )


@catalog.query(
    "row_hash_split",
    f"""WITH {LINES} SELECT {ROW_SPLIT} AS split, l_linestatus, count(*) AS rows,
    sum(rid)::BIGINT AS rid_sum, min(rid) AS rid_min, max(rid) AS rid_max FROM lines GROUP BY ALL""",
)
def row_hash_split(spark, sf_dir):
    rows = assign_split(lines(spark, sf_dir), "row_hash", SEED, RATIOS)
    return rows.groupBy("split", "l_linestatus").agg(
        F.count("*").alias("rows"),
        F.sum(ROW_ID).alias("rid_sum"),
        F.min(ROW_ID).alias("rid_min"),
        F.max(ROW_ID).alias("rid_max"),
    )


@catalog.query(
    "canonical_key",
    """WITH parts AS (
      SELECT 'double' AS kind, CASE WHEN l_quantity = trunc(l_quantity) THEN l_quantity::BIGINT::VARCHAR ELSE l_quantity::VARCHAR END AS key FROM lineitem
      UNION ALL SELECT 'fraction', CASE WHEN l_discount = trunc(l_discount) THEN l_discount::BIGINT::VARCHAR ELSE l_discount::VARCHAR END FROM lineitem
      UNION ALL SELECT 'integer', l_linenumber::VARCHAR FROM lineitem
      UNION ALL SELECT 'text', l_linenumber::VARCHAR FROM lineitem
      UNION ALL SELECT 'boolean', CASE WHEN l_tax > 0.04 THEN 'True' ELSE 'False' END FROM lineitem)
    SELECT kind, key, count(*) AS rows FROM parts GROUP BY ALL""",
)
def canonical_key(spark, sf_dir):
    table = read(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("double"),
        F.col("l_discount").alias("fraction"),
        F.col("l_linenumber").alias("integer"),
        F.concat(F.lit("\t "), F.col("l_linenumber").cast("string"), F.lit(" ")).alias("text"),
        (F.col("l_tax") > 0.04).alias("boolean"),
    )
    cells = [
        F.struct(F.lit(f.name).alias("kind"), canonical_text(f.name, f.dataType).alias("key"))
        for f in table.schema.fields
    ]
    return (
        table.select(F.inline(F.array(*cells)))
        .groupBy("kind", "key")
        .agg(F.count("*").alias("rows"))
    )


@catalog.query(
    "group_key",
    f"SELECT o_orderkey, md5({text_key('o_custkey', 'nullif(o_orderstatus, $$P$$)')}) AS group_key FROM orders",
)
def group_key(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("P")))
    return orders.select("o_orderkey", group_identity(orders, ["o_custkey", "s"]).alias("group_key"))


@catalog.query(
    "group_split",
    f"""WITH {LINES}, s AS (SELECT l_orderkey, {GROUP_SPLIT} AS split FROM lines)
    SELECT l_orderkey, min(split) AS split, count(DISTINCT split) AS splits, count(*) AS rows FROM s GROUP BY 1""",
)
def group_split(spark, sf_dir):
    rows = assign_split(lines(spark, sf_dir, False), "group_aware", SEED, RATIOS, ["l_orderkey"])
    code = F.when(F.col("split") == "train", 1).when(F.col("split") == "validation", 2).otherwise(4)
    return rows.groupBy("l_orderkey").agg(
        F.min("split").alias("split"),
        F.bit_count(F.bit_or(code)).cast("bigint").alias("splits"),
        F.count("*").alias("rows"),
    )


@catalog.query(
    "day_split",
    f"""WITH {LINES} SELECT day, {DAY_SPLIT} AS split, count(*) AS rows FROM lines GROUP BY ALL""",
)
def day_split_query(spark, sf_dir):
    rows = lines(spark, sf_dir, False)
    split = day_split(
        F.col("day"), group_text(rows, ["l_orderkey"]), DAY_ROLES, VALIDATION_FRACTION, SEED
    )
    return rows.groupBy("day", split.alias("split")).agg(F.count("*").alias("rows"))


_STRATEGY_SQL = {
    "auto_group_aware": GROUP_SPLIT,
    "group_aware": GROUP_SPLIT,
    "row_hash": ROW_SPLIT,
    "by_capture_day": DAY_SPLIT,
}


@catalog.query(
    "assign_split",
    f"WITH {CLASSIFIED} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS strategy, CASE WHEN NOT keep THEN NULL WHEN open_set THEN 'test' ELSE {sql} END AS split, "
        "count(*) AS rows FROM classified GROUP BY ALL"
        for name, sql in _STRATEGY_SQL.items()
    ),
)
def assign_split_query(spark, sf_dir):
    counted = [
        assigned(spark, sf_dir, strategy)
        .groupBy(F.lit(strategy).alias("strategy"), "split")
        .agg(F.count("*").alias("rows"))
        for strategy in STRATEGIES
    ]
    return reduce(DataFrame.unionByName, counted)


# ---- audit ----------------------------------------------------------------------------------------------

LINE_ID = "l_orderkey || '|' || l_linenumber"


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines split by row hash: repeated lines and orders cross splits, so there is
    something to find."""
    rows = assign_split(lines(spark, sf_dir), "row_hash", SEED, RATIOS)
    line = F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return audit.identities(rows.withColumn("line", line), "line", "l_orderkey")


def _ids_sql(split: str = ROW_SPLIT) -> str:
    return f"""{LINES}, placed AS (SELECT *, {split} AS split FROM lines),
    ids AS (SELECT 'sample' AS kind, {LINE_ID} AS id, split FROM placed WHERE split IS NOT NULL
            UNION ALL SELECT 'group', l_orderkey::VARCHAR, split FROM placed WHERE split IS NOT NULL),
    per_id AS (SELECT kind, id, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'validation') AS b,
               count(*) FILTER (split = 'test') AS c FROM ids GROUP BY ALL)"""


_PAIRS_SQL = """SELECT kind, 'train_intersection_validation' AS pair, count(*) FILTER (a > 0 AND b > 0) AS overlap FROM per_id GROUP BY 1
    UNION ALL SELECT kind, 'train_intersection_test', count(*) FILTER (a > 0 AND c > 0) FROM per_id GROUP BY 1
    UNION ALL SELECT kind, 'validation_intersection_test', count(*) FILTER (b > 0 AND c > 0) FROM per_id GROUP BY 1"""

_EXACT_SQL = """SELECT kind, count(*) AS identities,
    count(*) FILTER ((a > 0)::INT + (b > 0)::INT + (c > 0)::INT > 1) AS cross_split,
    sum(CASE WHEN kind = 'sample' THEN greatest(a - 1, 0) + greatest(b - 1, 0) + greatest(c - 1, 0) ELSE 0 END)::BIGINT
      AS duplicates_within_split,
    count(*) FILTER ((a > 0)::INT + (b > 0)::INT + (c > 0)::INT > 1) = 0 AS passed
    FROM per_id GROUP BY kind"""


@catalog.query("leakage_exact", f"WITH {_ids_sql()} {_EXACT_SQL}")
def leakage_exact(spark, sf_dir):
    return audit.leakage_exact(audited(spark, sf_dir))


@catalog.query("leakage_group_split", f"WITH {_ids_sql(GROUP_SPLIT)} {_EXACT_SQL}")
def leakage_group_split(spark, sf_dir):
    rows = assign_split(lines(spark, sf_dir, False), "group_aware", SEED, RATIOS, ["l_orderkey"])
    line = F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return audit.leakage_exact(audit.identities(rows.withColumn("line", line), "line", "l_orderkey"))


@catalog.query("leakage_pairs", f"WITH {_ids_sql()} {_PAIRS_SQL}")
def leakage_pairs(spark, sf_dir):
    return audit.leakage_pairs(audited(spark, sf_dir))


@catalog.query(
    "leakage_sampled",
    f"""WITH {_ids_sql()},
    kept AS (SELECT * FROM per_id WHERE ('0x' || substr(md5('{audit.AUDIT_SALT}|' || id), 1, 8))::BIGINT % {AUDIT_DIVISOR} = 0),
    seen AS (SELECT kind, count(*) AS identities_seen FROM ids GROUP BY 1)
    SELECT kind, any_value(identities_seen) AS identities_seen,
      sum((a > 0)::INT + (b > 0)::INT + (c > 0)::INT)::BIGINT AS tracked_distinct,
      sum(CASE WHEN kind = 'sample' THEN greatest(a - 1, 0) + greatest(b - 1, 0) + greatest(c - 1, 0) ELSE 0 END)::BIGINT
        AS duplicates_within_split,
      count(*) FILTER (a > 0 AND b > 0) AS train_validation, count(*) FILTER (a > 0 AND c > 0) AS train_test,
      count(*) FILTER (b > 0 AND c > 0) AS validation_test,
      count(*) FILTER (a > 0 AND b > 0) + count(*) FILTER (a > 0 AND c > 0) + count(*) FILTER (b > 0 AND c > 0) AS cross_split,
      {r(f"pow(1 - 1.0 / {AUDIT_DIVISOR}, 100)")} AS escape_probability
    FROM kept JOIN seen USING (kind) GROUP BY kind""",
)
def leakage_sampled(spark, sf_dir):
    return rounded(audit.leakage_sampled(audited(spark, sf_dir), AUDIT_DIVISOR))


@catalog.query(
    "audit_scope",
    f"""WITH {_ids_sql(DAY_SPLIT).replace(
        "per_id AS (SELECT", "scoped AS (SELECT * FROM ids WHERE kind = 'sample' OR split <> 'test'), per_id AS (SELECT"
    ).replace("FROM ids GROUP BY ALL", "FROM scoped GROUP BY ALL")} {_PAIRS_SQL}""",
)
def audit_scope(spark, sf_dir):
    rows = assign_split(
        lines(spark, sf_dir, False),
        "by_capture_day",
        SEED,
        RATIOS,
        ["l_orderkey"],
        "day",
        DAY_ROLES,
        VALIDATION_FRACTION,
    )
    line = F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    ids = audit.identities(rows.withColumn("line", line), "line", "l_orderkey")
    return audit.leakage_pairs(audit.audit_scope(ids, "by_capture_day"))


@catalog.query(
    "trainable_open_overlap",
    """SELECT DISTINCT lang AS label FROM documents JOIN labels USING (doc_id) WHERE quality = 1
    INTERSECT SELECT DISTINCT lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 1""",
)
def trainable_open_overlap(spark, sf_dir):
    marked = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label")).join(
        read(spark, sf_dir, "labels"), "doc_id"
    )
    return labels.trainable_open_overlap(
        marked.where(F.col("quality") == 1), marked.where(F.col("toxic") == 1)
    )


# ---- the row account --------------------------------------------------------------------------------------


@catalog.query(
    "split_class_counts",
    f"""WITH {ASSIGNED_DEFAULT} SELECT label, open_set, count(*) FILTER (split = 'train') AS train,
    count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test
    FROM assigned GROUP BY ALL""",
)
def split_class_counts(spark, sf_dir):
    return accounting.split_class_counts(assigned(spark, sf_dir))


@catalog.query(
    "split_sizes",
    f"WITH {ASSIGNED_DEFAULT} SELECT split, count(*) AS rows FROM assigned WHERE split IS NOT NULL GROUP BY 1",
)
def split_sizes(spark, sf_dir):
    return accounting.split_sizes(assigned(spark, sf_dir))


_RARE = """rare AS (SELECT o_orderkey, CASE WHEN o_orderkey % 1500 = 7 THEN 'rare ' || (o_orderkey % 7) ELSE o_orderpriority END AS label FROM orders)"""


def _rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a few rare labels, so that some splits miss some of them."""
    key = F.col("o_orderkey")
    name = F.concat(F.lit("rare "), (key % 7).cast("string"))
    label = F.when(key % 1500 == 7, name).otherwise(F.col("o_orderpriority"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"))
    return orders.withColumn("open_set", F.lit(False)).withColumn(
        "split", hash_split(key, RATIOS, SEED)
    )


_MISSING_SQL = f"""{_RARE}, placed AS (SELECT label, {split_case("o_orderkey")} AS split FROM rare),
  grid AS (SELECT label, split FROM (SELECT DISTINCT label FROM placed), (VALUES ('train'), ('validation'), ('test')) v(split)),
  absent AS (SELECT split, label FROM grid EXCEPT SELECT split, label FROM placed)"""


@catalog.query("missing_classes", f"WITH {_MISSING_SQL} SELECT split, label FROM absent")
def missing_classes(spark, sf_dir):
    return accounting.missing_classes(accounting.split_class_rows(_rare(spark, sf_dir)))


@catalog.query(
    "preflight_coverage",
    f"""WITH {_MISSING_SQL}
    SELECT label, false AS open_set, split, count(*) AS rows, false AS missing FROM placed GROUP BY label, split
    UNION ALL SELECT label, false, split, 0, true FROM absent""",
)
def preflight_coverage(spark, sf_dir):
    return accounting.preflight_coverage(_rare(spark, sf_dir))


@catalog.query(
    "preflight_agrees",
    f"""WITH {ASSIGNED_DEFAULT}, a AS (SELECT DISTINCT label, split FROM assigned WHERE split IS NOT NULL),
    b AS (SELECT DISTINCT label, {GROUP_SPLIT} AS split FROM lines)
    SELECT label, split, 'preflight' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT label, split, 'realised' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def preflight_agrees(spark, sf_dir):
    """A split made without the label policy does not agree with one made with it."""
    planned = drop_unassigned(assigned(spark, sf_dir)).select("label", "split").distinct()
    careless = assign_split(lines(spark, sf_dir, False), "group_aware", SEED, RATIOS, ["l_orderkey"])
    return accounting.preflight_agrees(planned, careless.select("label", "split").distinct())


@catalog.query(
    "row_accounting",
    f"""WITH {assigned_sql(DAY_SPLIT)}, t AS (SELECT count(*) AS rows_read, count(*) FILTER (NOT keep) AS excluded_by_label,
    count(*) FILTER (keep AND split IS NULL) AS excluded_by_split, count(*) FILTER (split = 'train') AS rows_train,
    count(*) FILTER (split = 'validation') AS rows_validation, count(*) FILTER (split = 'test') AS rows_test FROM assigned)
    SELECT *, rows_train + rows_validation + rows_test AS rows_written,
    rows_read - excluded_by_label - excluded_by_split = rows_train + rows_validation + rows_test AS balanced FROM t""",
)
def row_accounting(spark, sf_dir):
    return accounting.row_accounting(assigned(spark, sf_dir, "by_capture_day"))


@catalog.query(
    "label_integrity",
    f"""WITH {LINES}, coded AS (SELECT {GROUP_SPLIT} AS split, CASE WHEN label = 'R-F' THEN -1 ELSE l_linenumber END AS _label FROM lines),
    codes AS (SELECT count(DISTINCT _label) AS n, min(_label) AS lo, max(_label) AS hi FROM coded WHERE _label <> -1)
    SELECT 'open-set rows outside test' AS problem, split, _label::INTEGER AS _label, count(*) AS rows FROM coded
    WHERE _label = -1 AND split <> 'test' GROUP BY ALL
    UNION ALL SELECT 'codes are not contiguous from zero', NULL, hi::INTEGER, n FROM codes WHERE n > 0 AND (lo <> 0 OR hi <> n - 1)""",
)
def label_integrity(spark, sf_dir):
    """A careless encoding: withheld rows in every split, codes that start at one."""
    rows = assign_split(lines(spark, sf_dir, False), "group_aware", SEED, RATIOS, ["l_orderkey"])
    code = F.when(F.col("label") == "R-F", F.lit(-1)).otherwise(F.col("l_linenumber"))
    return accounting.label_integrity(rows.withColumn("_label", code))


@catalog.query(
    "class_distribution",
    f"""WITH {_MISSING_SQL} SELECT split, label, count(*) AS rows FROM placed GROUP BY ALL
    UNION ALL SELECT split, label, 0 FROM absent""",
)
def class_distribution(spark, sf_dir):
    rows = _rare(spark, sf_dir)
    return accounting.class_distribution(rows, labels.label_mapping(rows)).select(
        "split", "label", "rows"
    )


