"""A manifest of a table as Merkle trees, and proofs climbed by a recursive query.

Every row is a leaf. The leaves of a source, in order, are hashed in runs of FAN, the runs' nodes again,
until one is left; what is left of each source is hashed likewise into the root. The levels are written as
node rows that name their parent and their place below it and hold the digests of their children. A
Spark recursive query then climbs from the leaves: each step joins the parents' rows, appends the siblings and
folds the digest one level up. Leaves of one run share all siblings above it, so they climb in one row.

Digests are 32 bytes in the tables and lower-case hexadecimal text where they are hashed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.frames import small_side, stored

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the sources; the others are numbered from 0 in the sources' order.
SOURCES = -1
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def field(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    value = column.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


@dataclass(frozen=True)
class Manifest:
    """``leaves``: tree, place, doc_id, source, leaf, altered, and the parent as up_tree, up_level, up_place, slot.
    ``nodes``: tree, level, place, digest, children, top and the parent likewise."""

    leaves: DataFrame
    nodes: DataFrame


def _numbered(frame: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """The rows with ``place``, their number from 0 in the order within ``group``, and ``width``, the rows of the group.

    ``order`` starts with the group. Rows are sorted in ranges; a range's rows of a group are numbered by
    their place in it after the counts of the ranges before, so no group has to fit into one task.
    """
    ranged = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(ranged.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    runs = found.groupBy(part.alias("run_part"), *[F.col(g).alias(f"run_{g}") for g in group]).agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n")
    )
    mine = Window.partitionBy(*[f"run_{g}" for g in group]) if group else Window.partitionBy(F.lit(0))
    before = mine.orderBy("run_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("width", F.sum("n").over(mine))
    on = part == F.col("run_part")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"run_{g}"))
    return (
        found.join(small_side(runs), on)
        .withColumn("place", F.col("before") + F.col("at") - F.col("first"))
        .select(*frame.columns, "place", "width")
    )


def _parent(level: Column, place: Column, width: Column, sources: Column) -> list[Column]:
    """up_tree, up_level, up_place and slot of a node of a tree with ``width`` nodes on its level."""
    inner = width > 1
    outer = ~inner & (F.col("tree") >= 0) & (sources > 1)
    at = F.when(inner, place).when(outer, F.col("tree"))
    return [
        F.when(inner, F.col("tree")).when(outer, F.lit(SOURCES)).cast("long").alias("up_tree"),
        F.when(inner, level + 1).when(outer, F.lit(1)).cast("int").alias("up_level"),
        F.floor(at / FAN).cast("long").alias("up_place"),
        F.pmod(at, F.lit(FAN)).cast("int").alias("slot"),
    ]


def build(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    key: str = "doc_id",
    source: str = "source",
    altered: list[Column] | None = None,
) -> Manifest:
    """The trees of a table. Leaves hash ``fields`` in this order; other columns are not read.

    Leaves of a source ascend by ``key`` (null first) and, where keys repeat, by their digest; sources
    ascend by their bytes, null first. ``altered`` gives what the fields hold after tampering. A source
    of one row has its leaf for a subroot, a table of one source that subroot for a root; an empty
    table has no leaves and no nodes. Nulls and empty texts hash differently.
    """
    digest = leaf_digest([F.col(f) for f in fields])
    changed = digest if altered is None else leaf_digest(altered)
    first = stored(
        docs.select(
            F.col(key).alias("doc_id"), F.col(source).alias("source"), digest.alias("leaf"), changed.alias("altered")
        ),
        "leaf-digests",
    )
    names = first.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    trees = stored(
        _numbered(names, [], [F.col("source").asc_nulls_first()], "sources").select(
            F.col("source").alias("name"), F.col("place").alias("tree"), F.col("width").alias("sources")
        ),
        "trees",
    )
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    placed = _numbered(first, ["source"], order, "sorted")
    placed = placed.join(small_side(trees), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    level = F.lit(0)
    leaves = stored(
        placed.select("*", *_parent(level, F.col("place"), F.col("width"), F.col("sources"))).drop("up"), "leaves"
    )
    bounds = leaves.agg(F.max("width").alias("width"), F.max("sources").alias("sources")).first()
    below = leaves.select("tree", "place", F.col("leaf").alias("digest"), "width", "sources", *_UP)
    levels, tops = [], [below.where("width = 1")]
    for number in range(1, 64):
        if (bounds["width"] or 0) <= FAN ** (number - 1):
            break
        below = _level(below, number, F.col("up_tree") >= 0)
        levels.append(below)
        tops.append(below.where("width = 1"))
    below = tops[0]
    for top in tops[1:]:
        below = below.unionByName(top.select(*below.columns))
    for number in range(1, 64):
        if (bounds["sources"] or 0) <= FAN ** (number - 1):
            break
        below = _level(below, number, F.col("up_tree") == SOURCES)
        levels.append(below)
    nodes = _level(below, 1, F.lit(False)) if not levels else levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    return Manifest(leaves, nodes)


_UP = ("up_tree", "up_level", "up_place", "slot")


def _level(below: DataFrame, number: int, which: Column) -> DataFrame:
    """The written nodes of a level over the rows below that have ``which`` parent. A node has at most FAN children."""
    sorted_children = F.sort_array(F.collect_list(F.struct("slot", "digest")))
    hexed = F.lower(F.array_join(F.transform(sorted_children, lambda c: F.hex(c["digest"])), ""))
    # In the tree of the sources every child counts the sources, in the others the nodes on its level.
    wide = F.when(F.col("up_tree") == SOURCES, F.ceil(F.col("sources") / FAN**number)).otherwise(F.ceil(F.col("width") / FAN))
    nodes = (
        below.where(which)
        .groupBy(F.col("up_tree").alias("tree"), F.col("up_level").alias("level"), F.col("up_place").alias("place"))
        .agg(hexed.alias("hexed"), F.max(wide).cast("long").alias("width"), F.max("sources").alias("sources"))
        .select(
            "tree",
            "level",
            "place",
            F.unhex(F.sha2("hexed", 256)).alias("digest"),
            F.unhex("hexed").alias("children"),
            ((F.col("tree") >= 0) & (F.col("width") == 1)).alias("top"),
            "width",
            "sources",
        )
    )
    return stored(nodes.select("*", *_parent(F.col("level"), F.col("place"), F.col("width"), F.col("sources"))), f"level-{number}")


def _siblings(children: str, slot: str) -> str:
    """SQL for the other digests of a run, as bytes."""
    return f"concat(substring({children}, 1, 32 * {slot}), substring({children}, 32 * {slot} + 33))"


def _folded(children: str, slot: str, digest: str) -> str:
    """SQL for the parent's digest when the child at ``slot`` has this digest."""
    run = f"concat(substring({children}, 1, 32 * {slot}), {digest}, substring({children}, 32 * {slot} + 33))"
    return f"unhex(sha2(lower(hex({run})), 256))"


_CLIMB = f"""
WITH RECURSIVE climb AS (
    SELECT run_tree, run_level, run_place, folded, X'' AS above, subroot, root, up_tree, up_level, up_place, slot
    FROM {{runs}}
    UNION ALL
    SELECT c.run_tree, c.run_level, c.run_place,
           transform(c.folded, d -> {_folded("n.children", "c.slot", "d")}),
           concat(c.above, {_siblings("n.children", "c.slot")}),
           coalesce(c.subroot, CASE WHEN n.top THEN n.digest END), n.digest,
           n.up_tree, n.up_level, n.up_place, n.slot
    FROM climb c JOIN {{nodes}} n ON c.up_tree = n.tree AND c.up_level = n.level AND c.up_place = n.place)
SELECT run_tree, run_level, run_place, folded, above, subroot, root FROM climb WHERE up_level IS NULL
"""


def climb(manifest: Manifest) -> DataFrame:
    """One row per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; digests as hex text.

    The folded root starts from the altered leaf, its siblings are the original ones. A leaf without
    siblings has the hash of nothing for a proof.
    """
    spark = manifest.leaves.sparkSession
    nodes = manifest.nodes
    member = F.struct("slot", "place", "doc_id", "leaf", "altered")
    runs = manifest.leaves.groupBy(
        F.col("up_tree").alias("run_tree"), F.col("up_level").alias("run_level"), F.col("up_place").alias("run_place")
    ).agg(F.sort_array(F.collect_list(member)).alias("members"))
    first = nodes.withColumnsRenamed({c: f"n_{c}" for c in ("tree", "level", "place")})
    here = (F.col("run_tree") == F.col("n_tree")) & (F.col("run_level") == F.col("n_level"))
    runs = runs.join(first, here & (F.col("run_place") == F.col("n_place")), "left")
    start = stored(
        runs.select(
            "run_tree",
            "run_level",
            "run_place",
            "members",
            "children",
            F.when(F.col("top"), F.col("digest")).alias("subroot"),
            F.col("digest").alias("root"),
            F.expr(
                "transform(members, m -> CASE WHEN children IS NULL THEN m.altered ELSE "
                f"{_folded('children', 'm.slot', 'm.altered')} END)"
            ).alias("folded"),
            *_UP,
        ),
        "runs",
    )
    parents = small_side(nodes.select("tree", "level", "place", "digest", "children", "top", *_UP))
    limit = spark.conf.get(ROW_LIMIT)
    # The climb gives a row for each run and level. The default limit is for runaway queries; this one ends at the root.
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        ended = stored(spark.sql(_CLIMB, runs=start.drop("members", "children"), nodes=parents), "climbed")
    finally:
        spark.conf.set(ROW_LIMIT, limit)
    ended = ended.select(*[F.col(c).alias(f"end_{c}") for c in ended.columns])
    same = (
        F.col("run_tree").eqNullSafe(F.col("end_run_tree"))
        & F.col("run_level").eqNullSafe(F.col("end_run_level"))
        & F.col("run_place").eqNullSafe(F.col("end_run_place"))
    )
    own = f"CASE WHEN children IS NULL THEN X'' ELSE {_siblings('children', 'm.slot')} END"
    found = (
        start.select("run_tree", "run_level", "run_place", "members", "children")
        .join(ended, same)
        .select("children", *ended.columns, F.posexplode("members").alias("at", "m"))
        .select(
            F.col("m.doc_id").alias("doc_id"),
            F.col("m.leaf").alias("leaf"),
            F.coalesce("end_subroot", "m.leaf").alias("subroot"),
            F.coalesce("end_root", "m.leaf").alias("root"),
            F.sha2(F.expr(f"lower(hex(concat({own}, end_above)))"), 256).alias("proof_sha256"),
            F.expr("end_folded[at]").alias("folded_root"),
        )
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "folded_root")})
