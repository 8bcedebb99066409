"""Near-duplicate vectors by a forest of random-projection trees with spill.

A tree halves the vectors of a label again and again: every level projects on a random direction and
each node cuts at its median, known from a bounded sample. A vector close to a cut goes to both sides.
Vectors that share a leaf of any tree are compared, and a pair counts in its first common leaf only,
so that leaves add up link counts and fold links into trees without writing pairs down.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import Forest, connected
from plumbline.llm.frames import stored

TREES, LEAF, SPILL = 6, 512, 0.02
#: Vectors that cuts are taken from (about), and the least of them that make a median.
SAMPLE, LEAST = 20_000, 8
#: Vectors in a block of a leaf; blocks of larger leaves are compared two by two.
BLOCK = 2048


@dataclass(frozen=True)
class Cuts:
    """Depth and medians, by group of vectors: cuts[group][tree][node]; an unknown node cuts at 0."""

    seed: int
    depth: dict[tuple, int]
    cuts: dict[tuple, list[dict[int, float]]]

    def directions(self, tree: int, depth: int, size: int) -> np.ndarray:
        """One unit direction a level."""
        out = np.stack([np.random.default_rng([self.seed, tree, level, size]).normal(size=size) for level in range(depth)])
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    def leaves(self, group: tuple, unit: np.ndarray, trees: int, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of unit vectors of one group; a vector has one leaf or more in each tree."""
        rows, found = [], []
        depth = self.depth[group]
        for tree in range(trees):
            row, node = np.arange(len(unit)), np.ones(len(unit), dtype=np.int64)
            if depth:
                along = unit @ self.directions(tree, depth, unit.shape[1]).T
                known = self.cuts.get(group, [{}] * trees)[tree]
                for level in range(depth):
                    names, inverse = np.unique(node, return_inverse=True)
                    cut = np.array([known.get(int(n), 0.0) for n in names])[inverse]
                    place = along[row, level]
                    left, right = place <= cut + spill, place > cut - spill
                    row = np.concatenate([row[left], row[right]])
                    node = np.concatenate([2 * node[left], 2 * node[right] + 1])
            rows.append(row)
            found.append((np.int64(tree) << np.int64(48)) + node)
        return np.concatenate(rows), np.concatenate(found)


def _unit(vectors: list) -> np.ndarray:
    out = np.array(vectors, dtype=np.float64)
    # First by the largest component, so that no square over- or underflows.
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def fit(classes: DataFrame, trees: int, leaf: int, sample: int, seed: int) -> Cuts:
    """Depths from the sizes of the groups, cuts from about ``sample`` vectors. Groups are labels and
    lengths, taken to be few."""
    sizes = {(r["label"], r["dim"]): r["n"] for r in classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    depth = {g: max(0, int(np.ceil(np.log2(n / leaf)))) for g, n in sizes.items()}
    space = 1 << 30
    drawn = classes.where(F.pmod(F.xxhash64("key"), F.lit(space)) < int(space * min(1.0, sample / max(total, 1))))
    found = drawn.select("label", "dim", "embedding").toArrow().to_pandas()
    out = Cuts(seed, depth, {})
    for group, part in found.groupby(["label", "dim"]):
        group = (int(group[0]), int(group[1]))
        unit = _unit([np.asarray(v, dtype=np.float64) for v in part["embedding"]])
        known: list[dict[int, float]] = []
        for tree in range(trees):
            known.append({})
            if not depth[group]:
                continue
            along = unit @ out.directions(tree, depth[group], unit.shape[1]).T
            node = np.ones(len(unit), dtype=np.int64)
            for level in range(depth[group]):
                order = np.argsort(node, kind="stable")
                names, first = np.unique(node[order], return_index=True)
                for name, rows in zip(names, np.split(order, first[1:]), strict=True):
                    if len(rows) >= LEAST:
                        known[tree][int(name)] = float(np.median(along[rows, level]))
                cut = np.array([known[tree].get(int(n), 0.0) for n in node])
                node = 2 * node + (along[:, level] > cut)
        out.cuts[group] = known
    return out


def near_vectors(
    vectors: DataFrame,
    least: float = 0.98,
    trees: int = TREES,
    leaf: int = LEAF,
    spill: float = SPILL,
    sample: int = SAMPLE,
    seed: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Vectors of one label (of any type) and length link when they share a leaf and their cosine, in doubles, is at least
    ``least``. A vector that is null, zero, or holds a null or non-finite component, and one without a
    label, links with nothing. Equal vectors form a class that is compared once; each of its rows links
    with the others. Rows of equal id are vectors of their own. ``component_id`` is the smallest id that
    links reach, null only if all of them are null, and ``kept`` says that it is the row's own.
    """
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    usable = usable & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = usable & F.exists("embedding", lambda x: x != 0)
    rows = stored(
        vectors.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(vec_id).alias("vec_id"),
            # Labels of any type are only ever compared: 64 bits of their hash stand for them.
            F.when(F.col(label).isNotNull(), F.xxhash64(F.col(label))).alias("label"),
            F.transform(F.col(embedding).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("embedding"),
        )
        .withColumn("usable", F.coalesce(usable, F.lit(False)))
        .withColumn("d1", F.xxhash64("label", "embedding"))
        .withColumn("d2", F.xxhash64(F.lit(1), "label", "embedding")),
        "vectors",
    )
    classes = stored(
        rows.where("usable")
        .groupBy("d1", "d2")
        .agg(
            F.min("row").alias("key"),
            F.min("vec_id").alias("least_id"),
            F.count(F.lit(1)).alias("weight"),
            F.first("label").alias("label"),
            F.first("embedding").alias("embedding"),
        )
        .withColumn("dim", F.size("embedding")),
        "classes",
    )
    cuts = vectors.sparkSession.sparkContext.broadcast(fit(classes, trees, leaf, sample, seed))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for (name, dim), part in frame.groupby(["label", "dim"]):
                unit = _unit([np.asarray(v) for v in part["embedding"]])
                row, found = cuts.value.leaves((int(name), int(dim)), unit, trees, spill)
                order = np.lexsort((found, row))
                row, found = row[order], found[order]
                every = np.split(found, np.searchsorted(row, np.arange(1, len(unit))))
                yield pa.record_batch(
                    [
                        pa.array(part["key"].to_numpy()[row], pa.int64()),
                        pa.array(part["weight"].to_numpy()[row], pa.int64()),
                        pa.array(np.full(len(row), name), pa.int64()),
                        pa.array(np.full(len(row), dim), pa.int32()),
                        pa.array(found, pa.int64()),
                        pa.array([every[r] for r in row], pa.list_(pa.int64())),
                        pa.array([unit[r] for r in row], pa.list_(pa.float64())),
                    ],
                    names=["key", "weight", "label", "dim", "leaf", "leaves", "unit"],
                )

    schema = "key long, weight long, label long, dim int, leaf long, leaves array<long>, unit array<double>"
    placed = stored(classes.select("key", "weight", "label", "dim", "embedding").mapInArrow(place, schema), "leaves")
    counts = placed.groupBy("label", "dim", "leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    tiled = (
        placed.join(counts, ["label", "dim", "leaf"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .select("label", "dim", "leaf", "i", "j", "own", "key", "weight", "leaves", "unit")
    )

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("key")
        here = int(tile["leaf"].iloc[0])
        key, weight, side = tile["key"].to_numpy(), tile["weight"].to_numpy(), tile["own"].to_numpy()
        unit = np.stack(tile["unit"].to_list())
        leaves = [frozenset(x.tolist()) for x in tile["leaves"]]
        links, forest = np.zeros(len(key), dtype=np.int64), Forest()
        cross = tile["i"].iloc[0] != tile["j"].iloc[0]
        for start in range(0, len(key), 256):
            a, b = np.nonzero(unit[start : start + 256] @ unit.T >= least)
            a += start
            keep = (a < b) & (side[a] != side[b] if cross else True)
            for x, y in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
                if min(leaves[x] & leaves[y]) == here:
                    links[x] += weight[y]
                    links[y] += weight[x]
                    forest.link(int(key[x]), int(key[y]))
        linked = links > 0
        return pd.DataFrame(
            {"key": key[linked], "links": links[linked], "root": [forest.root(int(k)) for k in key[linked]]}
        )

    linked = stored(
        tiled.groupBy("label", "dim", "leaf", "i", "j").applyInPandas(compare, "key long, links long, root long"), "linked"
    )
    roots = connected(linked.select(F.col("key").alias("a"), F.col("root").alias("b")))
    degree = linked.groupBy(F.col("key").alias("at")).agg(F.sum("links").alias("links"))
    named = (
        classes.join(roots, F.col("key") == F.col("node"), "left")
        .join(degree, F.col("key") == F.col("at"), "left")
        .select("d1", "d2", "least_id", F.coalesce("root", "key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    least_ids = named.groupBy(F.col("root").alias("top")).agg(F.min("least_id").alias("component"))
    found = named.join(least_ids, F.col("root") == F.col("top")).select(
        F.col("d1").alias("e1"), F.col("d2").alias("e2"), "n_links", "component"
    )
    joined = rows.join(found, F.col("usable") & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
    component = F.when(F.col("usable"), F.col("component")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), component.isNull()).alias("kept"),
    )
