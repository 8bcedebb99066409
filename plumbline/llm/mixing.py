"""Mix sources to target weights by balanced sampling with the cube method.

Every document of a source has the same expected number of copies, target / size of the source. Its
whole part is taken outright; the fraction is an inclusion probability. The flight phase moves the
probabilities of a block along a direction that changes neither the expected words nor the expected
number of documents, until at most two of them are still fractions. Blocks are independent, so a
level is one grouped job, and what is left of all blocks is the input of the next, about 500 times
smaller. When one block per source is left, the landing decides its last two documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.frames import WORD, small_side, stored

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
#: Documents in a block of the flight phase.
BLOCK_ROWS = 1000
_EDGE = 1e-9


def source_targets(
    sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES
) -> DataFrame:
    """source, source_size, target: one row per source, the null source last in the order of weights.

    Sources share the total size by weight. A target stops at ``max_copies`` times its source's size
    and what it leaves is shared by the others again. Sorted by the share at which they fill up, the
    sources before one that is not full are full, so the share per weight is the largest of what the
    rest has left at any place of that order. The windows hold one row per source.
    """
    every = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("place")).rowsBetween(Window.unboundedPreceding, -1)
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    left = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))
    )
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(ordered))
        .withColumn("weight", turn)
        .withColumn("cap", (F.col("source_size") * max_copies).cast("double"))
        .withColumn("left", left)
        .withColumn("share", F.max("left").over(every))
        .select("source", "source_size", F.least("cap", F.col("weight") * F.col("share")).alias("target"))
    )


def flight(sizes: np.ndarray, chances: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Move chances to 0 or 1, keeping their sum and their sum weighted by size; two may stay between.

    ``land`` decides these two as well, first keeping their sum and then by chance.
    """
    out = chances.copy()
    held: list[int] = []
    draws = rng.random(2 * len(out) + 2)
    step = 0
    waiting = iter(range(len(out)))
    while True:
        while len(held) < 3 and (more := next(waiting, None)) is not None:
            if _EDGE < out[more] < 1 - _EDGE:
                held.append(more)
            else:
                out[more] = round(out[more])
        if len(held) < (1 if land else 3):
            return out
        if len(held) == 3:
            a, b, c = (sizes[i] for i in held)
            move = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
        else:
            move = (1.0, -1.0) if len(held) == 2 else (1.0,)
        up = down = np.inf
        for i, m in zip(held, move, strict=True):
            if m > 0:
                up, down = min(up, (1 - out[i]) / m), min(down, out[i] / m)
            elif m < 0:
                up, down = min(up, -out[i] / m), min(down, (out[i] - 1) / m)
        by = up if draws[step] * (up + down) < down else -down
        step += 1
        for i, m in zip(held, move, strict=True):
            out[i] += by * m
            if out[i] <= _EDGE or out[i] >= 1 - _EDGE:
                out[i] = round(out[i])
        held = [i for i in held if 0 < out[i] < 1]


def _fly(units: DataFrame, blocks: F.Column, level: int, seed: int, land: bool) -> DataFrame:
    """One level: units (key, source, size, chance) in blocks, each by one flight."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "order", "key"], ascending=[False, True, True], kind="stable")
        name = block["source"].iloc[0]
        number = int(block["block"].iloc[0])
        rng = np.random.default_rng([seed, level, number, zlib.crc32(repr(name).encode())])
        chances = flight(block["size"].to_numpy(float), block["chance"].to_numpy(float), rng, land)
        return block.assign(chance=chances)[["key", "source", "size", "order", "chance"]]

    schema = "key long, source string, size long, order long, chance double"
    return (
        units.withColumn("block", F.pmod(F.xxhash64("order", F.lit(level)), blocks))
        .groupBy("source", "block")
        .applyInPandas(run, schema)
    )


def select_balanced(units: DataFrame, seed: int = 17, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, picked (0 or 1) of units (key, source, size, order, chance), balanced per source."""
    decided = None
    level = 0
    while True:
        counts = units.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        largest = counts.agg(F.max("n")).first()[0] or 0
        land = largest <= 2 * block_rows
        number = counts.select(
            F.col("source").alias("s"),
            (F.lit(1) if land else F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows))).cast("long").alias("blocks"),
        )
        joined = units.join(F.broadcast(number), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        flown = stored(_fly(joined, F.col("blocks"), level, seed, land), f"flight-{level}")
        done = flown.where("chance <= 0 or chance >= 1").select("key", F.col("chance").cast("int").alias("picked"))
        decided = done if decided is None else decided.unionByName(done)
        if land:
            return decided
        units = flown.where("chance > 0 and chance < 1")
        level += 1


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    seed: int = 17,
    block_rows: int = BLOCK_ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Per row: doc_id, size, source_size, target, copies, taken = size * copies.

    A null text has size 0, a null source is a source of its own. An empty table, or one without words,
    takes nothing. Rows of equal id are different documents. The result depends on ids, sources and
    sizes only, not on how the rows are dealt to tasks; rows that agree in all three may swap copies.
    Rows without an id are told apart by their place in the scan. The number of sources is taken to be
    small against the rows: their table is broadcast.
    """
    sized = stored(
        docs.select(
            F.monotonically_increasing_id().alias("key"),
            F.col(doc_id).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            word_count(text).alias("size"),
        ),
        "sized",
    )
    targets = stored(source_targets(sized, weights, max_copies), "targets")
    rates = targets.select(
        F.col("source").alias("s"),
        "source_size",
        F.coalesce("target", F.lit(0.0)).alias("target"),
        F.least(
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0),
            F.lit(float(max_copies)),
        ).alias("rate"),
    )
    whole = F.floor(F.col("rate") + _EDGE)
    units = (
        sized.join(F.broadcast(rates), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("chance", F.greatest(F.lit(0.0), F.col("rate") - whole))
        .withColumn("order", F.xxhash64(F.coalesce("doc_id", "key"), "size", F.lit(seed)))
    )
    picked = select_balanced(units.select("key", "source", "size", "order", "chance"), seed, block_rows)
    copies = (whole + F.coalesce("picked", F.lit(0))).cast("long")
    return (
        sized.join(picked, "key", "left")
        .join(F.broadcast(rates), F.col("source").eqNullSafe(F.col("s")))
        .select(
            "doc_id",
            "key",
            "source",
            "size",
            "source_size",
            "target",
            copies.alias("copies"),
            (F.col("size") * copies).alias("taken"),
        )
    )


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    ``docs`` is read twice and has to give its rows in the same partitions each time, as a table does.
    """
    copies = mix_sources(docs, doc_id=doc_id, text=text, source=source, **settings)
    copies = copies.where("copies > 0").select(F.col("key").alias("__key"), F.col("copies").alias("__copies"))
    return (
        docs.withColumn("__row", F.monotonically_increasing_id())
        .join(small_side(copies), F.col("__row") == F.col("__key"))
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
        .select(*docs.columns)
    )
