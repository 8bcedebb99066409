"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger holds the measurements and one long whose bit i
says that rule i failed. A policy is a version with a mask: it rejects a document when a rule of its
mask failed. Changing a policy or asking what a rule alone costs reads the ledger, never the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shingles
from plumbline.llm.frames import map_batches

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_letters",
    "n_capitals",
)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STARTS = np.ones(256, dtype=bool)
_STARTS[0x80:0xC0] = False
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_LETTER = _CAPITAL.copy()
_LETTER[97:123] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    running = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return running[offsets[1:]] - running[offsets[:-1]]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur more than once."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def _measure(texts: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = shingles.utf8(texts)
    hashes, before, starts, ends = shingles.words(texts)
    out = {"n_words": np.diff(before)}
    character = _STARTS[data]
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    out["word_chars"] = _per_text(character & (np.cumsum(inside[:-1], dtype=np.int8) > 0), offsets)
    out["n_symbols"] = _per_text(_SYMBOL[data], offsets)
    out["n_letters"] = _per_text(_LETTER[data], offsets)
    out["n_capitals"] = _per_text(_CAPITAL[data], offsets)

    # Lines with a word: repeats of a line are those beyond the first of each text and hash.
    cuts = np.flatnonzero(data == 0x0A)
    owner = np.repeat(np.arange(len(before) - 1), np.diff(offsets) > 0)
    begin = np.concatenate([offsets[:-1][np.diff(offsets) > 0], cuts + 1])
    owner = np.concatenate([owner, np.searchsorted(offsets, cuts, side="right") - 1])
    order = np.argsort(begin, kind="stable")
    begin, owner = begin[order], owner[order]
    end = np.minimum(np.append(begin[1:], len(data)), offsets[owner + 1]) if len(begin) else begin
    full = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, owner = begin[full], end[full], owner[full]
    end = np.where(data[np.maximum(end - 1, 0)] == 0x0A, end - 1, end) if len(end) else end
    out["n_lines"] = np.bincount(owner, minlength=len(before) - 1)
    with np.errstate(over="ignore"):
        key = shingles.mix(shingles.spans(data, begin, end) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.unique(key, return_index=True)[1]
    out["n_dup_lines"] = out["n_lines"] - np.bincount(owner[first], minlength=len(before) - 1)

    # Words of a three-word window that occurs twice or more in its text.
    grams, first = shingles.windows(hashes, before, 3)
    number = np.diff(first)
    text = np.repeat(np.arange(len(number)), number)
    at = np.arange(len(grams)) - np.repeat(first[:-1] - before[:-1], number)
    with np.errstate(over="ignore"):
        key = shingles.mix(grams + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = at[_repeats(key)]
    covered = np.zeros(len(hashes) + 2, dtype=bool)
    for step in range(3):
        covered[at + step] = True
    out["n_repeat_words"] = _per_text(covered[: len(hashes)], before)
    return out


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the measurements of every whole text, one row per row.

    A null or empty text measures 0 everywhere. Repeated rows are measured again; other columns of
    ``docs`` are not read.
    """
    names = [f"k{i}" for i in range(len(keep))]
    frame = docs.select(*[F.col(k).alias(n) for k, n in zip(keep, names, strict=True)], F.col(text).alias("t"))
    kinds = dict(frame.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("t")
        found = [_measure(texts.slice(a, b - a)) for a, b in shingles.pieces(texts)]
        return pa.record_batch(
            [batch.column(n) for n in names]
            + [pa.array(np.concatenate([f[m] for f in found]), pa.int64()) for m in MEASURES],
            names=[*names, *MEASURES],
        )

    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), *(f"{m} long" for m in MEASURES)])
    measured = map_batches(frame, run, schema)
    return measured.select(*[F.col(n).alias(k) for k, n in zip(keep, names, strict=True)], *MEASURES)


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str


#: Bit i of the ledger belongs to rule i. New rules are appended; a bit never changes its meaning.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 2 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("capitals", "2 * n_capitals > n_letters"),
)


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        names = [r.name for r in rules]
        return sum(1 << names.index(name) for name in self.rules)


BASE = Policy(0, ("few_words", "repeated_windows"))
CURRENT = Policy(1, tuple(r.name for r in RULES))


def ledger(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements with ``failures``: bit i is set where rule i failed. Each rule runs once."""
    bits = [F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(0).cast("long") for i, rule in enumerate(rules)]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return measured.withColumn("failures", failures)


def apply_policy(entries: DataFrame, policy: Policy, column: str = "kept") -> DataFrame:
    """Keep a document when none of the policy's rules failed."""
    return entries.withColumn(column, F.col("failures").bitwiseAND(F.lit(policy.mask()).cast("long")) == 0)


def ablations(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: failures, those only it caught, and what the policy without it keeps.

    One aggregation of bits over the ledger; the result has one row per rule.
    """
    mask = policy.mask()
    caught = F.col("failures").bitwiseAND(F.lit(mask).cast("long"))
    sums = [F.count(F.lit(1)).alias("documents"), F.sum((caught == 0).cast("long")).alias("kept_by_policy")]
    named = [(i, r) for i, r in enumerate(rules) if mask >> i & 1]
    for i, rule in named:
        bit = F.lit(1 << i).cast("long")
        sums.append(F.sum((caught.bitwiseAND(bit) != 0).cast("long")).alias(f"f{i}"))
        sums.append(F.sum((caught == bit).cast("long")).alias(f"o{i}"))
    entry = [
        F.struct(F.lit(r.name).alias("rule"), F.col(f"f{i}").alias("failed"), F.col(f"o{i}").alias("failed_alone"))
        for i, r in named
    ]
    return (
        entries.agg(*sums)
        .select("documents", "kept_by_policy", F.explode(F.array(*entry)).alias("e"))
        .select(
            F.lit(policy.version).alias("version"),
            "documents",
            "e.rule",
            F.coalesce("e.failed", F.lit(0)).alias("failed"),
            F.coalesce("e.failed_alone", F.lit(0)).alias("failed_alone"),
            (F.coalesce("kept_by_policy", F.lit(0)) + F.coalesce("e.failed_alone", F.lit(0))).alias("kept_without"),
        )
    )
