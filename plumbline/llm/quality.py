"""A quality classifier: regularised quadratic discriminant analysis over document statistics.

Each class is a Gaussian over transformed statistics. Its covariance is shrunk towards the pooled one
and towards a sphere, so that a class with few rows stays invertible. A score is the logistic of the
difference of the log densities, from Mahalanobis distances through the classes' Cholesky factors. The
fit needs counts, sums and products only, which Spark adds up over all labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import rules, shingles
from plumbline.llm.frames import held_out, known_labels, labelled, map_batches, sized, stored

FEATURES = (
    "words",
    "word_length",
    "symbols",
    "capitals",
    "repeats",
    "same_as_next",
    "exclamations",
    "variety",
    "odd_characters",
)
_LOW, _HIGH = 1e-3, 1 - 1e-3


def _logit(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, _LOW, _HIGH)
    return np.log(share / (1 - share))


def _statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text; shares pass a logit, counts a logarithm."""
    found = rules._measure(texts)
    data, offsets = shingles.utf8(texts)
    hashes, before, _, _ = shingles.words(texts, fold=True)
    count = np.maximum(found["n_words"], 1)
    characters = np.maximum(found["word_chars"], 1)
    text = np.repeat(np.arange(len(count)), np.diff(before))
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    with np.errstate(over="ignore"):
        key = shingles.mix(hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.zeros(len(hashes), dtype=bool)
    first[np.unique(key, return_index=True)[1]] = True
    # Against the square root of the words, as a longer text repeats more of its words.
    variety = rules._per_text(first, before) / np.sqrt(count)
    plain = shingles.LETTER | np.isin(np.arange(256), list(b" \t\n\r.,;:'-0123456789"))
    return np.column_stack(
        [
            np.log1p(found["n_words"]),
            np.log(np.clip(characters / count, 1, 30)),
            _logit(found["n_symbols"] / (count + found["n_symbols"])),
            _logit(found["n_capitals"] / np.maximum(found["n_letters"], 1)),
            _logit(found["n_repeat_words"] / count),
            _logit(rules._per_text(same, before) / count),
            _logit(rules._per_text(data == 0x21, offsets) / (count + 1)),
            np.log(variety + 0.1),
            _logit(rules._per_text(~plain[data], offsets) / characters),
        ]
    )


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``x``, the transformed statistics of the whole text (null: of no words)."""
    frame = docs.select(*keep, F.col(text).alias("t"))
    kinds = dict(frame.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("t")
        x = np.concatenate([_statistics(texts.slice(a, b - a)) for a, b in shingles.pieces(texts)])
        values = pa.array(x.ravel(), pa.float64())
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), values)
        return pa.record_batch([*(batch.column(k) for k in keep), rows], names=[*keep, "x"])

    return map_batches(frame, run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", x array<double>")


@dataclass(frozen=True)
class Discriminant:
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row."""
        density = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            away = np.linalg.solve(factor, (x - mean).T)
            density.append(offset - 0.5 * (away**2).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -60, 60)))


def fit(rows: DataFrame, shrink: float = 0.1, sphere: float = 0.05, one_class_weight: float = 1.0) -> Discriminant | None:
    """Fit on rows (x, label), all of them. None when a label is missing.

    A class covariance is (1 - shrink - sphere) of its own, ``shrink`` of the pooled one and ``sphere``
    of the pooled variances on the diagonal. ``one_class_weight`` multiplies the prior of label 1.
    """
    width = len(FEATURES)
    cells = [(i, j) for i in range(width) for j in range(i, width)]
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(width)]
    sums += [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in cells]
    found = {r["label"]: r for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    if set(found) != {0, 1}:
        return None
    n = np.array([found[c]["n"] for c in (0, 1)], dtype=float)
    means = np.array([[found[c][f"s{i}"] for i in range(width)] for c in (0, 1)]) / n[:, None]
    scatter = np.zeros((2, width, width))
    for c in (0, 1):
        for i, j in cells:
            scatter[c, i, j] = scatter[c, j, i] = found[c][f"p{i}_{j}"] / n[c] - means[c, i] * means[c, j]
    pooled = np.tensordot(n / n.sum(), scatter, axes=1)
    floor = np.diag(np.maximum(np.diag(pooled), 1e-4))
    shrunk = (1 - shrink - sphere) * scatter + shrink * pooled + sphere * floor
    factors = np.linalg.cholesky(shrunk)
    spread = np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1)
    prior = np.log(n / n.sum()) + np.log([1.0, one_class_weight])
    return Discriminant(means, factors, prior - spread)


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", **settings: float) -> Discriminant | None:
    """The model of the labelled rows of ``docs`` that are not held out; None without both labels.

    Texts are measured where they lie and only their statistics meet the labels. Few labels are sent ahead, so that texts
    without one are not measured.
    """
    rows = docs.select("doc_id", F.col(text).alias("text")).where(~held_out())
    known, small = sized(known_labels(labels, "quality"))
    same = F.col("doc_id") == F.col("labelled_id")
    if small:
        rows = rows.join(F.broadcast(known.select("labelled_id")), same, "left_semi")
    return fit(statistics(rows).join(F.broadcast(known) if small else known, same).select("x", "label"), **settings)


def scored(docs: DataFrame, model: Discriminant | None, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with ``column``, the chance of label 1; 0.5 everywhere without a model."""
    if model is None:
        return docs.withColumn(column, F.lit(0.5))
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)
    frame = docs.toDF(*names)
    schema = ", ".join(f"{n} {k}" for n, k in frame.dtypes) + ", score double"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at)
        x = np.concatenate([_statistics(texts.slice(a, b - a)) for a, b in shingles.pieces(texts)])
        return batch.append_column("score", pa.array(model.score(x)))

    return map_batches(frame, run, schema).toDF(*docs.columns, column)


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", **settings: float) -> DataFrame:
    """Per row of ``docs``: doc_id and score, the chance that ``labels.quality`` is 1.

    Learnt from labelled rows that are not held out; without both labels among them every score is 0.5.
    A null or empty text is scored as a text without words; rows of equal id are scored one by one.
    Neither id, source, language nor label enters a score.
    """
    known = stored(statistics(docs, text), "statistics")
    model = fit(labelled(known, labels, "quality").select("x", "label"), **settings)
    if model is None:
        return known.select("doc_id", F.lit(0.5).alias("score"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
        return pa.record_batch([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return map_batches(known, run, f"doc_id {dict(known.dtypes)['doc_id']}, score double")
