"""Language identification with a string kernel.

The kernel of two texts is the number of n-grams of 1 to 3 bytes that both hold, over the geometric
mean of how many each holds: a blended spectrum of presences, taken over hashed n-grams. Landmarks
span the Nystroem space, ridge regression learns one language against the rest in it, and a batch is
scored by two matrix products: its presences with those of the landmarks, and these with the weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shingles
from plumbline.llm.frames import held_out, map_batches

#: Hashed n-grams, landmarks, and the documents of each language that are learnt from (about).
SPACE, LANDMARKS, MAX_TRAIN = 1 << 14, 96, 400
UNKNOWN = "und"
_BLOCK = 64


def presences(text: np.ndarray) -> np.ndarray:
    """Which hashed n-grams of 1 to 3 bytes a text holds; A-Z counts as a-z, white space as one space."""
    out = np.zeros(SPACE, dtype=bool)
    out[text] = True
    key = text.astype(np.uint32)
    for _ in range(2):
        key = key[:-1] * np.uint32(257) + text[len(text) - len(key) + 1 :]
        out[256 + (key * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(SPACE - 256)] = True
    return out


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def rows_of(texts: pa.Array) -> np.ndarray:
    """A row of presences for each text."""
    data, offsets = shingles.utf8(texts)
    data = _FOLD[data]
    out = np.zeros((len(texts), SPACE), dtype=np.float32)
    for row in range(len(texts)):
        out[row] = presences(data[offsets[row] : offsets[row + 1]])
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows over the square root of their number of n-grams."""
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


@dataclass(frozen=True)
class KernelModel:
    languages: tuple[str, ...]
    landmarks: np.ndarray
    weights: np.ndarray

    def decide(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language of each row and its share after a softmax."""
        margins = (_unit(rows) @ self.landmarks.T) @ self.weights
        shares = np.exp(4 * (margins - margins.max(axis=1, keepdims=True)))
        shares /= shares.sum(axis=1, keepdims=True)
        best = margins.argmax(axis=1)
        return best, shares[np.arange(len(rows)), best].astype(np.float64)


def fit(rows: np.ndarray, languages: list[str], ridge: float = 1e-3, landmarks: int = LANDMARKS) -> KernelModel:
    """Ridge regression of each language against the rest on the Nystroem features of ``rows``.

    The landmarks are taken from the languages in turn.
    """
    names = tuple(sorted(set(languages)))
    target = np.array([[1.0 if x == name else -1.0 for name in names] for x in languages])
    unit = _unit(rows)
    turns = [np.flatnonzero(target[:, c] > 0) for c in range(len(names))]
    order = [int(t[i]) for i in range(max(map(len, turns))) for t in turns if i < len(t)]
    marks = unit[order[:landmarks]]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6))
    features = (unit @ marks.T).astype(np.float64) @ whiten
    gram = features.T @ features + ridge * len(rows) * np.eye(features.shape[1])
    weights = whiten @ np.linalg.solve(gram, features.T @ target)
    return KernelModel(names, marks.astype(np.float32), weights.astype(np.float32))


def train(
    docs: DataFrame, max_train: int = MAX_TRAIN, text: str = "text", lang: str = "lang"
) -> KernelModel | None:
    """Learn from about ``max_train`` documents of each language, drawn by a hash of their ids.

    Only rows that are not held out, with a text and a language, are learnt from; None without any.
    The number of languages is taken to be small.
    """
    known = docs.select("doc_id", F.col(text).alias("t"), F.col(lang).alias("language")).where(
        F.col("language").isNotNull() & F.col("t").isNotNull() & ~held_out()
    )
    counts = known.groupBy(F.col("language").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    space = 1 << 30
    sample = known.join(F.broadcast(counts), F.col("language") == F.col("name")).where(
        F.pmod(F.xxhash64("doc_id"), F.lit(space)) < F.lit(float(space * max_train)) / F.col("n")
    )

    def gather(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("t")
        packed = [
            np.packbits(row.astype(bool)).tobytes()
            for a, b in shingles.pieces(texts)
            for i in range(a, b)
            for row in rows_of(texts.slice(i, 1))
        ]
        return pa.record_batch([batch.column("doc_id"), batch.column("language"), pa.array(packed, pa.binary())], names=["doc_id", "language", "packed"])

    frame = sample.select("doc_id", "language", "t")
    kind = dict(frame.dtypes)["doc_id"]
    found = map_batches(frame, gather, f"doc_id {kind}, language string, packed binary").toArrow().to_pylist()
    if not found:
        return None
    found.sort(key=lambda r: (r["doc_id"], r["packed"]))
    rows = np.array([np.unpackbits(np.frombuffer(r["packed"], np.uint8)) for r in found], dtype=np.float32)
    return fit(rows, [r["language"] for r in found])


def identify(docs: DataFrame, max_train: int = MAX_TRAIN, text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred and score (0 to 1).

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no letter, and everywhere when
    nothing can be learnt from. Whole texts are read; rows of equal id are judged one by one.
    """
    model = train(docs, max_train, text, lang)
    frame = docs.select("doc_id", F.col(text).alias("t"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("t")
        names, scores = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
        if model is not None:
            for start, stop in shingles.pieces(texts):
                for a in range(start, stop, _BLOCK):
                    b = min(a + _BLOCK, stop)
                    names[a:b], scores[a:b] = model.decide(rows_of(texts.slice(a, b - a)))
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
        names[~lettered] = -1
        scores[names < 0] = 0.0
        values = pa.array([*(model.languages if model else ()), UNKNOWN])
        return pa.record_batch([batch.column("doc_id"), values.take(pa.array(names % len(values))), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return map_batches(frame, run, f"doc_id {dict(frame.dtypes)['doc_id']}, lang_pred string, score double")
