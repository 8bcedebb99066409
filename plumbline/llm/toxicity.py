"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag has a label. A sentence is toxic with the logistic
of the weights of its terms; a document is toxic when any of its sentences is, the noisy-or of them.
Terms are words and the first letters of words. Those that lean to toxic documents are chosen from
the training sample; a sentence without such a term has no part in the noisy-or.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shingles
from plumbline.llm.frames import held_out, map_batches

#: About so many labelled documents are learnt from, drawn by a hash of their ids.
MAX_TRAIN = 20_000
#: Terms that the model holds at most, the toxic documents that one must be in at least, and the share
#: of its documents that must be toxic.
MAX_TERMS, LEAST, LEAST_SHARE = 4_000, 3, 0.5
PREFIX_BYTES = 5
_PREFIX = np.uint64(0xD6E8FEB86659FD93)
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".!?\n")] = True


@dataclass
class Bags:
    """Terms of a batch: their hash, sentence and text, and where each sentence lies."""

    terms: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def bags(texts: pa.Array) -> Bags:
    """Sentences end at . ! ? and line breaks; they are numbered through the batch."""
    data, offsets = shingles.utf8(texts)
    hashes, before, starts, ends = shingles.words(texts, fold=True, letters=True)
    heads = shingles.spans(data, starts, np.minimum(ends, starts + PREFIX_BYTES), fold=True) ^ _PREFIX
    breaks = np.cumsum(_BREAK[data], dtype=np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(before))
    sentence = breaks[starts] + text
    return Bags(
        np.concatenate([hashes, heads]), np.tile(sentence, 2), np.tile(text, 2), data, offsets
    )


@dataclass(frozen=True)
class NoisyOr:
    terms: np.ndarray
    weights: np.ndarray
    bias: float
    leak: float

    def sentences(self, found: Bags) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, text and score of the sentences that hold a term of the model."""
        if not len(self.terms) or not len(found.terms):
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(0)
        place = np.minimum(np.searchsorted(self.terms, found.terms), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[place] == found.terms)
        number, first, inverse = np.unique(found.sentence[hit], return_index=True, return_inverse=True)
        pair = np.unique(inverse.astype(np.int64) * len(self.terms) + place[hit])
        total = np.bincount(pair // len(self.terms), self.weights[pair % len(self.terms)], len(number))
        return number, found.text[hit][first], 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))

    def documents(self, text: np.ndarray, chances: np.ndarray, size: int) -> np.ndarray:
        """The noisy-or of the sentences of each text."""
        clean = np.bincount(text, np.log1p(-np.minimum(chances, 1 - 1e-12)), size)
        return 1 - (1 - self.leak) * np.exp(clean)


def learn(pairs: pd.DataFrame, labels: np.ndarray, rounds: int = 300, decay: float = 2e-4) -> NoisyOr:
    """Fit weights to bags by gradient steps on the likelihood of the bag labels.

    ``pairs`` has one row (bag, sentence, term) for each term of each sentence; ``labels`` has one
    entry a bag. Terms are chosen by the chi-square of their bags, toxic lean only.
    """
    bag_terms = pairs[["bag", "term"]].drop_duplicates()
    bag_terms["label"] = labels[bag_terms["bag"].to_numpy()]
    counts = bag_terms.groupby("term")["label"].agg(["sum", "count"])
    size, toxic = len(labels), labels.sum()
    expected = counts["count"] * toxic / max(size, 1)
    lean = (counts["sum"] - expected) ** 2 / np.maximum(expected, 0.5)
    chosen = counts[(counts["sum"] >= LEAST) & (counts["sum"] >= LEAST_SHARE * counts["count"])].index
    chosen = lean.loc[chosen].sort_values(ascending=False, kind="stable").index[:MAX_TERMS]
    terms = np.sort(chosen.to_numpy(dtype=np.uint64))
    base = float(toxic) / max(size, 1)
    if not len(terms):
        return NoisyOr(terms, np.zeros(0), 0.0, base)
    rows = pairs[pairs["term"].isin(chosen)].drop_duplicates(["bag", "sentence", "term"])
    column = np.searchsorted(terms, rows["term"].to_numpy())
    _, sentence = np.unique(rows[["bag", "sentence"]].to_numpy(np.int64), axis=0, return_inverse=True)
    sentence = sentence.ravel()
    owner = np.zeros(sentence.max() + 1, dtype=np.int64)
    owner[sentence] = rows["bag"].to_numpy()
    hidden = labels[np.setdiff1d(np.arange(size), owner)]
    leak = min(0.5, max(1e-3, float(hidden.sum() / max(len(hidden), 1))))
    params = np.append(np.zeros(len(terms)), -1.0)
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        score = 1 / (1 + np.exp(-np.clip(np.bincount(sentence, params[column]) + params[-1], -30, 30)))
        clean = np.bincount(owner, np.log1p(-np.minimum(score, 1 - 1e-9)), size) + np.log1p(-leak)
        chance = np.clip(1 - np.exp(clean), 1e-9, 1 - 1e-9)
        # d log-likelihood / d sentence logit: p_s (y - p) / p for the bag of the sentence.
        slope = (score * ((labels - chance) / chance)[owner]) / size
        gradient = np.append(np.bincount(column, slope[sentence], len(terms)), slope.sum())
        gradient[:-1] -= decay * params[:-1] / len(terms)
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        params = params + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return NoisyOr(terms, params[:-1], float(params[-1]), leak)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, text: str = "text") -> NoisyOr:
    """Learn from about ``max_train`` labelled documents that are not held out."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
        .groupBy(F.col("doc_id").alias("labelled_id"))
        .agg(F.max("toxic").cast("int").alias("label"))
    )
    total = known.count()
    space = 1 << 30
    drawn = known.where(F.pmod(F.xxhash64("labelled_id"), F.lit(space)) < int(space * min(1.0, max_train / max(total, 1))))
    sample = docs.select("doc_id", F.col(text).alias("t")).join(
        F.broadcast(drawn), F.col("doc_id") == F.col("labelled_id")
    )
    frame = sample.select("doc_id", "label", "t")

    # A first pass counts terms, so that only those that can be chosen come to the driver.
    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, out = batch.column("t"), []
        label = batch.column("label").to_numpy()
        for a, b in shingles.pieces(texts):
            found = bags(texts.slice(a, b - a))
            with np.errstate(over="ignore"):
                key = shingles.mix(found.terms + found.text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            first = np.unique(key, return_index=True)[1]
            out.append((found.terms[first].view(np.int64), label[found.text[first] + a]))
        term = np.concatenate([t for t, _ in out])
        unique, inverse = np.unique(term, return_inverse=True)
        toxic = np.bincount(inverse, np.concatenate([y for _, y in out]), len(unique)).astype(np.int64)
        return pa.record_batch([pa.array(unique), pa.array(toxic), pa.array(np.bincount(inverse, minlength=len(unique)))], names=["term", "toxic", "n"])

    sizes = drawn.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).first()
    rate = (sizes["toxic"] or 0) / max(sizes["n"], 1)
    counted = (
        map_batches(frame, emit, "term long, toxic long, n long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
        .where((F.col("toxic") >= LEAST) & (F.col("toxic") >= LEAST_SHARE * F.col("n")))
    )
    lean = (F.col("toxic") - rate * F.col("n")) ** 2 / F.greatest(rate * F.col("n"), F.lit(0.5))
    best = counted.orderBy(lean.desc(), "term").limit(MAX_TERMS).toPandas()["term"].to_numpy(np.int64)
    terms = np.sort(best.view(np.uint64))

    def gather(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, rows, sentences, hashes = batch.column("t"), [], [], []
        for a, b in shingles.pieces(texts):
            found = bags(texts.slice(a, b - a))
            if len(terms):
                place = np.minimum(np.searchsorted(terms, found.terms), len(terms) - 1)
                hit = np.flatnonzero(terms[place] == found.terms)
                rows.append(found.text[hit] + a)
                sentences.append(found.sentence[hit])
                hashes.append(found.terms[hit].view(np.int64))
        rows = np.concatenate([*rows, np.zeros(0, np.int64)])
        counts = np.bincount(rows, minlength=batch.num_rows)
        edges = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate([*x, np.zeros(0, np.int64)]))) for x in (_by_row(sentences, rows), _by_row(hashes, rows))]
        return pa.record_batch([batch.column("label"), *lists], names=["label", "sentences", "terms"])

    bagged = map_batches(frame, gather, "label int, sentences array<long>, terms array<long>").toPandas()
    labels_found = bagged["label"].to_numpy(dtype=float)
    lengths = bagged["terms"].map(len).to_numpy() if len(bagged) else np.zeros(0, int)
    pairs = pd.DataFrame(
        {
            "bag": np.repeat(np.arange(len(bagged)), lengths),
            "sentence": _joined(bagged["sentences"]),
            "term": _joined(bagged["terms"]).view(np.uint64),
        }
    )
    return learn(pairs, labels_found)


def _joined(lists: pd.Series) -> np.ndarray:
    """The values of all lists; an empty list must not turn 64-bit hashes into floats."""
    return np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, dtype=np.int64) for x in lists)])


def _by_row(parts: list[np.ndarray], rows: np.ndarray) -> list[np.ndarray]:
    """Values in the order of their rows."""
    return [np.concatenate(parts)[np.argsort(rows, kind="stable")]] if parts else []


def score_toxicity(
    docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, text: str = "text"
) -> DataFrame:
    """Per row of ``docs``: doc_id, score, and the worst sentence: worst_start, worst_end, worst_score.

    ``score`` is the noisy-or over the sentences. Offsets are bytes of the UTF-8 text; they are null
    where no sentence holds a term of the model, as in null and empty texts, whose score is the rate of
    toxic documents without such a term. Without labels every score is 0. Rows of equal id are scored
    one by one; id, language, source and label are no inputs.
    """
    model = train(docs, labels, max_train, text)
    frame = docs.select("doc_id", F.col(text).alias("t"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, columns = batch.column("t"), []
        for a, b in shingles.pieces(texts):
            found = bags(texts.slice(a, b - a))
            number, text_of, chances = model.sentences(found)
            size = b - a
            order = np.lexsort((number, -chances, text_of))
            owners, first = np.unique(text_of[order], return_index=True)
            worst = np.full(size, -1, dtype=np.int64)
            worst[owners] = order[first]
            some = worst >= 0
            breaks = np.flatnonzero(_BREAK[found.data])
            start, end, top = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size)
            rank = number[worst[some]] - np.flatnonzero(some)
            begin = np.where(rank > 0, np.append(breaks, 0)[rank - 1] + 1, 0)
            finish = np.append(breaks, len(found.data))[rank]
            low, high = found.offsets[:-1][some], found.offsets[1:][some]
            start[some] = np.maximum(begin, low) - low
            end[some] = np.minimum(finish, high) - low
            top[some] = chances[worst[some]]
            columns.append((model.documents(text_of, chances, size), start, end, top, ~some))
        score, start, end, top, none = (np.concatenate(c) for c in zip(*columns, strict=True))
        return pa.record_batch(
            [
                batch.column("doc_id"),
                pa.array(np.clip(score, 0.0, 1.0)),
                pa.array(start, mask=none),
                pa.array(end, mask=none),
                pa.array(top, mask=none),
            ],
            names=["doc_id", "score", "worst_start", "worst_end", "worst_score"],
        )

    schema = f"doc_id {dict(frame.dtypes)['doc_id']}, score double, worst_start long, worst_end long, worst_score double"
    return map_batches(frame, run, schema)
