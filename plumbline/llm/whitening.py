"""Whitening of vectors by a covariance from squares alone.

The polarisation identity gives every covariance from variances: twice the covariance of two dimensions is the
variance of their sum less both variances. So the fit needs the sum of squares of every centred dimension
and of every centred sum of two, and nothing else. Vectors are rounded to integers first; centred values
are integers then as well, and all sums are exact whatever the order in which tasks deliver them. The matrix,
as wide as a vector, is assembled on the driver for an eigendecomposition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import stored

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Largest size of a rounded entry; up to it an entry and its mean are exact in int64 arithmetic.
LARGEST = 1 << 52
#: Eigenvalues up to this share of the largest count as 0.
RANK_SHARE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """``rows`` vectors with the sums ``sums`` of their rounded entries, and their exact squares.

    ``squares`` holds, for each pair i <= j, the sum over rows of the square of n (x_i + x_j) - (S_i + S_j), and of
    n x_i - S_i where i = j. ``values`` fall; the columns of ``vectors`` are unit vectors.
    """

    rows: int
    sums: list[int]
    squares: dict[tuple[int, int], int]
    values: np.ndarray
    vectors: np.ndarray

    def covariance(self, i: int, j: int) -> float:
        """The exact covariance of rounded entries, as the nearest double."""
        n, s = self.rows, self.squares
        if i == j:
            return s[i, i] / n**3
        return (s[min(i, j), max(i, j)] - s[i, i] - s[j, j]) / (2 * n**3)

    @property
    def trace(self) -> float:
        return sum(self.squares[i, i] for i in range(len(self.sums))) / self.rows**3

    def rank(self) -> int:
        """Components that have a variance."""
        return int((self.values > RANK_SHARE * max(self.values[0], 0)).sum()) if len(self.values) else 0


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not empty, and holds no null and no non-finite entry."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def _rounded(vectors: pa.Array) -> np.ndarray:
    """Integers of a batch, one row per vector; all have the same length."""
    lengths = np.diff(vectors.offsets.to_numpy())
    if len(np.unique(lengths)) > 1:
        raise ValueError("The vectors to whiten differ in length")
    values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if np.abs(values).max(initial=0) > LARGEST:
        raise ValueError(f"An entry of a vector is larger than {LARGEST} / {SCALE}")
    return values.astype(np.int64).reshape(len(lengths), -1) + SHIFT


def _exact(values: np.ndarray) -> list[int]:
    """Column sums of squares, exact: in int64 where they fit, else in Python's integers."""
    largest = int(np.abs(values).max(initial=0))
    if largest**2 * len(values) >= 1 << 62:
        values = values.astype(object)
    return [int(x) for x in (values * values).sum(axis=0)]


def _kept(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and the embedding in doubles, of rows that stay."""
    wide = F.col(embedding).cast("array<double>")
    return vectors.select(F.col(vec_id).alias("vec_id"), wide.alias("embedding")).where(usable(F.col("embedding")))


def fit(kept: DataFrame) -> Whitening | None:
    """From rows with ``embedding``: one pass for the sums, one for the squares. None without rows.

    Tasks send one row per dimension, then one per pair of dimensions, which Spark adds up; the driver gets d and
    d (d + 1) / 2 numbers for vectors of length d.
    """
    vectors = kept.select("embedding")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = None, 0
        for batch in batches:
            if batch.num_rows:
                x = _rounded(batch.column("embedding")).astype(object if batch.num_rows >= 1 << 10 else np.int64)
                part = [int(v) for v in x.sum(axis=0)]
                if total is not None and len(total) != len(part):
                    raise ValueError("The vectors to whiten differ in length")
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
                rows += batch.num_rows
        if total is not None:
            yield pa.record_batch(
                [
                    pa.array(range(len(total)), pa.int32()),
                    pa.array([rows] * len(total), pa.int64()),
                    pa.array(total, pa.decimal128(38, 0)),
                ],
                names=["i", "n", "s"],
            )

    partial = vectors.mapInArrow(sums, "i int, n long, s decimal(38,0)")
    found = sorted(partial.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())
    if not found:
        return None
    if len({r["n"] for r in found}) > 1:
        raise ValueError("The vectors to whiten differ in length")
    n, size, total = found[0]["n"], len(found), [int(r["s"]) for r in found]
    # Centred at the integer next to the mean: exact, small, and n x - S follows from it.
    middle = [(2 * s + n) // (2 * n) for s in total]

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(middle, dtype=np.int64)
        held: list[list[int]] | None = None
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                y = _rounded(batch.column("embedding").slice(start, 4096)) - at
                part = [_exact(np.concatenate([y[:, i : i + 1], y[:, i : i + 1] + y[:, i + 1 :]], axis=1)) for i in range(size)]
                held = part if held is None else [[a + b for a, b in zip(p, q, strict=True)] for p, q in zip(held, part, strict=True)]
        if held is not None:
            i, j = np.triu_indices(size)
            yield pa.record_batch(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([q for p in held for q in p], pa.decimal128(38, 0))],
                names=["i", "j", "q"],
            )

    partial = vectors.mapInArrow(squares, "i int, j int, q decimal(38,0)")
    gathered = {(r["i"], r["j"]): int(r["q"]) for r in partial.groupBy("i", "j").agg(F.sum("q").alias("q")).collect()}
    away = [s - n * m for s, m in zip(total, middle, strict=True)]
    exact = {}
    for (i, j), q in gathered.items():
        t = away[i] if i == j else away[i] + away[j]
        exact[i, j] = n * (n * q - t * t)
    out = Whitening(n, total, exact, np.zeros(0), np.zeros((0, 0)))
    matrix = np.array([[out.covariance(i, j) for j in range(size)] for i in range(size)])
    values, columns = np.linalg.eigh(matrix)
    return Whitening(n, total, exact, values[::-1].copy(), columns[:, ::-1].copy())


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding"
) -> tuple[Whitening | None, DataFrame]:
    """The fit, and per remaining row: vec_id, deviation (decimal, exact), whitened (array of doubles).

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped; rows of equal id and equal
    vectors count one by one; other columns are not read. The vectors that remain must be of one length. There
    are at most ``components`` components and none without variance, so equal vectors have none. An
    empty table, or one without usable vectors, has no fit and gives no rows.
    """
    kept = _kept(vectors, vec_id, embedding)
    kind = dict(kept.dtypes)["vec_id"]
    schema = f"vec_id {kind}, deviation decimal(38,0), whitened array<double>"
    model = fit(kept)
    if model is None:
        return None, vectors.sparkSession.createDataFrame([], schema)
    count = min(components, model.rank())
    n, sums = model.rows, model.sums
    axes = model.vectors[:, :count] / np.sqrt(model.values[:count])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rounded(batch.column("embedding"))
            largest = max(int(np.abs(x).max()), max(abs(s) // n + 1 for s in sums))
            safe = n * largest * 2 < 1 << 62
            away = x * n - np.array(sums, dtype=np.int64) if safe else x.astype(object) * n - np.array(sums, dtype=object)
            wide = away.astype(object) if safe and int(np.abs(away).max()) ** 2 * len(sums) >= 1 << 62 else away
            deviation = (wide * wide).sum(axis=1)
            centred = (away / n).astype(np.float64)
            white = centred @ axes
            offsets = pa.array(np.arange(len(x) + 1) * count, pa.int32())
            yield pa.record_batch(
                [
                    batch.column("vec_id"),
                    pa.array([int(d) for d in deviation], pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(offsets, pa.array(white.ravel(), pa.float64())),
                ],
                names=["vec_id", "deviation", "whitened"],
            )

    return model, stored(kept.mapInArrow(project, schema), "whitened")


def identity_error(white: DataFrame, count: int) -> float:
    """The largest difference between the covariance of ``whitened`` and the identity; Spark's covariance centres first."""
    cells = [(i, j) for i in range(count) for j in range(i, count)]
    if not cells:
        return 0.0
    found = white.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in cells]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in cells)


def whitened_components(
    vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """One row per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    model, white = whiten(vectors, components, vec_id, embedding)
    count = min(components, model.rank()) if model else 0
    share = [float(v / model.trace) for v in model.values[:count]] if count else []
    explained = F.array(*map(F.lit, share)) if share else F.array().cast("array<double>")
    error = identity_error(white, count)
    return white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.rows if model else 0).cast("long").alias("n"),
        "deviation",
        F.col("value").alias("whitened"),
        explained[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
