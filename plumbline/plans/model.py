"""Fitting and scoring on Spark."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassifier,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.lookup import bounded_rows
from plumbline.session import written

FEATURES = "_features"
#: Bins of a feature: as many as Spark's tree learners make themselves (their ``maxBins``).
BINS = 32


class MissingFill:
    """Fill NaN and NULL with the train mean, add a 0/1 flag per affected feature, and cut all into bins.

    Tree learners on Spark take no NaN, so "missing" becomes a value plus a flag. They see a feature only by its bin; the
    cuts are found here, over all of train, so that rows of equal bins can be one weighted row of the fit (:meth:`cells`).
    Up to 32 values of a feature have a bin each; more are cut at quantiles, a value that fills several by itself on
    both of its sides.
    """

    def __init__(self, train: DataFrame, features: Sequence[str]) -> None:
        self.features = list(features)
        seen = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        figures = train.agg(
            *[F.avg(seen(c)).alias(f"m{i}") for i, c in enumerate(self.features)],
            *[F.count_if(seen(c).isNull()).alias(f"n{i}") for i, c in enumerate(self.features)],
            *[F.approx_count_distinct(seen(c)).alias(f"d{i}") for i, c in enumerate(self.features)],
        ).first()
        self.fill = {c: figures[f"m{i}"] or 0.0 for i, c in enumerate(self.features)}
        self.flagged = [c for i, c in enumerate(self.features) if figures[f"n{i}"]]
        # The estimate only says whose values may be few; those are then listed.
        few = [i for i in range(len(self.features)) if figures[f"d{i}"] <= 2 * BINS]
        self.cuts = self._cuts(self._filled(train), [*few, *range(len(self.features), len(self.columns))])

    @property
    def columns(self) -> list[str]:
        return self.features + [f"{c}__missing" for c in self.flagged]

    def _names(self, prefix: str) -> list[str]:
        return [f"{prefix}{i}" for i in range(len(self.columns))]

    def _filled(self, frame: DataFrame) -> DataFrame:
        value = lambda c: F.col(c).cast("double")
        absent = lambda c: value(c).isNull() | F.isnan(value(c))
        replaced = [F.when(absent(c), F.lit(float(self.fill[c]))).otherwise(value(c)) for c in self.features]
        flags = [absent(c).cast("double") for c in self.flagged]
        return frame.select("*", *[c.alias(n) for n, c in zip(self._names("_x"), [*replaced, *flags], strict=True)])

    def _cuts(self, filled: DataFrame, few: Sequence[int]) -> list[list[float]]:
        """Per column the values up to which, themselves included, a bin goes."""
        names = self._names("_x")
        listed = filled.agg(*[F.collect_set(names[i]).alias(names[i]) for i in few]).first() if few else {}
        values = {names[i]: sorted(listed[names[i]]) for i in few}
        cuts = {n: found[:-1] or found for n, found in values.items() if len(found) <= BINS}
        many = [n for n in names if n not in cuts]
        shares = [i / BINS for i in range(1, BINS)]
        for name, found in zip(many, filled.approxQuantile(many, shares, 0.1 / BINS) if many else [], strict=True):
            heavy = {x for x, after in zip(found, found[1:], strict=False) if x == after}
            cuts[name] = sorted({*found, *(math.nextafter(x, -math.inf) for x in heavy)})
        return [cuts[n] for n in names]

    def binned(self, frame: DataFrame) -> DataFrame:
        """The columns of ``frame`` and a bin number per prepared column."""
        above = [sorted({math.nextafter(x, math.inf) for x in cuts} - {math.inf, -math.inf}) for cuts in self.cuts]
        edges = [[-math.inf, *(x or [0.0]), math.inf] for x in above]
        names = self._names("_b")
        cut = Bucketizer(splitsArray=edges, inputCols=self._names("_x"), outputCols=names, handleInvalid="keep")
        return cut.transform(self._filled(frame)).select(*frame.columns, *names)

    def assembled(self, binned: DataFrame) -> DataFrame:
        names = self._names("_b")
        return VectorAssembler(inputCols=names, outputCol=FEATURES).transform(binned).drop(*names)

    def apply(self, frame: DataFrame) -> DataFrame:
        return self.assembled(self.binned(frame))

    def cells(self, train: DataFrame, label: str) -> DataFrame:
        """(bins, label, weight): the rows of each label that no tree can tell apart, as one with their number as weight."""
        names = self._names("_b")
        rows = self.binned(train.select(*self.features, F.col(label).cast("double").alias("label")))
        folded = rows.groupBy(*[F.col(n).cast("byte").alias(n) for n in names], "label").agg(F.count("*").alias("weight"))
        return folded.withColumns({n: F.col(n).cast("double") for n in names})


class FittedModel:
    def __init__(self, model: Model, prepare: MissingFill, n_classes: int) -> None:
        self.model, self.prepare, self.n_classes = model, prepare, n_classes

    def score(self, frame: DataFrame, label: str = "_label") -> DataFrame:
        """The input columns plus y_true and y_prob, class by class. One pass, no shuffle."""
        out = self.prepare.apply(frame)
        if isinstance(self.model, OneVsRestModel):
            names = [f"_p{c}" for c in range(self.n_classes)]
            for name, one in zip(names, self.model.models, strict=True):
                binary = one.copy().setProbabilityCol(name)
                out = binary.setRawPredictionCol("").setPredictionCol("").transform(out)
            singles = {name: vector_to_array(name)[1] for name in names}
            total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
            out = out.withColumns(singles).withColumn("_total", total)
            prob = F.array(*[(F.col(n) / F.col("_total")).cast("float") for n in names])
        else:
            out = self.model.transform(out)
            prob = vector_to_array("probability", "float32")
        return out.select(*frame.columns, F.col(label).alias("y_true"), prob.alias("y_prob"))

    def tree_nodes(self, spark: SparkSession, path: str) -> DataFrame:
        """(feature, gain) of every split node, read from the saved model."""
        self.model.write().overwrite().save(path)
        forests = (
            [f"{path}/model_{i}/data" for i in range(len(self.model.models))]
            if isinstance(self.model, OneVsRestModel)
            else [f"{path}/data"]
        )
        names = F.array(*[F.lit(c) for c in self.prepare.columns])
        nodes = spark.read.parquet(*forests)
        # Weighted figures of a node: rows, sum and squares of a boosted tree, rows by class of a forest's.
        stats = F.col("nodeData.impurityStats")
        rows = stats[0] if isinstance(self.model, OneVsRestModel) else F.aggregate(stats, F.lit(0.0), lambda t, x: t + x)
        return nodes.where(F.col("nodeData.leftChild") >= 0).select(
            F.element_at(names, F.col("nodeData.split.featureIndex") + 1).alias("feature"),
            F.col("nodeData.gain").alias("gain"),
            rows.cast("long").alias("rows"),
        )

    def importance(self, spark: SparkSession, path: str) -> DataFrame:
        """(feature, gain, split_count) with zeros for features no tree uses."""
        nodes = self.tree_nodes(spark, path).groupBy("feature").agg(
            F.sum(F.col("gain") * F.col("rows")).alias("gain"), F.count("*").alias("split_count")
        )
        every = spark.createDataFrame([(c,) for c in self.prepare.columns], "feature string")
        return every.join(nodes, "feature", "left").na.fill(0)


def class_count(train: DataFrame, label: str = "_label") -> int:
    """Number of classes; codes must be 0..n-1."""
    codes = sorted(r[label] for r in bounded_rows(train.select(label).distinct()))
    if codes != list(range(len(codes))):
        raise ValueError(f"Label codes are not contiguous from zero: {codes[:10]}")
    return len(codes)


def _bags(cells: DataFrame, trees: int, seed: int) -> DataFrame:
    """``cells`` and t0.., how often each tree's bag holds rows of the cell.

    A row is in a bag Poisson(1) times, so the rows of a cell are Poisson(their number) times. The draws depend on the
    cell and the seed alone.
    """
    columns, names = cells.columns, [f"t{i}" for i in range(trees)]
    keyed = cells.withColumn("_key", F.xxhash64(*[c for c in columns if c != "weight"]))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_key").to_numpy().view(np.uint64)
            rows = batch.column("weight").to_numpy()
            out = np.empty((trees, len(keys)), dtype=np.int64)
            for i, (k, n) in enumerate(zip(keys, rows, strict=True)):
                out[:, i] = np.random.Generator(np.random.Philox(key=[k, seed])).poisson(n, trees)
            yield pa.record_batch([*batch.columns[:-1], *map(pa.array, out)], names=[*columns, *names])

    fields = [f"`{n}` {kind}" for n, kind in cells.dtypes] + [f"{n} long" for n in names]
    return keyed.mapInArrow(draw, ", ".join(fields))


def _fit_forest(
    prepare: MissingFill, cells: DataFrame, trees: int, depth: int, seed: int, parallelism: int
) -> RandomForestClassificationModel:
    """A random forest over weighted cells: every tree is fitted on its own bag of the rows, then they are put together.

    Spark's own bags would take or leave a whole cell at once.
    """
    ready = prepare.assembled(written(_bags(cells, trees, seed), "bags"))

    def one(tree: int) -> RandomForestClassificationModel:
        bag = ready.select(FEATURES, "label", F.col(f"t{tree}").cast("double").alias("weight")).where("weight > 0")
        learner = RandomForestClassifier(
            featuresCol=FEATURES,
            weightCol="weight",
            numTrees=1,
            bootstrap=False,
            featureSubsetStrategy="sqrt" if trees > 1 else "all",
            maxDepth=depth,
            maxBins=BINS + 1,
            seed=seed + tree,
        )
        return learner.fit(bag)

    with ThreadPool(parallelism) as pool:
        fitted = pool.map(one, range(trees))
    java = [f._java_obj for f in fitted]
    gateway = cells.sparkSession.sparkContext._gateway
    spark_ml = gateway.jvm.org.apache.spark.ml.classification
    together = gateway.new_array(spark_ml.DecisionTreeClassificationModel, trees)
    for i, single in enumerate(java):
        together[i] = single.trees()[0]
    classes = max(f.numClasses for f in fitted)
    forest = spark_ml.RandomForestClassificationModel("forest", together, java[0].numFeatures(), classes)
    forest.set(forest.getParam("numTrees"), trees)
    return RandomForestClassificationModel(forest).setFeaturesCol(FEATURES)


def fit_multiclass(
    train: DataFrame,
    features: Sequence[str],
    label: str = "_label",
    learner: str = "boosted",
    rounds: int = 100,
    depth: int = 5,
    learning_rate: float = 0.05,
    seed: int = 2026,
    parallelism: int = 4,
) -> FittedModel:
    """Multiclass trees on the train split: fixed rounds, no early stopping, no row weights.

    ``boosted`` fits one boosted ensemble per class against the rest; ``forest`` fits one
    random forest over all classes. Rows of equal bins and label are one weighted row of the fit, which
    leaves sums, and so the trees, as they are; the bags of a forest are drawn for the rows themselves.
    """
    if learner not in ("boosted", "forest"):
        raise ValueError(f"Unknown learner {learner!r}")
    # Classes, means, values, quantiles and cells are a pass each: over these columns alone, split and filtered once.
    train = written(train.select(*features, label), "train")
    n = class_count(train, label)
    prepare = MissingFill(train, features)
    cells = written(prepare.cells(train, label), "cells")
    if learner == "boosted":
        one = GBTClassifier(
            featuresCol=FEATURES, maxIter=rounds, maxDepth=depth, stepSize=learning_rate, seed=seed, maxBins=BINS + 1
        )
        fit = OneVsRest(classifier=one, featuresCol=FEATURES, weightCol="weight", parallelism=parallelism)
        model = fit.fit(prepare.assembled(cells))
    else:
        model = _fit_forest(prepare, cells, rounds, depth, seed, parallelism)
    return FittedModel(model, prepare, n)


# ---- nearest centroid: a model a plain expression can score ------------------------------------------


def _half_up(share: Column) -> Column:
    """The nearest whole number of one that is not negative, halves up, in doubles: ``round`` makes a decimal of every value."""
    nearest = F.rint(share)
    return F.when(share - nearest == 0.5, nearest + 1).otherwise(nearest)


class CentroidModel:
    """Softmax over similarity to the class means. The model is classes x dimensions numbers."""

    def __init__(self, centroids: dict[int, list[float]], scale: float = 1.0) -> None:
        self.centroids, self.scale = centroids, scale

    @classmethod
    def fit(
        cls, train: DataFrame, features: Sequence[str], label: str = "_label", digits: int = 6
    ) -> CentroidModel:
        means = train.groupBy(label).agg(
            *[F.round(F.avg(F.col(f).cast("double")), digits).alias(f"m{i}") for i, f in enumerate(features)]
        )
        rows = bounded_rows(means, 10_000)
        return cls({r[label]: [r[f"m{i}"] for i in range(len(features))] for r in rows})

    @classmethod
    def fit_vectors(
        cls, train: DataFrame, vector: str, label: str = "_label", digits: int = 6, dims: int | None = None
    ) -> CentroidModel:
        """As :meth:`fit` for an array column."""
        entries = train.select(label, F.posexplode(vector).alias("_at", "_value"))
        if dims is not None:
            entries = entries.where(F.col("_at") < dims)
        means = entries.groupBy(label, "_at").agg(
            F.round(F.avg(F.col("_value").cast("double")), digits).alias("_mean")
        )
        found: dict[int, dict[int, float]] = {}
        for r in bounded_rows(means, 1_000_000):
            found.setdefault(r[label], {})[r["_at"]] = r["_mean"]
        return cls({c: [m[i] for i in sorted(m)] for c, m in found.items()})

    @property
    def n_classes(self) -> int:
        return len(self.centroids)

    def score(
        self, frame: DataFrame, features: Sequence[str], scale: float = 1.0, digits: int = 6
    ) -> DataFrame:
        """Add y_prob: softmax of minus the squared distance, in generated code.

        The steps are separate columns, so every distance is computed once per row.
        """
        classes = sorted(self.centroids)
        margins = {}
        for c in classes:
            gaps = [F.col(f).cast("double") - m for f, m in zip(features, self.centroids[c], strict=True)]
            squares = [gap * gap for gap in gaps]
            margins[f"_m{c}"] = -sum(squares[1:], squares[0]) * F.lit(float(scale))
        names = list(margins)
        top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
        powers = {f"_e{c}": F.exp(F.col(f"_m{c}") - F.col("_top")) for c in classes}
        total = sum((F.col(e) for e in list(powers)[1:]), F.col(next(iter(powers))))
        scaled = {f"_q{c}": F.col(e) / F.col("_total") * F.lit(10.0**digits) for c, e in zip(classes, powers, strict=True)}
        shares = [(_half_up(F.col(q)) / F.lit(10.0**digits)).cast("float") for q in scaled]
        return (
            frame.withColumns(margins)
            .withColumn("_top", top)
            .withColumns(powers)
            .withColumn("_total", total)
            .withColumns(scaled)
            .withColumn("y_prob", F.array(*shares))
            .drop(*names, "_top", *powers, "_total", *scaled)
        )

    def score_vectors(
        self, frame: DataFrame, vector: str, scale: Column | float = 1.0, digits: int = 6
    ) -> DataFrame:
        """The same for an array column, as one matrix product per Arrow batch.

        A vector that is NULL, or not as long as the centroids, gets no scores.
        """
        means = np.array([self.centroids[c] for c in sorted(self.centroids)])
        lengths = (means * means).sum(axis=1)

        @F.arrow_udf("array<float>")
        def softmax(vectors: pa.Array, scales: pa.Array) -> pa.Array:
            n, width = len(vectors), means.shape[1]
            starts = vectors.offsets.to_numpy()
            whole = (np.diff(starts) == width) & vectors.is_valid().to_numpy(zero_copy_only=False)
            cells = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
            rows = np.zeros((n, width))
            rows[whole] = cells[starts[:-1][whole][:, None] + np.arange(width)]
            # The squared length of a row is the same for every class and cancels.
            margins = (2 * rows @ means.T - lengths) * scales.to_numpy(zero_copy_only=False)[:, None]
            powers = np.exp(margins - margins.max(axis=1, keepdims=True))
            shares = np.round(powers / powers.sum(axis=1, keepdims=True), digits).astype(np.float32)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * means.shape[0])
            return pa.ListArray.from_arrays(offsets, pa.array(shares.ravel()), mask=pa.array(~whole))

        factor = scale if isinstance(scale, Column) else F.lit(float(scale))
        return frame.withColumn("y_prob", softmax(F.col(vector), factor.cast("double")))

    def score_nested(
        self,
        frame: DataFrame,
        features: Sequence[str],
        order: Sequence[str],
        counts: Sequence[int],
        scale: float = 1.0,
        digits: int = 6,
    ) -> DataFrame:
        """Rows once for each k of ``counts``, with ``k`` and the y_prob of the model that sees the first k of ``order`` alone.

        ``features`` names the columns in the order of the centroids. A squared distance is a sum over features, so that
        of every k is a prefix of one running sum along ``order``: one scan and one pass over the features give all
        models. A row with a NULL among the features gets no scores.
        """
        at = [list(features).index(f) for f in order]
        means = np.array([self.centroids[c] for c in sorted(self.centroids)])[:, at]
        wanted, classes = sorted(set(counts)), len(self.centroids)
        if not wanted or not 1 <= wanted[0] <= wanted[-1] <= len(order):
            raise ValueError(f"Feature counts have to be within 1..{len(order)}")

        @F.arrow_udf("array<float>")
        def nested(vectors: pa.Array) -> pa.Array:
            n, width = len(vectors), means.shape[1]
            cells = vectors.flatten()
            known = np.asarray(cells.is_valid()).reshape(n, width).all(axis=1)
            rows = cells.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(n, width)
            out = np.empty((n, len(wanted), classes), dtype=np.float32)
            margins = np.zeros((n, classes))
            for i in range(wanted[-1]):
                margins -= (rows[:, i : i + 1] - means[:, i]) ** 2 * scale
                if i + 1 in wanted:
                    powers = np.exp(margins - margins.max(axis=1, keepdims=True))
                    out[:, wanted.index(i + 1)] = np.round(powers / powers.sum(axis=1, keepdims=True), digits)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (len(wanted) * classes))
            return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()), mask=pa.array(~known))

        ordered = F.array(*[F.col(f).cast("double") for f in order])
        each = [
            F.struct(F.lit(k).alias("k"), F.slice("_nested", i * classes + 1, classes).alias("y_prob"))
            for i, k in enumerate(wanted)
        ]
        return frame.withColumn("_nested", nested(ordered)).select(*frame.columns, F.inline(F.array(*each)))
