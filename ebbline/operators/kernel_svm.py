"""Support vector machine with a Gaussian kernel and probabilities, by random Fourier features.

`cos(w x + b)` over random w of the kernel's spectrum gives vectors whose inner products approach the kernel, so a linear SVM over
them is the kernel machine at a cost that grows with the rows, not with their square. Margins become probabilities by
a logistic fit (Platt) on margins of rows that the machine did not see: each fold is scored by a machine fitted on the others.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.config import RANDOM_SEED, ROLES

#: Random features, and folds of the calibration.
FEATURES_OUT = 256
FOLDS = 5


class FourierFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """sqrt(2 / n) * cos(w x + b) for n random w of variance 2 * gamma and b in [0, 2 pi), drawn from the seed."""

    inputCol = Param(Params._dummy(), "inputCol", "vectors", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "random features", TypeConverters.toString)
    width = Param(Params._dummy(), "width", "entries of the vectors", TypeConverters.toInt)
    size = Param(Params._dummy(), "size", "number of random features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "the kernel is exp(-gamma * squared distance)", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the random features", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="fourier", width=1, size=FEATURES_OUT, gamma=1.0, seed=RANDOM_SEED):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="fourier", width=1, size=FEATURES_OUT, gamma=1.0, seed=RANDOM_SEED)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        v = {p.name: self.getOrDefault(p) for p in self.params}
        rng = np.random.default_rng(v["seed"])
        w = rng.normal(scale=np.sqrt(2.0 * v["gamma"]), size=(v["width"], v["size"]))
        b = rng.uniform(0.0, 2.0 * np.pi, v["size"])

        @F.pandas_udf("array<double>")
        def mapped(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(np.sqrt(2.0 / len(b)) * np.cos(np.stack(x.to_numpy()) @ w + b)))

        return dataset.withColumn(v["outputCol"], array_to_vector(mapped(vector_to_array(v["inputCol"]))))


class KernelSVM(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits to a pipeline of random features, linear SVM and calibration, with the usual probability columns."""

    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label", TypeConverters.toString)
    C = Param(Params._dummy(), "C", "weight of the summed loss", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of random features", TypeConverters.toInt)
    folds = Param(Params._dummy(), "folds", "folds of the calibration", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the random features and folds", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", C=1.0, size=FEATURES_OUT, folds=FOLDS, seed=RANDOM_SEED):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", C=1.0, size=FEATURES_OUT, folds=FOLDS, seed=RANDOM_SEED)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        from ebbline.operators.models import fit_tasks

        v = {p.name: self.getOrDefault(p) for p in self.params}
        x = F.col(v["featuresCol"])
        moments = dataset.agg(F.count("*").alias("n"), Summarizer.mean(x).alias("mean"), Summarizer.normL2(x).alias("norm")).first()
        width, n = len(moments["mean"]), moments["n"]
        # gamma = 1 / (width * variance of all entries), as libraries scale it by default.
        variance = float(np.mean(moments["norm"].toArray() ** 2) / n - np.mean(moments["mean"].toArray()) ** 2)
        fourier = FourierFeatures(inputCol=v["featuresCol"], width=width, size=v["size"], gamma=1.0 / (width * (variance or 1.0)), seed=v["seed"])
        key = F.col(ROLES.key) if ROLES.key in dataset.columns else vector_to_array(x).cast("string")
        fold = F.pmod(F.xxhash64(key, F.lit(v["seed"])), F.lit(v["folds"])).alias("fold")
        # Mapped once, as every iteration of every fit reads it again.
        mapped = fourier.transform(dataset).select(F.col(v["labelCol"]).alias("label"), "fourier", fold).persist(StorageLevel.MEMORY_AND_DISK)

        def machine(rows: DataFrame, n_rows: float):
            return LinearSVC(featuresCol="fourier", labelCol="label", rawPredictionCol="margin", predictionCol="margin_class", regParam=1.0 / (v["C"] * max(n_rows, 1))).fit(rows)

        # The machines run side by side.
        tasks = fit_tasks(n, dataset.sparkSession, v["folds"] + 1, v["size"])
        positive = VectorSlicer(inputCol="margin", outputCol="margin_positive", indices=[1])

        def fitted_without(k: int | None):
            rows = mapped if k is None else mapped.where(F.col("fold") != k)
            return machine(rows.coalesce(tasks), n if k is None else n * (v["folds"] - 1) / v["folds"])

        held = None
        try:
            # The threads only submit jobs.
            with ThreadPool(v["folds"] + 1) as pool:
                *parts, whole = pool.map(fitted_without, [*range(v["folds"]), None])
            for k, fitted in enumerate(parts):
                part = positive.transform(fitted.transform(mapped.where(F.col("fold") == k))).select("label", "margin_positive")
                held = part if held is None else held.unionByName(part)
            platt = LogisticRegression(featuresCol="margin_positive", labelCol="label").fit(held.coalesce(max(1, min(n // 10_000, dataset.sparkSession.sparkContext.defaultParallelism))))
        finally:
            mapped.unpersist()
        return PipelineModel(stages=[fourier, whole, positive, platt])
