"""Margin classifier with a Gaussian kernel, by random Fourier features.

``exp(-gamma |x - y|^2)`` is the mean of ``2 cos(w x + b) cos(w y + b)`` over normal ``w`` and even ``b`` (Rahimi
and Recht 2007), so a linear margin on ``dimensions`` such cosines is a kernel margin. The error of a kernel
value falls with the root of the dimensions. Probabilities come from a logistic fit of margins that models
without the row's fold gave, as margins of rows a model was fitted on are too wide.
"""

from __future__ import annotations

import sys
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle, inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasFeaturesCol, HasInputCol, HasLabelCol, HasMaxIter, HasOutputCol, HasSeed, HasWeightCol,
)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.session import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows whose cosines are computed together.
ROWS = 4096


def directions(width: int, dimensions: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and shifts of the cosines."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, np.sqrt(2 * gamma), (width, dimensions)), rng.uniform(0, 2 * np.pi, dimensions)


class FourierMap(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable,
                 DefaultParamsWritable):
    """Vectors whose inner products are close to the Gaussian kernel of the input."""

    dimensions = Param(Params._dummy(), "dimensions", "number of cosines", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "width of the kernel", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="_kernel", dimensions=256, gamma=1.0, seed=42):
        super().__init__()
        self._set(**{"inputCol": inputCol, "outputCol": outputCol, "dimensions": dimensions,
                     "gamma": gamma, "seed": seed, **self._input_kwargs})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, gamma, seed = (self.getOrDefault(p) for p in ("dimensions", "gamma", "seed"))

        @F.arrow_udf("array<double>")
        def cosines(x: pa.Array) -> pa.Array:
            # one buffer for a whole batch, filled in place
            ends = np.arange(0, (len(x) + 1) * size, size, dtype=np.int32)[:len(x) + 1]
            out = np.empty((len(x), size))
            if len(x):
                given = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
                w, b = directions(given.shape[1], size, gamma, seed)
                for at in range(0, len(x), ROWS):
                    part = out[at:at + ROWS]
                    np.matmul(given[at:at + ROWS], w, out=part)
                    part += b
                    np.cos(part, out=part)
                    part *= np.sqrt(2 / size)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(cosines(
            vector_to_array(self.getInputCol()))))


class KernelClassifier(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol, HasMaxIter, HasSeed,
                       DefaultParamsReadable, DefaultParamsWritable):
    """Gaussian-kernel margin with calibrated probabilities.

    ``C`` is the inverse weight of the ridge penalty on a summed loss. Without ``gamma`` it is one over the
    number of features and the variance of all their values. Folds of the calibration follow the hash
    of the features, so equal rows share one.
    """

    C = Param(Params._dummy(), "C", "inverse penalty", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "width of the kernel", TypeConverters.toFloat)
    dimensions = Param(Params._dummy(), "dimensions", "number of cosines", TypeConverters.toInt)
    folds = Param(Params._dummy(), "folds", "folds of the calibration", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", weightCol=None, maxIter=100, seed=42,
                 C=1.0, gamma=None, dimensions=256, folds=3):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", maxIter=100, seed=42, C=1.0,
                         dimensions=256, folds=3)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        get = self.getOrDefault
        features, label = self.getFeaturesCol(), self.getLabelCol()
        weighted = self.isDefined("weightCol") and bool(get("weightCol"))
        gamma = get("gamma") if self.isSet("gamma") else scale(dataset, features)
        kernel = FourierMap(inputCol=features, dimensions=get("dimensions"), gamma=gamma,
                            seed=get("seed"))
        weight = F.col(get("weightCol")).cast("double") if weighted else F.lit(1.0)
        k = get("folds")
        data = staged(kernel.transform(dataset.select(
            features, F.col(label).cast("double").alias("label"), weight.alias("weight"),
            F.pmod(F.xxhash64(vector_to_array(features)), F.lit(k)).alias("fold"))).drop(features),
            "kernel")
        # the last fit sees all rows; the fits run side by side
        with ThreadPool(k + 1) as pool:
            fits = pool.map(inheritable_thread_target(dataset.sparkSession)(
                lambda i: self._margin(data.where(F.col("fold") != i))), range(k + 1))
        margins = [m.transform(data.where(F.col("fold") == i)) for i, m in enumerate(fits[:k])]
        # the margin of class 1, as a vector of one number
        slicer = VectorSlicer(inputCol="_margin", outputCol="_margin_vector", indices=[1])
        held_out = slicer.transform(reduce(DataFrame.unionByName, margins))
        sigmoid = LogisticRegression(featuresCol="_margin_vector", labelCol="label", weightCol="weight",
                                     maxIter=100).fit(held_out)
        return PipelineModel([kernel, fits[k], slicer, sigmoid])

    def _margin(self, data: DataFrame):
        """Linear margin on the cosines."""
        n = data.agg(F.sum("weight")).first()[0] or 1.0
        return LinearSVC(featuresCol="_kernel", labelCol="label", weightCol="weight",
                         maxIter=self.getMaxIter(), regParam=1.0 / (self.getOrDefault("C") * n),
                         standardization=False, predictionCol="_margin_label",
                         rawPredictionCol="_margin").fit(data)


def scale(dataset: DataFrame, features: str) -> float:
    """One over the number of features and the variance of all values."""
    x = vector_to_array(features)
    rows = dataset.select(F.size(x).alias("k"), F.aggregate(x, F.lit(0.0), lambda s, v: s + v).alias("s"),
                          F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v).alias("q"))
    k, n, s, squares = rows.agg(F.max("k"), F.sum("k"), F.sum("s"), F.sum("q")).first()
    variance = squares / n - (s / n) ** 2 if n else 0.0
    return 1.0 / (k * variance) if n and variance > 0 else 1.0
