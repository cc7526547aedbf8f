"""Vectors from a caller's model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweft.functions.vectors import unit

MODEL_BATCH = 8


def tolerant(make_model: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """The model with a vector of NaN for missing values and for values it fails on. A batch that fails is given to the
    model again value by value."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        model = make_model()

        def vectors(values: np.ndarray) -> list[np.ndarray | None]:
            try:
                found = np.asarray(model(values), dtype=np.float32)
                if found.ndim != 2 or len(found) != len(values):
                    raise ValueError("the model gave another number of vectors")
                return list(found)
            except Exception:  # the model is the caller's: whatever it raises belongs to its values
                if len(values) == 1:
                    return [None]
                return [found for i in range(len(values)) for found in vectors(values[i : i + 1])]

        def predict(values: np.ndarray) -> np.ndarray:
            given = np.array([value is not None for value in values], dtype=bool)
            found = dict(zip(np.flatnonzero(given).tolist(), vectors(values[given]) if given.any() else [], strict=True))
            width = max((len(vector) for vector in found.values() if vector is not None), default=1)
            out = np.full((len(values), width), np.nan, dtype=np.float32)
            for row, vector in found.items():
                if vector is not None:
                    out[row] = vector
            return out

        return predict

    return make


def encode(
    df: DataFrame,
    source: str,
    make_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    target: str = "embedding",
    batch_size: int = MODEL_BATCH,
) -> DataFrame:
    """Add the unit-length vector the model gives for each value of ``source``.

    ``make_model`` is called once per Python worker and returns a function from a batch of values to a matrix. Rows
    without value, rows on which the model raises, and rows for which it gives a vector without length or with a component
    that is no number, have a NULL vector; the other rows of their batch keep theirs. The source is read once.
    """
    model = predict_batch_udf(tolerant(make_model), return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    given = df.withColumn(target, model(F.col(source)))
    usable = F.col(source).isNotNull() & ~F.exists(F.col(target), lambda x: x.isNull() | F.isnan(x))
    return given.withColumn(target, F.when(usable, unit(F.col(target))))
