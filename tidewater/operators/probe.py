"""A linear probe: one logistic regression a class on fixed embeddings."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, OneVsRest, OneVsRestModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _features(rows: DataFrame, vec: str) -> DataFrame:
    return rows.withColumn("_x", array_to_vector(F.col(vec).cast("array<double>")))


def fit(rows: DataFrame, vec: str, code: str, iterations: int = 50, ridge: float = 1e-4) -> OneVsRestModel:
    """A model of class codes 0, 1, ...; rows without a vector or code do not count."""
    x = _features(rows.where(F.col(vec).isNotNull() & F.col(code).isNotNull()), vec).select("_x", F.col(code).cast("double").alias("_y"))
    one = LogisticRegression(maxIter=iterations, regParam=ridge)
    return OneVsRest(classifier=one, featuresCol="_x", labelCol="_y", predictionCol="_p").fit(x)


def predict(rows: DataFrame, model: OneVsRestModel, vec: str) -> DataFrame:
    """rows with pred, the likeliest class's code."""
    return model.transform(_features(rows, vec)).withColumn("pred", F.col("_p").cast("int")).select(*rows.columns, "pred")


def save(model: OneVsRestModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> OneVsRestModel:
    return OneVsRestModel.load(path)
