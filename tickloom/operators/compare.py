"""Two factor sets compared by linear regression: fitted on one split, measured on another."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import regression_metrics


def linear_scores(df: DataFrame, factors: Sequence[str], label: str, train: Column) -> DataFrame:
    """df's rows outside ``train`` with x (prediction) and y (label); normal equations by pyspark.ml."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = df.dropna(subset=[*factors, label])
    vec = VectorAssembler(inputCols=list(factors), outputCol="__x").transform(rows)
    model = LinearRegression(featuresCol="__x", labelCol=label, predictionCol="x", solver="normal", standardization=False).fit(vec.where(train))
    return model.transform(vec.where(~train)).withColumn("y", F.col(label).cast("double")).drop("__x")


def compare_sets(df: DataFrame, sets: Mapping[str, Sequence[str]], label: str, train: Column) -> DataFrame:
    """(factor_set, n, mse, rmse, mae, sign_accuracy, pearson): one row a set."""
    out = None
    for name, factors in sets.items():
        m = regression_metrics(linear_scores(df, factors, label, train)).withColumn("factor_set", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out
