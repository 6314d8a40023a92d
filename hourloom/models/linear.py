"""Standardisation and ridge regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom import schema as S


def assembler(features: list[str] = S.FEATURES, out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")


def assemble(df: DataFrame, features: list[str] = S.FEATURES, out: str = "features") -> DataFrame:
    """The model inputs as one vector column, in the given order; a null or NaN input raises."""
    return assembler(features, out).transform(df)


def standardize(train: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population standard deviation of each column, one row. A constant gets scale 1."""

    def scale(c: str):
        sd = F.stddev_pop(c)
        return F.when(sd > 0, sd).otherwise(F.lit(1.0))

    return train.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in cols], *[scale(c).alias(f"{c}_scale") for c in cols]
    )


def apply_standard(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """Columns in units of the training spread around the training mean."""
    row = stats.select(F.struct(*stats.columns)).scalar()
    scaled = {
        c: (F.col(c).cast("double") - F.col(f"_s.{c}_mean")) / F.col(f"_s.{c}_scale") for c in cols
    }
    return df.withColumn("_s", row).withColumns(scaled).drop("_s")


def fit_ridge(
    train: DataFrame,
    features: list[str] = S.FEATURES,
    label: str = S.TARGET,
    alpha: float = 1.0,
    scale: bool = True,
) -> PipelineModel:
    """Least squares with penalty ``alpha * |w|^2`` on the summed loss; the intercept is free.

    Spark minimises the mean loss with the label in units of its spread, hence the rescaling.
    ``scale`` penalises weights of standardised inputs, else of the inputs as they are.
    """
    n, spread = train.agg(F.count("*"), F.stddev_pop(label)).first()
    penalty = alpha / n * spread if n and spread else 0.0
    ridge = LinearRegression(
        featuresCol="features",
        labelCol=label,
        regParam=penalty,
        elasticNetParam=0.0,
        standardization=scale,
        solver="normal",
    )
    return Pipeline(stages=[assembler(features), ridge]).fit(train)
