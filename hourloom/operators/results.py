"""Result tables: scores, leaderboards, curves and their upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.functions.errors import clip_low, mae, rmse


def evaluate(
    predicted: DataFrame, model: str, y: str = "departures", p: str = "prediction"
) -> DataFrame:
    """RMSE and MAE per split of the prediction clipped at 0."""
    pred = clip_low(F.col(p).cast("double"))
    return predicted.groupBy("split").agg(
        rmse(y, pred).alias("rmse"), mae(y, pred).alias("mae")
    ).select(F.lit(model).alias("model"), "split", "rmse", "mae")


def naive(features: DataFrame, col: str = "lag_1h") -> DataFrame:
    """Persistence forecast: the value an earlier hour had."""
    return features.withColumn("prediction", clip_low(F.col(col).cast("double")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key does not come again, and the new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def pending(manifest: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that are not done yet."""
    return manifest.join(done.select(*keys).distinct(), keys, "left_anti")


def pending_runs(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Learning-curve runs left to do; fractions are compared at two decimals."""

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_f", F.round("fraction", 2))

    return pending(keyed(plan), keyed(done), ["model", "_f"]).drop("_f")


def leaderboard(metrics: DataFrame, digits: int = 4) -> DataFrame:
    """One row per model, val and test scores side by side, best test RMSE first."""
    wide = metrics.groupBy("model").pivot("split", ["val", "test"]).agg(
        F.first("rmse").alias("rmse"), F.first("mae").alias("mae")
    )
    scores = ["rmse_val", "rmse_test", "mae_val", "mae_test"]
    return wide.select(
        "model",
        *[F.round("_".join(reversed(s.split("_"))), digits).alias(s) for s in scores],
    ).orderBy("rmse_test", "model")


def improvement(metrics: DataFrame, base: str) -> DataFrame:
    """Relative gain of each model over a baseline, per split, in percent."""
    ref = metrics.where(F.col("model") == base).select(
        "split", F.col("rmse").alias("base_rmse"), F.col("mae").alias("base_mae")
    )

    def gain(c: str) -> Column:
        return (1.0 - F.col(c) / F.col(f"base_{c}")) * 100.0

    return metrics.join(ref, "split").select(
        "model", "split", gain("rmse").alias("rmse_gain_pct"), gain("mae").alias("mae_gain_pct")
    )


def with_share(df: DataFrame, value: str, out: str = "share_pct") -> DataFrame:
    """Each row's share of the column's total, in percent."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(out, F.col(value) / total * 100.0)


def flag_top(df: DataFrame, value: str, keys: list[str], k: int = 3, out: str = "is_top") -> DataFrame:
    """Mark the k rows with the largest values; ties in key order."""
    top = (
        df.orderBy(F.desc(value), *keys).limit(k).select(*keys).withColumn(out, F.lit(True))
    )
    return df.join(F.broadcast(top), keys, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def curve_table(runs: DataFrame) -> DataFrame:
    """Mean scores per model and training size."""
    return runs.groupBy("model", "n_rows").agg(
        F.avg("val_rmse").alias("val_rmse"), F.avg("test_rmse").alias("test_rmse")
    )


def curve_endpoints(runs: DataFrame) -> DataFrame:
    """The run with the most rows of each model."""
    last = F.max(F.struct("n_rows", "val_rmse")).alias("last")
    return runs.groupBy("model").agg(last).select("model", "last.n_rows", "last.val_rmse")


def ticks(runs: DataFrame) -> DataFrame:
    """Training sizes per model in order, for a chart axis. The plan holds one run per fraction."""
    return runs.groupBy("model").agg(F.array_sort(F.collect_set("n_rows")).alias("ticks"))


def best_trial(trials: DataFrame, params: list[str], score: str = "val_rmse") -> DataFrame:
    """Parameters of the trial with the lowest score; ties to the first trial."""
    best = F.min(F.struct(score, "trial", *params)).alias("best")
    return trials.agg(best).select(F.col(f"best.{score}").alias(f"best_{score}"),
                                   *[f"best.{p}" for p in params])
