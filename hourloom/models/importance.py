"""Feature importance from the nodes of a tree ensemble."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom import schema as S
from hourloom.operators.joins import with_labels
from hourloom.operators.results import flag_top, with_share
from hourloom.session import shared_dir


def nodes(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """The nodes of a tree ensemble: treeID, nodeData. A saved ensemble is a table of them."""
    path = shared_dir(spark, "ensemble")
    model.stages[-1].write().overwrite().save(path)
    return spark.read.parquet(f"{path}/data")


def tree_importance(
    spark: SparkSession,
    model: PipelineModel,
    features: list[str] = S.FEATURES,
    labels: dict[str, str] = S.FEATURE_LABELS,
) -> DataFrame:
    """Loss reduction (gain) and number of splits per feature, with shares; unused features have 0."""
    node = nodes(spark, model).select("nodeData.*").where("leftChild >= 0")
    used = node.groupBy(F.col("split.featureIndex").alias("position")).agg(
        F.sum(F.col("gain") * F.col("rawCount")).alias("gain"), F.count("*").alias("splits")
    )
    names = F.posexplode(F.array(*[F.lit(f) for f in features])).alias("position", "feature")
    table = (
        spark.range(1)
        .select(names)
        .join(used, "position", "left")
        .fillna(0, ["gain", "splits"])
        .drop("position")
    )
    shared = with_share(with_share(table, "gain", "gain_pct"), "splits", "splits_pct")
    return flag_top(with_labels(shared, labels), "gain", ["feature"])
