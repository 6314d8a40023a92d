"""Random forests and boosted trees."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom import schema as S
from hourloom.models import boosting
from hourloom.models.forest import Forest
from hourloom.models.forest import fit as fit_deep
from hourloom.models.linear import assembler
from hourloom.operators.sampling import sample_exact
from hourloom.session import shared_dir

ROW_KEYS = ["station_id", "datetime"]

# Settings of the reported models and of the learning curves.
FOREST = {"trees": 100, "depth": 15, "min_leaf": 10, "subset": "all"}
FOREST_CURVE = {"trees": 200, "depth": 30, "min_leaf": 1, "subset": "sqrt"}
BOOST = {
    "rounds": 300, "step": 0.05, "depth": 7, "rows": 0.8, "columns": 0.8, "min_leaf": 1, "l2": 1.0, "bins": 256, "patience": 20,
}
BOOST_CURVE = {**BOOST, "rounds": 2000, "depth": 8, "patience": 30}
BOOST_LEAVES = {**BOOST, "rounds": 1000, "depth": None, "leaves": 127, "min_leaf": 20, "l2": 0.0, "bins": 255}
BOOST_LEAVES_CURVE = {**BOOST_LEAVES, "rounds": 2000, "patience": 30}

# Forests up to this depth are Spark's; the nodes of deeper ones grow with the rows and stay in a table.
SPARK_DEPTH = 10
# Memory for the sums of the nodes that one pass splits, in MB and of every running task, and passes between two
# checkpoints of the node ids.
NODE_MEMORY, NODE_CHECKPOINT = 256, 10
# Rows times trees fitted at once: Spark keeps the draws and the node ids of all these trees beside every row.
ROWS_TIMES_TREES = 64_000_000


def fit_rf(
    train: DataFrame,
    features: list[str] = S.FEATURES,
    label: str = S.TARGET,
    trees: int = 100,
    depth: int = 15,
    min_leaf: int = 10,
    subset: str = "all",
    seed: int = S.SEED,
    max_rows: int | None = None,
    keys: list[str] = ROW_KEYS,
) -> PipelineModel | Forest:
    """Random forest. ``max_rows`` trains on an exact uniform sample of that size.

    Trees are independent: large tables get them in groups, one after the other, put together into one model.
    A forest deeper than ``SPARK_DEPTH`` is a ``Forest``, which scores rows without the driver.
    """
    rows = train if max_rows is None else sample_exact(train, max_rows, seed, keys)
    if depth > SPARK_DEPTH:
        return fit_deep(rows, features, label, trees, depth, min_leaf, subset, seed)
    assemble = assembler(features)
    data = assemble.transform(rows).select("features", label).persist()
    try:
        groups = min(trees, -(-trees * data.count() // ROWS_TIMES_TREES)) or 1
        models = []
        for g in range(groups):
            forest = RandomForestRegressor(
                featuresCol="features",
                labelCol=label,
                numTrees=(g + 1) * trees // groups - g * trees // groups,
                maxDepth=depth,
                minInstancesPerNode=min_leaf,
                featureSubsetStrategy=subset,
                # Seeds far apart: a partition's draws start from the seed plus its number.
                seed=seed + g * 1_000_003,
                maxMemoryInMB=NODE_MEMORY,
                cacheNodeIds=True,
                checkpointInterval=NODE_CHECKPOINT,
            )
            models.append(forest.fit(data))
        return PipelineModel([assemble, one_forest(train.sparkSession, models)])
    finally:
        data.unpersist()


def one_forest(spark: SparkSession, models: list[RandomForestRegressionModel]) -> RandomForestRegressionModel:
    """The trees of all forests as one forest, from the tables in which Spark saves them."""
    if len(models) == 1:
        return models[0]
    path = shared_dir(spark, "forest")
    data, about, first = [], [], 0
    for g, model in enumerate(models):
        model.save(f"{path}/{g}")
        data.append(spark.read.parquet(f"{path}/{g}/data").withColumn("treeID", F.col("treeID") + first))
        each = spark.read.parquet(f"{path}/{g}/treesMetadata")
        number = each.columns[0]
        about.append(each.withColumn(number, F.col(number) + first))
        first += model.getNumTrees
    reduce(DataFrame.unionByName, data).write.parquet(f"{path}/all/data")
    reduce(DataFrame.unionByName, about).write.parquet(f"{path}/all/treesMetadata")
    whole = json.loads(spark.read.text(f"{path}/0/metadata").first()[0])
    whole["numTrees"] = whole["paramMap"]["numTrees"] = first
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/all/metadata")
    return RandomForestRegressionModel.load(f"{path}/all")


def fit_gbt(
    train: DataFrame,
    val: DataFrame | None = None,
    features: list[str] = S.FEATURES,
    label: str = S.TARGET,
    bins: int = 256,
    path: str | None = None,
    codes: boosting.Codes | None = None,
    **plan,
) -> PipelineModel:
    """Gradient-boosted trees, stopped early on ``val`` and cut back to the best round.

    ``plan``: fields of ``boosting.Plan``. ``path`` keeps states from which a broken run goes on. ``codes``:
    the same rows as ``boosting.quantised`` wrote them, for several models over some of their inputs.
    """
    model, _ = boosting.fit(train, val, boosting.Plan(**plan), list(features), label, bins, path, codes)
    return PipelineModel([assembler(features), model])


def clipped(model: PipelineModel, df: DataFrame, out: str = "pred") -> DataFrame:
    """Rows with the model's prediction, not below 0."""
    return (
        model.transform(df)
        .withColumn(out, F.greatest(F.col("prediction"), F.lit(0.0)))
        .drop("features", "prediction")
    )
