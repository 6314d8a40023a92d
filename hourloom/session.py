"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# SQL settings the plans rely on. They change physical planning only, never results.
PLAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Lets the (entity, block) exchange of a panel serve the grid join and the lag window alike,
    # so that the dense rows are generated in place and never shuffled.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # A feature table has three splits: write them side by side instead of sorting every row first.
    "spark.sql.maxConcurrentOutputFileWriters": "16",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the planner settings to a session that somebody else has built."""
    for name, value in PLAN_CONF.items():
        spark.conf.set(name, value)
    return spark


def build_session(app: str = "hourloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for name, value in {**PLAN_CONF, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name, with its scheme, under the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Where that is unset a local session uses its
    warehouse folder; on a cluster it must be set, since executors do not share other folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/hourloom-{label}-{uuid.uuid4().hex}")
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return at.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Cache a table for a while; a cache that the caller already holds stays in force."""
    level = df.storageLevel
    own = not (level.useMemory or level.useDisk)
    if own:
        df.persist()
    try:
        yield df
    finally:
        if own:
            df.unpersist()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a result to the shared folder and go on from the files."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
