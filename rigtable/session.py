"""Session defaults and the shared folder used to cut lineage or stage files."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "rigtable", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application, wherever the driver was started."""
    context = spark.sparkContext
    if not getattr(context, "_rigtable_shipped", False):
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "rigtable.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, files in os.walk(root):
                for file in files:
                    if file.endswith(".py"):
                        full = os.path.join(folder, file)
                        out.write(full, os.path.join("rigtable", os.path.relpath(full, root)))
        context.addPyFile(path)
        context._rigtable_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one is made only where none is named."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = context.getCheckpointDir()
    return named or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, visible to every executor."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Materialise to reliable storage, so loops neither grow lineage nor lose work."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """Written in the shared folder as compressed columns and read again: smaller than ``settle``, for tables of many rows."""
    path = scratch_path(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
