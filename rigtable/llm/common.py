"""What the training-data operators share: reading a table, staging in the shared folder, block counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigtable.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write below the folder that all executors share and read again: later uses neither recompute nor lose it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(docs: DataFrame, text: str, block_bytes: int) -> int:
    """Blocks of about ``block_bytes`` of text, never fewer than the shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(shuffle_parts(docs.sparkSession), -(-total // block_bytes))


def crc_mod(id_col: str, n: int):
    """crc32 of the id's decimal text, modulo n; null ids count as the text of no characters."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n
