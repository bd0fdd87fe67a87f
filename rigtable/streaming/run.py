"""Draining a stream into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rigtable.session import scratch_path


def drain(stream: DataFrame, path: str | None = None, fmt: str = "parquet", mode: str = "append", seen: list[StreamingQuery] | None = None) -> DataFrame:
    """Process everything available, then read the sink back; ``seen`` gets the query, for its progress."""
    spark = SparkSession.active()
    target = path or scratch_path(spark, "stream")
    query = (
        stream.writeStream.format(fmt)
        .outputMode(mode)
        .option("checkpointLocation", f"{target}.state")
        .trigger(availableNow=True)
        .start(target)
    )
    query.awaitTermination()
    if seen is not None:
        seen.append(query)
    return spark.read.schema(stream.schema).format(fmt).load(target)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were dropped, over the progress reports that the query keeps."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def state_rows(query: StreamingQuery) -> int:
    """Rows of state held after the last micro-batch."""
    return sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"])


def closed(stream: DataFrame, ts: str = "ts", at: str = "2100-01-01") -> DataFrame:
    """The stream with one last row far in the future, null but for its time.

    It moves the watermark past all data, so that windows and sessions still open when the input ends are
    emitted; its own window never is.
    """
    spark = SparkSession.active()
    path = scratch_path(spark, "closing")
    row = spark.range(1).select(*[(F.lit(at) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema.fields])
    row.write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def stream_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stream a parquet table that is either a folder of files or one single file."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place)
    reader = spark.readStream.schema(schema)
    if status.isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", place.getName()).parquet(str(place.getParent().toString()))
