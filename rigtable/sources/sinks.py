"""Writers.  Bulk layouts first; file-per-image ones stream rows sorted by file."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigtable.operators.tracking import frame_records
from rigtable.session import settle


def _write_text_files(rows: DataFrame, root: str, file: str, text: str, order: Sequence[str]) -> DataFrame:
    """Rows of text grouped into files, streamed in order; returns file and line count.

    A file's rows sit in one task because a file has one writer, but only one line is
    held at a time.  Null text makes an empty file.  A task that is tried again rewrites
    its files whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(root) if "://" in root else pafs.FileSystem.from_uri("file://" + root.removeprefix("file:"))
        current, sink, lines = None, None, 0

        def close() -> pd.DataFrame:
            sink.close()
            return pd.DataFrame({"file": [current], "lines": [lines]})

        for batch in batches:
            for name, value in zip(batch[file], batch[text]):
                if name != current:
                    if sink is not None:
                        yield close()
                    target = f"{base}/{name}"
                    fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    current, sink, lines = name, fs.open_output_stream(target), 0
                if value is not None:
                    sink.write(value.encode() + b"\n")
                    lines += 1
        if sink is not None:
            yield close()

    placed = rows.select(file, text, *[c for c in order if c not in (file, text)])
    done = placed.repartition(file).sortWithinPartitions(file, *order).mapInPandas(run, "file STRING, lines BIGINT")
    return settle(done)


def labelme_document() -> Column:
    """JSON text of an annotation document from its fields."""
    names = ["version", "flags", "shapes", "imagePath", "imageData", "imageHeight", "imageWidth"]
    return F.to_json(F.struct(*[F.col(n) for n in names]), {"ignoreNullFields": "false"})


def write_text_files(rows: DataFrame, root: str) -> DataFrame:
    """Rows ``file, text`` as one file each name; file and line count come back once the result is read."""
    return _write_text_files(rows, root, "file", "text", [])


def write_labelme(docs: DataFrame, path: str, layout: str = "lines") -> DataFrame | None:
    """Annotation documents as JSON lines, compressed (the text repeats its field names in every shape), or as one file per image."""
    if layout == "lines":
        docs.write.mode("overwrite").option("ignoreNullFields", "false").option("compression", "gzip").json(path)
        return None
    folder = F.when(F.coalesce("pool", F.lit("")) != "", F.concat("pool", F.lit("/"))).otherwise("") if "pool" in docs.columns else F.lit("")
    rows = docs.select(F.concat(folder, F.col("stem"), F.lit(".json")).alias("file"), labelme_document().alias("text"))
    return _write_text_files(rows, path, "file", "text", [])


def write_yolo(lines: DataFrame, path: str, layout: str = "lines") -> DataFrame | None:
    """Label lines ``split, stem, line_no, line`` (null line for an image without labels).

    ``lines`` writes text rows partitioned by split; ``files`` writes
    ``labels/<split>/<stem>.txt``, empty where an image has no line.
    """
    if layout == "lines":
        lines.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("split").json(path)
        return None
    rows = lines.select(
        F.concat(F.lit("labels/"), F.col("split"), F.lit("/"), F.col("stem"), F.lit(".txt")).alias("file"), F.col("line").alias("text"), "line_no"
    )
    return _write_text_files(rows, path, "file", "text", ["line_no"])


def write_sessions(docs: DataFrame, path: str, layout: str = "lines") -> DataFrame | None:
    """Calibration sessions as JSON lines, compressed, or as ``<session_id>/session.json`` each: a folder a session costs a listing each time it is read."""
    if layout == "lines":
        docs.write.mode("overwrite").option("ignoreNullFields", "false").option("compression", "gzip").json(path)
        return None
    text = F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"})
    return write_text_files(docs.select(F.concat("session_id", F.lit("/session.json")).alias("file"), text.alias("text")), path)


def manifest_text(classes: DataFrame) -> DataFrame:
    """Dataset manifest lines; the registry is small, so one ordered column is fine."""
    head = [(0, "path: ."), (1, "train: images/train"), (2, "val: images/val"), (3, "names:")]
    spark = classes.sparkSession
    names = classes.select((F.col("class_id") + 4).alias("i"), F.format_string("  %d: %s", "class_id", "name").alias("value"))
    return spark.createDataFrame(head, "i INT, value STRING").unionByName(names).orderBy("i").select("value")


def write_manifest(classes: DataFrame, path: str) -> None:
    manifest_text(classes).coalesce(1).write.mode("overwrite").text(path)


def write_frames(stream: DataFrame, path: str, state: str, stable_only: bool = False, once: bool = False):
    """Streaming JSON sink of rounded frame records; ``once`` ends when everything available is written."""
    records = frame_records(stream, stable_only).writeStream.format("json").outputMode("append").option("checkpointLocation", state)
    return (records.trigger(availableNow=True) if once else records).start(path)


def write_points(points: DataFrame, path: str, meta: DataFrame | None = None) -> None:
    """Labelled points partitioned by capture, with the per-capture facts in a sibling table."""
    points.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("capture_id").parquet(path)
    if meta is not None:
        meta.write.mode("overwrite").parquet(path.rstrip("/") + ".meta")


def read_points(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_ranking(ranked: DataFrame, path: str) -> None:
    ranked.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # one row per model


PLY_HEAD = "ply\nformat ascii 1.0\nelement vertex {n}\n" + "".join(
    f"property {kind} {name}\n" for kind, name in (("float", "x"), ("float", "y"), ("float", "z"), ("uchar", "red"), ("uchar", "green"), ("uchar", "blue"))
) + "end_header"


def ply_lines(points: DataFrame, key: str = "capture_id", order: str = "point_id") -> DataFrame:
    """Header and vertex lines of each capture, sorted by ``line_no``."""
    head = points.groupBy(key).agg(F.count("*").alias("_n")).select(
        key, F.lit(-1).cast("long").alias("line_no"), F.replace(F.lit(PLY_HEAD), F.lit("{n}"), F.col("_n").cast("string")).alias("line")
    )
    body = points.select(
        key, F.col(order).cast("long").alias("line_no"), F.format_string("%.6f %.6f %.6f %d %d %d", "x", "y", "z", *[F.col(c).cast("int") for c in "rgb"]).alias("line")
    )
    return head.unionByName(body)


def write_ply(points: DataFrame, path: str, key: str = "capture_id", order: str = "point_id") -> DataFrame:
    rows = ply_lines(points, key, order).withColumn("file", F.concat(F.col(key).cast("string"), F.lit(".ply")))
    return _write_text_files(rows, path, "file", "line", ["line_no"])


def overwrite_captures(df: DataFrame, path: str, key: str = "capture_id") -> None:
    """Replace the outputs of the captures present in ``df`` only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
