"""Readers: every file kind becomes a table with an explicit schema."""

from __future__ import annotations

import ast
import io
import json
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rigtable import schemas
from rigtable.functions.text import clean_label, folder, stem, suffix
from rigtable.operators.labels import valid_shape

try:
    import yaml
except ImportError:  # pragma: no cover - the class registry and capture readers need it
    yaml = None

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp")


def _relative(path: Column, root: str) -> Column:
    """Folder of a file below the root ('' at the root itself)."""
    inner = F.regexp_replace(folder(path), r"^.*?" + _quote(root.rstrip("/").split("/")[-1]) + r"(/|$)", "")
    return inner


def _quote(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


# --- annotations -------------------------------------------------------------------


def read_labelme(spark: SparkSession, path: str, layout: str = "files") -> DataFrame:
    """One row per annotation document with ``pool, stem, path`` and nested shapes.

    ``files`` is one JSON document per image; ``lines`` is the bulk layout (one document
    per line carrying its own pool and stem) for pools of many millions of images.
    """
    if layout == "lines":
        return spark.read.schema("pool STRING, stem STRING, path STRING, " + schemas.LABELME).json(path)
    docs = (
        spark.read.schema(schemas.LABELME)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
    )
    file = F.col("_metadata.file_path")
    return docs.select(
        _relative(file, path).alias("pool"), stem(file).alias("stem"), file.alias("path"), *docs.columns
    )


def explode_shapes(docs: DataFrame) -> DataFrame:
    """One row per shape with its position; missing fields read as in the documents' defaults."""
    keys = [c for c in ("pool", "stem", "path") if c in docs.columns]
    return docs.select(
        *keys,
        F.coalesce("imageWidth", F.lit(0)).alias("width"),
        F.coalesce("imageHeight", F.lit(0)).alias("height"),
        F.posexplode("shapes").alias("line_no", "_s"),
    ).select(
        *keys, "width", "height", "line_no", clean_label(F.col("_s.label")).alias("label"), "_s.points", "_s.group_id",
        F.coalesce("_s.shape_type", F.lit("?")).alias("shape_type"),
    )


def list_images(spark: SparkSession, path: str, suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    """Image files without their content (the scan prunes it)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = suffix(F.col("path"))
    return files.filter(kind.isin(list(suffixes))).select(
        _relative(F.col("path"), path).alias("pool"), stem(F.col("path")).alias("stem"), kind.alias("suffix"),
        "path", F.col("modificationTime").alias("mtime"), "length",
    )


def image_size(content: pd.Series) -> list[tuple[int | None, int | None]]:
    """Width and height from PNG, JPEG or BMP header bytes, null when unreadable."""
    out = []
    for data in content:
        size = (None, None)
        try:
            if data[:8] == b"\x89PNG\r\n\x1a\n":
                size = struct.unpack(">II", data[16:24])
            elif data[:2] == b"BM":
                w, h = struct.unpack("<ii", data[18:26])
                size = (w, abs(h))
            elif data[:2] == b"\xff\xd8":
                at = 2
                while at + 9 < len(data):
                    marker, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                    if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                        h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                        size = (w, h)
                        break
                    at += 2 + length
        except (struct.error, IndexError, TypeError):
            pass
        out.append(size)
    return out


def fill_sizes(docs: DataFrame, files: DataFrame, keys: Sequence[str] = ("pool", "stem")) -> DataFrame:
    """Width and height of documents that lack them, read from the image headers.

    Only images of such documents are opened; ``files`` has path-derived keys and content.
    """
    keys = list(keys)
    known = (F.coalesce("imageWidth", F.lit(0)) > 0) & (F.coalesce("imageHeight", F.lit(0)) > 0)
    bare = docs.filter(~known).select(*keys).distinct()

    @F.pandas_udf("struct<w:int,h:int>")
    def measured(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(image_size(content), columns=["w", "h"]).astype("Int32")

    sizes = files.join(bare, keys, "left_semi").select(*keys, measured("content").alias("_s"))
    sizes = sizes.groupBy(*keys).agg(F.first("_s", ignorenulls=True).alias("_s"))
    return (
        docs.join(sizes, keys, "left")
        .withColumns(
            {
                "imageWidth": F.when(known, F.col("imageWidth")).otherwise(F.col("_s.w")),
                "imageHeight": F.when(known, F.col("imageHeight")).otherwise(F.col("_s.h")),
            }
        )
        .drop("_s")
    )


def image_bytes(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.filter(suffix(F.col("path")).isin(list(IMAGE_SUFFIXES))).select(
        _relative(F.col("path"), path).alias("pool"), stem(F.col("path")).alias("stem"), "content"
    )


# --- label lines ---------------------------------------------------------------------


def parse_yolo(lines: DataFrame, raw: str = "raw", dialect: str = "analysis") -> DataFrame:
    """Adds ``class_id``, ``poly`` and ``skipped`` to label lines; blank lines are dropped.

    ``analysis`` accepts a line of seven tokens or more, an integer class and paired
    coordinates and marks the rest skipped.  ``qc`` takes the class through a float, drops
    a trailing odd coordinate and keeps every polygon for the checks.
    """
    tokens = F.split(F.trim(F.regexp_replace(F.col(raw), r"\s+", " ")), " ")
    rows = lines.withColumn("_t", tokens).filter(F.trim(F.regexp_replace(F.col(raw), r"\s+", " ")) != "")
    coords = F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0)))
    value = lambda i: F.try_element_at("_c", i).try_cast("double")
    points = F.transform(
        F.filter(F.sequence(F.lit(0), F.floor(F.size("_c") / 2).cast("int")), lambda i: (i + 1) * 2 <= F.size("_c")),
        lambda i: F.struct(value(i * 2 + 1).alias("x"), value(i * 2 + 2).alias("y")),
    )
    if dialect == "qc":
        cls = F.element_at("_t", 1).try_cast("double").cast("int")
        bad = F.lit(False)
    else:
        first = F.element_at("_t", 1)
        cls = F.when(first.rlike(r"^[+-]?\d+$"), first.try_cast("int"))
        bad = (F.size("_t") < 7) | cls.isNull() | (F.size("_t") % 2 == 0)
    out = rows.withColumn("_c", coords).withColumn("class_id", cls).withColumn("skipped", bad)
    return out.withColumn("poly", F.when(~F.col("skipped"), points)).drop("_t", "_c")


def read_yolo(spark: SparkSession, path: str, dialect: str = "analysis") -> DataFrame:
    """Label files below ``labels/<split>/`` as lines, numbered per file; empty files give no row."""
    files = spark.read.text(f"{path}/labels", wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    file = F.col("_metadata.file_path")
    lines = files.select(
        F.element_at(F.split(file, "/"), -2).alias("split"), stem(file).alias("stem"),
        F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "raw"),
    )
    return parse_yolo(lines, "raw", dialect)


# --- registries and small tables --------------------------------------------------------


def class_entries(entries: Sequence) -> list[tuple[int, str, str]]:
    """Ordered (id, name, prompt) of a registry given as names or mappings with a name."""
    if not entries:
        raise ValueError("the class registry is empty")
    rows: list[tuple[int, str, str]] = []
    for i, entry in enumerate(entries):
        name = entry.get("name") if isinstance(entry, dict) else entry
        if name is None or not isinstance(name, (str, int, float)):
            raise ValueError(f"class #{i} needs a name")
        name = str(name).strip()
        prompt = str(entry.get("prompt", name)) if isinstance(entry, dict) else name
        if name:
            rows.append((len(rows), name, prompt))
    return rows


def classes_frame(spark: SparkSession, entries: Sequence) -> DataFrame:
    return spark.createDataFrame(class_entries(entries), "class_id INT, name STRING, prompt STRING")


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """Class registry or dataset manifest (``classes:`` list, ``names:`` list or map)."""
    if yaml is None:
        raise RuntimeError("reading a YAML registry needs PyYAML")
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    data = yaml.safe_load(text) or {}
    names = data.get("names")
    if isinstance(names, dict):
        rows = [(int(k), str(v), str(v)) for k, v in sorted(names.items(), key=lambda kv: int(kv[0]))]
        return spark.createDataFrame(rows, "class_id INT, name STRING, prompt STRING")
    return classes_frame(spark, names or data.get("classes") or [])


def read_prelabels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PRELABEL).json(path)


def prelabel_documents(records: DataFrame, min_score: float = 0.0, version: str = "5.5.0") -> DataFrame:
    """Prelabel records as annotation documents: confident detections of three points or more."""
    kept = F.filter("detections", lambda d: (F.coalesce(d["score"], F.lit(1.0)) >= min_score) & (F.size(d["polygon"]) >= 3))
    shapes = F.transform(
        kept,
        lambda d: F.struct(
            d["class"].alias("label"), d["polygon"].alias("points"), F.lit(None).cast("int").alias("group_id"),
            F.lit("polygon").alias("shape_type"), F.create_map().cast("map<string,boolean>").alias("flags"),
        ),
    )
    return records.select(
        stem(F.col("image")).alias("stem"), F.lit(version).alias("version"),
        F.create_map().cast("map<string,boolean>").alias("flags"), shapes.alias("shapes"), F.col("image").alias("imagePath"),
        F.lit(None).cast("string").alias("imageData"), F.col("height").alias("imageHeight"), F.col("width").alias("imageWidth"),
    )


def read_run_metrics(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(schemas.RUN_METRICS)
    return reader.option("header", True).option("nanValue", "nan").csv(path) if fmt == "csv" else reader.json(path)


def read_sessions(spark: SparkSession, path: str, layout: str = "files") -> DataFrame:
    """Calibration samples, one row each, from a folder a session or from the lines of ``sinks.write_sessions``."""
    reader = spark.read.schema(schemas.SESSION)
    docs = reader.json(path) if layout == "lines" else reader.option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return docs.select("session_id", "base_frame", "ee_frame", "board", F.explode("samples").alias("_s")).select(
        "session_id", "base_frame", "ee_frame", "board", "_s.*"
    )


def resume_session(earlier: DataFrame, new: DataFrame, order: str = "taken_at") -> DataFrame:
    """Earlier samples plus the new ones numbered on from the highest index of their session."""
    from rigtable.scale import number_rows

    top = earlier.groupBy("session_id").agg(F.max("index").alias("_top"))
    numbered = number_rows(new, ["session_id"], F.floor(F.col(order).cast("double") / 3600), [F.col(order)], "_n")
    added = numbered.join(top, "session_id", "left").withColumn(
        "index", (F.coalesce("_top", F.lit(-1)) + F.col("_n")).cast("int")
    )
    return earlier.unionByName(added.select(*earlier.columns))


# --- captures --------------------------------------------------------------------------

CAPTURE_PARTS = {"rgb": ("rgb.png",), "depth": ("depth.npy",), "intrinsics": ("intrinsics.yaml",), "label": ("rgb.json", "labels.json")}


def gather_captures(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete captures, incomplete ones with a reason) from file rows ``path, content``.

    A capture is a folder: ``folder`` is its whole path and tells captures of one name apart, ``capture_id`` its last part.
    """
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    names = [n for options in CAPTURE_PARTS.values() for n in options]
    # Four files per capture, so a group is bounded by one capture's parts.
    parts = (
        files.filter(name.isin(names))
        .groupBy(folder.alias("folder"))
        .agg(*[F.coalesce(*[F.max(F.when(name == n, F.col("content"))) for n in options]).alias(part) for part, options in CAPTURE_PARTS.items()])
    )
    lacking = F.concat_ws(",", *[F.when(F.col(p).isNull(), F.lit(p)) for p in CAPTURE_PARTS])
    parts = parts.select(F.element_at(F.split("folder", "/"), -1).alias("capture_id"), "*", lacking.alias("reason"))
    rejected = parts.filter("reason <> ''").select("capture_id", "folder", F.concat(F.lit("missing "), F.col("reason")).alias("reason"))
    return parts.filter("reason = ''").drop("reason"), rejected


def read_captures(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Complete captures with parsed intrinsics, and the rejected ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    ok, rejected = gather_captures(files)
    return ok.withColumn("intrinsics", parse_intrinsics("intrinsics")), rejected


def parse_intrinsics(content: str) -> Column:
    @F.pandas_udf("string")
    def as_json(data: pd.Series) -> pd.Series:
        return data.map(lambda b: json.dumps(yaml.safe_load(bytes(b).decode())))

    return F.from_json(as_json(content), schemas.INTRINSICS)


def npy_array(data: bytes) -> np.ndarray:
    """View of a .npy payload without copying it."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not an npy payload")
    wide = data[6] >= 2
    size = struct.unpack("<I" if wide else "<H", data[8 : 12 if wide else 10])[0]
    start = (12 if wide else 10) + size
    head = ast.literal_eval(data[start - size : start].decode("latin1"))
    flat = np.frombuffer(data, dtype=np.dtype(head["descr"]), offset=start)
    return flat.reshape(head["shape"], order="F" if head["fortran_order"] else "C")


def npy_bytes(array: np.ndarray) -> bytes:
    buffer = io.BytesIO()
    np.save(buffer, array)
    return buffer.getvalue()


def explode_depth(captures: DataFrame, depth_scale: float = 1.0, keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Pixels ``v, u, depth_m`` of the stored depth maps.

    The shape must equal the intrinsics' size; ``shape_ok`` is false on the single marker
    row of a capture where it does not.
    """
    keys = list(keys)
    fields = {f.name: f.dataType.simpleString() for f in captures.schema.fields}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + ", v INT, u INT, depth_m FLOAT, shape_ok BOOLEAN"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                depth = npy_array(bytes(row.depth))
                head = {k: getattr(row, k) for k in keys}
                if depth.ndim != 2 or depth.shape != (row.h, row.w):
                    yield pd.DataFrame([{**head, "v": None, "u": None, "depth_m": None, "shape_ok": False}])
                    continue
                v, u = np.indices(depth.shape, dtype="int32")
                yield pd.DataFrame(
                    {**head, "v": v.ravel(), "u": u.ravel(), "depth_m": (depth.astype("float32") * np.float32(depth_scale)).ravel(), "shape_ok": True}
                )

    sized = captures.select(*keys, "depth", F.col("intrinsics.height").alias("h"), F.col("intrinsics.width").alias("w"))
    return sized.mapInPandas(run, schema)


# --- streams -----------------------------------------------------------------------------


def stream_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.FRAMES).json(path)


def explode_detections(frames: DataFrame) -> DataFrame:
    return frames.select("session_id", "frame_index", "ts", F.posexplode("detections").alias("det_idx", "_d")).select(
        "session_id", "frame_index", "ts", "det_idx", "_d.*"
    )


def stream_joint_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.JOINT_STATES).json(path)


def stream_arm_status(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.ARM_STATUS).json(path)


def unnest_status(status: DataFrame) -> DataFrame:
    """One row per joint of each arm status."""
    zipped = F.arrays_zip("joint_names", "per_joint_status_code")
    return status.select("robot_id", "ts", "mode", "enabled", "state_machine", F.explode(zipped).alias("_z")).select(
        "robot_id", "ts", "mode", "enabled", "state_machine",
        F.col("_z.joint_names").alias("joint"), F.col("_z.per_joint_status_code").alias("status_code"),
    )


def usable_shapes(docs: DataFrame) -> DataFrame:
    return explode_shapes(docs).filter(valid_shape())
