import glob
import os

from rigtable import schemas
from rigtable.sources import readers as rd
from rigtable.sources import sinks as sk


def test_annotation_lines_are_small_and_come_back(spark, tmp_path):
    shapes = [("cork", [[float(k), 2.0], [3.0, 4.5], [5.0, 6.0]], None, "polygon", {}) for k in range(50)]
    rows = [("a", str(k), f"a/{k}.json", "5.5.0", {}, shapes if k % 3 else [], "x.png", None, 48, 64) for k in range(40)]
    docs = spark.createDataFrame(rows, "pool STRING, stem STRING, path STRING, " + schemas.LABELME.replace(", _corrupt_record STRING", "")).coalesce(1)
    path = str(tmp_path / "lines")
    sk.write_labelme(docs, path)
    back = rd.read_labelme(spark, path, "lines").drop("_corrupt_record")
    assert sorted(back.collect(), key=str) == sorted(docs.collect(), key=str)
    size = sum(os.path.getsize(f) for f in glob.glob(path + "/part-*"))
    assert size < 0.3 * sum(len(r.value) for r in spark.read.text(path).collect())
