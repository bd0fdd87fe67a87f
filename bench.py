"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rigtable import build_session, catalog  # noqa: E402

HEADLINE = [
    "robust_box_per_cloud",
    "A12_build_detections",
    "A16_scene_summary",
    "P13_cap_even",
    "T1_track",
    "W1_track_window",
    "J12_asof_pose",
    "T5_publish_stats",
    "M1_rasterize",
    "J10_mask_overlap",
    "A1_instance_counts",
    "A5_class_combos",
    "J9_promote",
    "U4_split_dataset",
    "M4_render_views",
    "M11_lift_captures",
    "A20_qc_report",
    "T2_perception_publish",
    "W3_stability",
    "O9_dedup_masks",
    "M8_mask_to_polygons",
    "M9_export_review",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    # One warm-up on a small query, so that start-up is not charged to the first one.
    queries["A16_scene_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
