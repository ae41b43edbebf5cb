"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose input and cores.
Every query is run once to warm up the JVM on a short list and then timed with a sink that
reads all rows and keeps none.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from palimpsest.plans.catalog import QUERIES  # noqa: E402
from palimpsest.session import build_session  # noqa: E402

HEADLINE = (
    "repeated_text", "fragments", "repeated_objects", "candidate_union", "invariance", "size_guard",
    "overlap_join", "spatial_anti", "greedy_match", "confirm_gate", "region_status",
    "mask_score", "mask_algebra", "coverage_area", "merge_intervals",
    "photo_routes", "texture_p90", "periodicity", "recon_metrics",
    "prf_rollup", "pair_audit", "workflow_median", "ack_algebra", "task_report", "artifact_order",
    "page_status", "top_media", "package_limits", "sequence_match", "task_state", "session_window",
)
WARM_UP = ("fragments", "overlap_join", "mask_score", "photo_routes", "page_status", "task_report", "workflow_median")


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    for name in WARM_UP:
        run(spark, name, folder)
    times = {name: round(run(spark, name, folder), 3) for name in names}
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
