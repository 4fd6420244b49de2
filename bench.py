"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_ALL=1 times every query.
Each query runs once to warm up and then BENCH_RUNS times; the best run counts. Results go to the
no-op sink, so every row and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gustfront.catalog.load import registered  # noqa: E402
from gustfront.session import build_session  # noqa: E402

HEADLINE = [
    "p08_manifest_rows", "j01_nearest_station", "j02_warnings_without_confirmed_event", "j03_closest_scans", "j04_nearest_velocity_scan",
    "j10_palette_lookup", "j11_value_to_colour", "f01_convert_frames", "a01_grid_statistics", "a03_value_histogram", "a04_channel_error", "a05_masked_error",
    "a07_a08_grid_quality", "a09_colour_census", "a11_palette_match_rate", "a25_a26_ranking_metrics", "a27_precision_at_recall", "w01_leakage_safe_split",
    "w04_recent_send_of_type", "w08_health_transitions", "w11_capture_totals", "j12_h08_alert_score_annotation", "t03_t09_suppression_replay",
    "f02_model_tensors", "f03_h26_score_scans", "s01_report_scan", "s03_listing_scrape",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    available = registered()
    names = list(available) if os.environ.get("BENCH_ALL") else HEADLINE
    seconds: dict[str, float] = {}
    for name in names:
        best = float("inf")
        for attempt in range(runs + 1):
            t = time.perf_counter()
            available[name](spark, folder).write.format("noop").mode("overwrite").save()
            if attempt:
                best = min(best, time.perf_counter() - t)
        seconds[name] = round(best, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
