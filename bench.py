"""Headline queries over one data folder; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (optional
comma list). Every query is run to the end into the no-op sink, so all columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from vigilbus.queries import load_all  # noqa: E402
from vigilbus.session import build_session  # noqa: E402

HEADLINE = [
    "rate_alert_report", "f03_message_rate", "d02_state_assembly", "d03_location_asof",
    "d05_attack_interval_labels", "f02_signal_statistics", "b17_edge_feature_vector",
    "decode_frames_to_signals", "k10_modified_replay", "all_rules_report", "c11_risk_tiers",
    "b10_flatten_packet", "b14_vehicle_path", "e08_feature_stats", "b19_zscore_apply",
    "f08_sliding_windows", "f09_training_windows", "f12_latest_window", "e11_threshold_per_family",
    "e13_score_distribution", "e15_auroc", "e16_best_threshold", "h02_inject_labelled_anomalies",
    "e18_federated_average", "e20_layer_drift", "e27_privacy_ledger", "l09_dp_sgd_gradient",
    "l01_recurrent_scores", "l05_isolation_forest_items", "j01_stream_exact_rate",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "vigilbus-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
           "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("e03_peak_rate")  # starts the JVM side and loads classes
    times = {name: round(run(name), 3) for name in names}
    spark.stop()
    print(json.dumps({
        "metric": "total headline query time", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
