"""Times the headline queries once each and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from trialweave.plans import catalog, workspace  # noqa: E402
from trialweave.session import build_session  # noqa: E402

HEADLINE = [
    "after_study_analysis",
    "after_study_analysis_orders",
    "after_study_analysis_with_state",
    "decision_log_from_orders",
    "update_rows",
    "recomputed_update_probabilities",
    "stack_mean",
    "joint_bread_inverse",
    "joint_meat",
    "adjusted_variance",
    "theta_only_adjusted_variance",
    "study_summary",
    "time_statistics",
    "log_checks",
    "input_checks",
    "update_weights",
    "premature_estimates",
    "study_features",
    "update_verdicts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    # One small run starts the JVM and the Python workers.
    catalog.QUERIES["after_study_analysis"](spark, "/root/testdata/sf0.001").collect()
    workspace.forget()
    times = {}
    for name in HEADLINE:
        workspace.forget()  # every query starts from the raw files
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": Path(sf_dir).name,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
