"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the headline list).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from turnwise.catalog import load_all  # noqa: E402
from turnwise.session import build_session  # noqa: E402

HEADLINE = (
    "session_structure", "session_structure_long", "session_linguistics_long", "session_timing",
    "session_feedback", "session_trajectory", "tutor_turn_labels", "move_distribution",
    "sliding_windows", "topic_relevance_topk", "topic_alignment", "topic_dialogue",
    "topic_time_share", "content_pool", "session_fold_assignment", "purged_training_rows",
    "model_fold_encodings", "objective_baseline_oof", "auc_by_fold",
    "experiments_by_objective_fold", "reliability", "slice_report", "shrinkage_grid",
    "blend_grid", "promotion_gate", "output_contract", "cumulative_units",
    "variance_decomposition", "gbt_oof",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": "20g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    seconds = {}
    for name in names:
        start = time.perf_counter()
        registry[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name:34s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
