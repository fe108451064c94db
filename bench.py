"""Time the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line.

Every query runs in full (its result goes to a sink that discards rows) and builds all its inputs
from the star-schema tables; nothing is carried from one query to the next. One untimed query warms
up the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

from studyflow.catalog import QUERIES
from studyflow.session import local_session

HEADLINE = [
    "weekly_study_plan",
    "validate_topics",
    "validate_learners",
    "validate_activity",
    "in_duplicate_keys",
    "resolve_active_enrollment",
    "latest_assessment",
    "activity_rollup",
    "progress_fold",
    "upsert_accumulate",
    "process_learners",
    "process_activity",
    "process_events",
    "learner_progress",
    "domain_progress",
    "progress_reports",
    "quality_report",
    "stream_learners",
    "stream_chain",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("weekly_study_plan")
    times = {name: run(name) for name in sys.argv[1:] or HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
