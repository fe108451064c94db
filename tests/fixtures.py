"""Small inputs with known outcomes."""

from __future__ import annotations

import csv
from datetime import datetime
from pathlib import Path

from studyflow import tables as T
from studyflow.plans import schedule
from studyflow.sources import reference
from studyflow.sources.store import Store

# Topics per domain and hours of every topic in order: 31 topics, 98 hours.
TOPICS_PER_DOMAIN = [7, 7, 6, 6, 5]
HOURS = [
    2, 3, 2, 4, 3, 3, 3, 4, 4, 4, 3, 3, 3, 4, 4, 3, 3, 4, 3, 3, 3, 4, 3, 4, 2, 3, 3, 3, 2, 3, 3,
]
CLOCK = datetime(2026, 9, 24, 12, 0, 0)


def topic_rows() -> list[list[str]]:
    rows, order = [], 0
    for domain, count in enumerate(TOPICS_PER_DOMAIN, start=1):
        for n in range(1, count + 1):
            rows.append(
                [
                    f"D{domain:02d}_T{n:02d}", f"DOMAIN_{domain:02d}", f"Topic {order + 1}",
                    "About the topic", "intermediate", str(HOURS[order]), str(order + 1),
                ]
            )
            order += 1
    return rows


LEARNERS = [
    ["LRN_REC_001", "EMP_DEMO_001", "First Learner", "First@Example.com", "Data Engineering", "0"],
    ["LRN_REC_002", "EMP_DEMO_002", "Second Learner", "second@example.com", "Analytics", "3"],
]
BAD_LEARNER = [
    ["LRN_BAD_001", "EMP_DEMO_003", "Third Learner", "third@example.com", "Data Engineering", "-2"],
]
CORRECTED_LEARNER = [[*BAD_LEARNER[0][:5], "2"]]
ACTIVITY = [
    ["ACT_DEMO_001", "EMP_DEMO_001", "D01_T01", "STARTED", "30", "25", "2026-09-24 09:00:00", "a"],
    ["ACT_DEMO_002", "EMP_DEMO_002", "D01_T01", "COMPLETED", "75", "100", "2026-09-24 10:00:00", "b"],
]
BAD_ACTIVITY = [
    ["ACT_BAD_001", "EMP_DEMO_001", "D01_T01", "COMPLETED", "30", "150", "2026-09-24 11:00:00", "c"],
]
CORRECTED_ACTIVITY = [[*BAD_ACTIVITY[0][:5], "100", *BAD_ACTIVITY[0][6:]]]


def deliver(folder: str, name: str, columns: list[str], rows: list[list[str]]) -> str:
    """Put a CSV file into an inbox folder."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    with open(f"{folder}/{name}.csv", "w", newline="") as f:
        writer = csv.writer(f)
        writer.writerow([c.upper() for c in columns])
        writer.writerows(rows)
    return folder


def inbox_frame(spark, columns: list[str], rows: list[list[str | None]]):
    """Rows as a numbered inbox batch."""
    schema = ", ".join(f"{c} string" for c in columns)
    numbered = [(*row, "file.csv", n) for n, row in enumerate(rows, start=1)]
    return spark.createDataFrame(
        numbered, f"{schema}, source_file_name string, source_row_number bigint"
    )


def topic_table(spark):
    rows = [(*r[:4], r[4].upper(), r[5], r[6], True, CLOCK, CLOCK) for r in topic_rows()]
    return reference.inline_table(spark, rows, T.TOPIC_SCHEMA)


def seeded_store(spark, root: str) -> Store:
    """Domains, paths, topics and plan in place; nobody registered."""
    store = Store(spark, root, buckets=4)
    store.load("exam_domains", reference.domains(spark))
    store.load("learning_paths", reference.paths(spark))
    store.load("study_topics", topic_table(spark))
    plan = schedule.build_schedule(topic_table(spark), reference.paths(spark))
    target = reference.empty_table(spark, T.PLAN_SCHEMA)
    from pyspark.sql import functions as F

    store.load(
        "path_topic_plan",
        schedule.upsert_plan(target, plan, F.lit("2026-09-24 12:00:00").cast("timestamp_ntz")),
    )
    return store
