"""The one-pass fold equals applying the literal fold batch after batch."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from studyflow import tables as T
from studyflow.plans import progress as P

COLUMNS = [
    "enrollment_id", "topic_id", "progress_status", "completion_percent", "hours_spent",
    "started_at", "completed_at", "last_activity_at",
]
START = datetime(2026, 1, 1)


def replay(events, batches, initial):
    """The rules for one (enrollment, topic) after another, in plain Python."""
    state = {k: dict(v) for k, v in initial.items()}
    for b in batches:
        groups = {}
        for e in events:
            if e["batch"] == b:
                groups.setdefault((e["enrollment_id"], e["topic_id"]), []).append(e)
        for key, group in groups.items():
            minutes = sum(e["minutes"] or 0 for e in group)
            percent = max(e["percent"] or Decimal(0) for e in group)
            first, last = min(e["at"] for e in group), max(e["at"] for e in group)
            s = state.setdefault(
                key,
                {"status": "NOT_STARTED", "percent": Decimal(0), "hours": Decimal(0),
                 "started": None, "completed": None, "last": None},
            )
            added = (Decimal(minutes) / 60).quantize(Decimal("0.01"), "ROUND_HALF_UP")
            s["hours"] += added
            s["percent"] = max(s["percent"], percent)
            if s["percent"] >= 100:
                s["status"] = "COMPLETED"
                s["completed"] = s["completed"] or last
            elif s["percent"] > 0 or minutes > 0:
                s["status"] = "IN_PROGRESS"
            s["started"] = s["started"] or first
            s["last"] = last
    return state


def make_events(rng, n):
    return [
        {
            "enrollment_id": f"e{rng.randrange(4)}",
            "topic_id": f"t{rng.randrange(3)}",
            "minutes": rng.choice([None, 0, 1, 20, 20, 20, 45, 61]),
            "percent": rng.choice([None, Decimal(0), Decimal("12.50"), Decimal(99), Decimal(100)]),
            "at": START + timedelta(minutes=rng.randrange(5000)),
            "batch": rng.randrange(4),
        }
        for _ in range(n)
    ]


def event_frame(spark, events):
    rows = [
        (f"v{i}", e["enrollment_id"], e["topic_id"], "STUDIED", e["at"],
         None if e["minutes"] is None else Decimal(e["minutes"]), e["percent"], None, None, None,
         e["batch"])
        for i, e in enumerate(events)
    ]
    return spark.createDataFrame(rows, f"{T.EVENT_SCHEMA}, batch int")


def as_state(df):
    return {
        (r.enrollment_id, r.topic_id): {
            "status": r.progress_status, "percent": r.completion_percent, "hours": r.hours_spent,
            "started": r.started_at, "completed": r.completed_at, "last": r.last_activity_at,
        }
        for r in df.collect()
    }


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_replay(spark, seed):
    rng = random.Random(seed)
    events = make_events(rng, 60)
    initial = {
        ("e0", "t0"): {"status": "NOT_STARTED", "percent": Decimal(0), "hours": Decimal(0),
                       "started": None, "completed": None, "last": None},
        ("e1", "t1"): {"status": "COMPLETED", "percent": Decimal(100), "hours": Decimal("3.33"),
                       "started": START, "completed": START, "last": START},
        ("e2", "t2"): {"status": "COMPLETED", "percent": Decimal(100), "hours": Decimal("1.00"),
                       "started": None, "completed": None, "last": None},
        ("quiet", "t0"): {"status": "IN_PROGRESS", "percent": Decimal(0), "hours": Decimal("0.50"),
                          "started": START, "completed": None, "last": START},
    }
    state = spark.createDataFrame(
        [(*k, v["status"], v["percent"], v["hours"], v["started"], v["completed"], v["last"], START)
         for k, v in initial.items()],
        T.PROGRESS_SCHEMA,
    )
    df = event_frame(spark, events)
    now = F.lit("2026-02-01").cast("timestamp_ntz")

    expected = replay(events, range(4), initial)
    assert as_state(P.progress_fold(df, "batch", state)) == expected
    if seed == 0:
        step = state
        for b in range(4):
            step = P.fold_progress(step, df.filter(F.col("batch") == b), now)
        assert as_state(step) == expected
        assert {f.name: f.dataType for f in step.schema} == {f.name: f.dataType for f in state.schema}
    (said,) = P.fold_result(P.rollup(df)).collect()
    keys = {(e["enrollment_id"], e["topic_id"]) for e in events}
    assert said.run_result.endswith(f"affected: {len(keys)}")
    assert as_state(P.progress_fold(df, "batch")) == replay(events, range(4), {})


def test_hours_are_rounded_per_batch(spark):
    twenty = [
        {"enrollment_id": "e", "topic_id": "t", "minutes": 20, "percent": None,
         "at": START + timedelta(hours=n), "batch": n}
        for n in range(3)
    ]
    (apart,) = P.progress_fold(event_frame(spark, twenty), "batch").collect()
    together = [e | {"batch": 0} for e in twenty]
    (once,) = P.progress_fold(event_frame(spark, together), "batch").collect()
    assert (str(apart.hours_spent), str(once.hours_spent)) == ("0.99", "1.00")
