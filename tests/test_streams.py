"""Demo files through the streams, repeated and failing batches included."""

from datetime import timedelta

import fixtures as FX
import pytest
from fixtures import deliver, seeded_store
from pyspark.errors import StreamingQueryException

from studyflow import tables as T
from studyflow.plans import audit as AU
from studyflow.plans import checks as C
from studyflow.streaming import jobs


class Demo:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        self.store = seeded_store(spark, f"{folder}/store")
        self.ticks = 0

    def clock(self):
        self.ticks += 1
        return FX.CLOCK + timedelta(minutes=self.ticks)

    def learners(self, name=None, rows=()):
        inbox = f"{self.folder}/learners"
        if name:
            deliver(inbox, name, T.LEARNER_INBOX, rows)
        jobs.run_learner_stream(
            self.spark, inbox, self.store, f"{self.folder}/cp/learners", clock=self.clock
        ).awaitTermination()

    def activity(self, name=None, rows=()):
        inbox = f"{self.folder}/activity"
        if name:
            deliver(inbox, name, T.ACTIVITY_INBOX, rows)
        jobs.run_chain(
            self.spark, inbox, self.store, f"{self.folder}/cp/chain", clock=self.clock
        )

    def topic(self, employee, topic="D01_T01"):
        rows = (
            self.store.read("learners").filter(f"employee_id = '{employee}'")
            .join(self.store.read("enrollments").select("learner_id", "enrollment_id"), "learner_id")
            .join(self.store.read("topic_progress").filter(f"topic_id = '{topic}'"), "enrollment_id")
            .collect()
        )
        (r,) = rows
        return r.progress_status, str(r.completion_percent), str(r.hours_spent)

    def runs(self):
        log = self.store.read("pipeline_run_log").orderBy("started_at").collect()
        return [
            (r.pipeline_name, r.run_status, r.records_received, r.records_accepted, r.records_rejected)
            for r in log
        ]


def test_demo_story(spark, folder):
    demo = Demo(spark, folder)
    demo.learners("learners", FX.LEARNERS)
    assert demo.runs() == [(T.LEARNERS_PIPELINE, "SUCCESS", 2, 2, 0)]
    demo.activity("progress", FX.ACTIVITY)
    assert demo.topic("EMP_DEMO_001") == ("IN_PROGRESS", "25.00", "0.50")
    assert demo.topic("EMP_DEMO_002") == ("COMPLETED", "100.00", "1.25")

    demo.learners("bad", FX.BAD_LEARNER)
    demo.learners("corrected", FX.CORRECTED_LEARNER)
    demo.activity("bad", FX.BAD_ACTIVITY)
    demo.activity("corrected", FX.CORRECTED_ACTIVITY)
    assert demo.topic("EMP_DEMO_001") == ("COMPLETED", "100.00", "1.00")

    # Nothing new: nothing runs, nothing changes.
    before = demo.runs()
    demo.learners()
    demo.activity()
    assert demo.runs() == before
    assert demo.topic("EMP_DEMO_001") == ("COMPLETED", "100.00", "1.00")

    store = demo.store
    rejects = store.read("rejected_records")
    assert [r.resolved_flag for r in rejects.collect()] == [True, True]
    reasons = {r.source_record_id: r.rejection_reason for r in rejects.collect()}
    assert reasons == {
        "LRN_BAD_001": "Snowflake experience must be zero or greater.",
        "ACT_BAD_001": "Completion percentage must be between 0 and 100.",
    }
    paths = [("EMP_DEMO_001", "PATH_FRESHER"), ("EMP_DEMO_002", "PATH_0_5"), ("EMP_DEMO_003", "PATH_0_5")]

    def ids(*names):
        return spark.createDataFrame([(n,) for n in names], "source_record_id string")

    report = C.acceptance_report(
        {
            "learners": store.read("learners"),
            "enrollments": store.read("enrollments"),
            "progress": store.read("topic_progress"),
            "ledger": store.read("processed_records"),
            "rejects": rejects,
            "events": store.read("learning_events"),
        },
        spark.createDataFrame(paths, "employee_id string, path_id string"),
        ids("LRN_REC_001", "LRN_REC_002", "LRN_BAD_001"),
        ids("ACT_DEMO_001", "ACT_DEMO_002", "ACT_BAD_001"),
        ids("LRN_BAD_001", "ACT_BAD_001"),
        [
            ("EMP_DEMO_001", "D01_T01", "COMPLETED", "100", "1.00", "first learner"),
            ("EMP_DEMO_002", "D01_T01", "COMPLETED", "100", "1.25", "second learner"),
        ],
    ).collect()
    assert [r.test_status for r in report] == ["PASS"] * 12
    assert report[3].actual_result == "3 learners with 31 topics"

    quality = C.quality_report(
        {
            "domains": store.read("exam_domains"),
            "paths": store.read("learning_paths"),
            "plan": store.read("path_topic_plan"),
            "topics": store.read("study_topics"),
            "progress": store.read("topic_progress"),
            "enrollments": store.read("enrollments"),
            "learners": store.read("learners"),
            "assessments": store.read("assessment_results"),
        }
    ).collect()
    assert [r.test_status for r in quality] == ["PASS"] * 12

    # A learner and an activity that arrive later reach progress through the three streams.
    demo.learners("task", [["LRN_TASK_001", "EMP_TASK_001", "Fourth", "d@example.com", "Ops", "6"]])
    demo.activity(
        "task",
        [["ACT_TASK_001", "EMP_TASK_001", "D01_T02", "STARTED", "20", "10", "2026-09-24 12:00:00", ""]],
    )
    assert demo.topic("EMP_TASK_001", "D01_T02") == ("IN_PROGRESS", "10.00", "0.33")


def test_both_rows_of_one_learner(spark, folder):
    """Had both activities belonged to the first learner, hours would add up on one topic."""
    demo = Demo(spark, folder)
    demo.learners("learners", FX.LEARNERS)
    mine = [[r[0], "EMP_DEMO_001", *r[2:]] for r in FX.ACTIVITY]
    demo.activity("progress", mine)
    demo.activity("corrected", FX.CORRECTED_ACTIVITY)
    assert demo.topic("EMP_DEMO_001") == ("COMPLETED", "100.00", "2.25")
    assert demo.topic("EMP_DEMO_002") == ("NOT_STARTED", "0.00", "0.00")


def test_repeated_batches_have_no_effect(spark, folder):
    """A new checkpoint delivers every row again; a batch repeated by its own query is skipped."""
    demo = Demo(spark, folder)
    demo.learners("learners", FX.LEARNERS)
    demo.activity("progress", FX.ACTIVITY)
    again = {"clock": demo.clock}
    jobs.run_activity_stream(
        spark, f"{folder}/activity", demo.store, f"{folder}/cp/new", **again
    ).awaitTermination()
    assert demo.runs()[-1] == (T.ACTIVITY_PIPELINE, "SUCCESS", 2, 0, 2)
    reasons = {r.rejection_reason for r in demo.store.read("rejected_records").collect()}
    assert reasons == {"Activity has already been processed successfully."}
    demo.activity()
    assert demo.topic("EMP_DEMO_001") == ("IN_PROGRESS", "25.00", "0.50")

    store, events = demo.store, demo.store.read("learning_events")
    for _ in range(2):
        store.append("learning_events", events, "batch-1")
    assert store.read("learning_events").count() == 4


def test_failed_writes_are_repeated_without_double_counting(spark, folder, monkeypatch):
    """The job dies after the events were written; the repeated batch adds nothing twice."""
    demo = Demo(spark, folder)
    demo.learners("learners", FX.LEARNERS)
    deliver(f"{folder}/activity", "progress", T.ACTIVITY_INBOX, FX.ACTIVITY)
    real = demo.store.append

    def broken(name, df, batch, at=None):
        if name == "processed_records":
            raise RuntimeError("lost")
        real(name, df, batch, at)

    monkeypatch.setattr(demo.store, "append", broken)
    with pytest.raises(StreamingQueryException):
        demo.activity()
    assert demo.runs()[-1][:2] == (T.ACTIVITY_PIPELINE, "FAILED")
    monkeypatch.setattr(demo.store, "append", real)
    demo.activity()
    assert demo.runs()[-1] == (T.ACTIVITY_PIPELINE, "SUCCESS", 2, 2, 0)
    assert demo.store.read("learning_events").count() == 2
    assert demo.store.read("processed_records").count() == 4
    assert demo.topic("EMP_DEMO_002") == ("COMPLETED", "100.00", "1.25")


def test_malformed_file_is_refused_whole(spark, folder):
    demo = Demo(spark, folder)
    with pytest.raises(StreamingQueryException):
        demo.learners("short", [*FX.LEARNERS, ["LRN_X", "EMP_X"]])
    assert demo.store.read("learners").count() == 0
    (run,) = demo.runs()
    assert run[:2] == (T.LEARNERS_PIPELINE, "FAILED")


def test_topic_stream_updates_and_rejects(spark, folder):
    store = seeded_store(spark, f"{folder}/store")
    inbox = f"{folder}/topics"
    rows = FX.topic_rows()
    deliver(
        inbox, "t", T.TOPIC_INBOX,
        [
            [*rows[0][:2], "Renamed", *rows[0][3:]],
            ["D99_T01", "DOMAIN_99", "Invalid", "x", "BEGINNER", "-2", "999"],
        ],
    )
    jobs.run_topic_stream(spark, inbox, store, f"{folder}/cp").awaitTermination()
    topics = store.read("study_topics")
    assert topics.count() == 31
    assert topics.filter("topic_id = 'D01_T01'").first().topic_name == "Renamed"
    (reject,) = store.read("rejected_records").collect()
    assert reject.rejection_reason == "Domain does not exist in the approved domain list"
    run = AU.latest_run(store.read("pipeline_run_log"), T.TOPICS_PIPELINE).first()
    assert (run.records_received, run.records_accepted, run.records_rejected) == (2, 1, 1)


def test_re_registration_keeps_what_must_not_change(spark, folder):
    demo = Demo(spark, folder)
    demo.learners("one", FX.LEARNERS)
    demo.learners(
        "two", [["LRN_REC_003", "emp_demo_001", "New Name", "NEW@example.com", "Ops", "6"]]
    )
    learner = demo.store.read("learners").filter("employee_id = 'EMP_DEMO_001'").first()
    assert (learner.learner_name, learner.email) == ("New Name", "new@example.com")
    assert learner.experience_level_code == "EXP_5_9"
    assert learner.updated_at > learner.created_at
    assert demo.store.read("learners").count() == 2
    enrollment = demo.store.read("enrollments").filter(
        f"learner_id = '{learner.learner_id}'"
    ).first()
    assert (enrollment.path_id, enrollment.enrollment_status) == ("PATH_5_9", "ACTIVE")
    assert demo.store.read("topic_progress").count() == 62
