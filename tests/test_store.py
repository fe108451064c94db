"""Append-only logs: repeats, filters, derived tables, concurrent queries, and batches that read only what they touch."""

import os
import random
import time
from datetime import timedelta

import fixtures as FX
import pytest
from fixtures import deliver, seeded_store
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from test_streams import Demo

from studyflow import tables as T
from studyflow.streaming import jobs


def progress_rows(spark, first, last):
    return spark.range(first, last).selectExpr(
        "concat('e', id) as enrollment_id", "'t' as topic_id", "'NOT_STARTED' as progress_status",
        "cast(0 as decimal(5,2)) as completion_percent", "cast(0 as decimal(7,2)) as hours_spent",
        *[f"cast(null as timestamp_ntz) as {c}" for c in
          ("started_at", "completed_at", "last_activity_at", "updated_at")],
    )


def test_a_batch_written_again_replaces_itself(spark, folder):
    store = seeded_store(spark, f"{folder}/store")
    store.append("topic_assignments", progress_rows(spark, 0, 100), "b1")
    store.append("topic_assignments", progress_rows(spark, 50, 120), "b2")
    for _ in range(2):
        store.append("topic_assignments", progress_rows(spark, 0, 100), "b1")
    assert store._read("topic_assignments").count() == 170
    assert store.read("topic_progress").count() == 120
    assert store.batches("topic_assignments") == ["b1", "b2"]


def test_newest_and_first_values(spark, folder):
    store = seeded_store(spark, f"{folder}/store")
    row = "'l1' as learner_id, '{e}' as employee_id, '{n}' as learner_name, null as email, null as department_name, " \
        "null as snowflake_experience_years, null as experience_level_code, null as joined_date, true as active_flag, " \
        "timestamp_ntz'{t}' as created_at, timestamp_ntz'{t}' as updated_at"
    for batch, e, n, t in (("b", "E1", "old", "2024-01-01"), ("c", "e1", "new", "2024-01-03"), ("a", "x1", "middle", "2024-01-02")):
        rows = spark.range(1).selectExpr(*row.format(e=e, n=n, t=t).split(", "))
        store.append("learners", rows, batch, F.lit(t).cast("timestamp_ntz"))
    one = store.read("learners").first()
    assert (one.employee_id, one.learner_name) == ("E1", "new")
    assert (str(one.created_at)[:10], str(one.updated_at)[:10]) == ("2024-01-01", "2024-01-03")


def test_counts_are_observed_while_a_batch_is_frozen(spark, folder):
    from studyflow.operators.rules import count_columns

    store = seeded_store(spark, f"{folder}/store")
    built = []

    def build():
        built.append(1)
        return spark.range(90).selectExpr("id", "if(id % 3 = 0, 'bad', null) as validation_error")

    rows, counts = store.freeze("x", "b1", build, count_columns())
    assert counts == {"records_received": 90, "records_accepted": 60, "records_rejected": 30}
    again, repeated = store.freeze("x", "b1", build, count_columns())
    assert built == [1] and repeated == counts and again.count() == rows.count() == 90
    store.release("x", "b1")
    store.freeze("x", "b1", build, count_columns())
    assert built == [1, 1]


def test_a_repaired_file_is_accepted_once(spark, folder):
    demo = Demo(spark, folder)
    with pytest.raises(StreamingQueryException):
        demo.learners("file", [*FX.LEARNERS, ["LRN_X", "EMP_X"]])
    demo.learners("file", FX.LEARNERS)
    assert [r[1] for r in demo.runs()] == ["FAILED", "SUCCESS"]
    assert demo.store.read("learners").count() == 2
    demo.learners()
    assert len(demo.runs()) == 2


def test_line_breaks_inside_quotes(spark, folder):
    demo = Demo(spark, folder)
    demo.learners("learners", FX.LEARNERS)
    inbox = f"{folder}/notes"
    os.makedirs(inbox)
    row = [*FX.ACTIVITY[0][:-1], '"two\nlines"']
    with open(f"{inbox}/a.csv", "w") as out:
        out.write(",".join(T.ACTIVITY_INBOX) + "\n" + ",".join(row) + "\n")
    jobs.run_activity_stream(
        spark, inbox, demo.store, f"{folder}/cp/notes", clock=demo.clock, multiline=True
    ).awaitTermination()
    assert demo.runs()[-1] == (T.ACTIVITY_PIPELINE, "SUCCESS", 1, 1, 0)
    assert demo.store.read("learning_events").first().notes == "two\nlines"


def test_a_new_checkpoint_counts_no_hour_again(spark, folder):
    demo = Demo(spark, folder)
    demo.learners("learners", FX.LEARNERS)
    demo.activity("progress", FX.ACTIVITY)
    before = demo.topic("EMP_DEMO_002")
    for name in ("other", "third"):
        jobs.run_progress_stream(
            spark, demo.store, f"{folder}/cp/{name}", clock=demo.clock
        ).awaitTermination()
    assert demo.topic("EMP_DEMO_002") == before == ("COMPLETED", "100.00", "1.25")


def opened(df):
    """Partition folders that rows of ``df`` are read from."""
    files = df.select(F.input_file_name().alias("f")).distinct().collect()
    return {os.path.dirname(r.f).split("/store/")[1] for r in files}


def ledger(spark, first, last, step=1):
    return spark.range(first, last, step).select(
        F.lit(T.ACTIVITY_PIPELINE).alias("pipeline_name"),
        F.concat(F.lit("A"), "id").alias("source_record_id"),
        F.lit(FX.CLOCK).cast("timestamp_ntz").alias("processed_at"),
        F.lit("x").alias("processing_result"),
    )


def ids_of(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "activity_id string")


def test_fresh_ids_open_no_file_of_the_ledger(spark, folder):
    store = seeded_store(spark, f"{folder}/store")
    for k in range(4):
        store.append("processed_records", ledger(spark, 1000 * k, 1000 * k + 1000), f"b{k}")
    assert opened(store.read_known("processed_records", ids_of(spark, "N1", "N2"))) == set()
    held = store.read_known("processed_records", ids_of(spark, "A7", "A9", "N1", None))
    assert {"batch=b0"} == {f.split("/")[1] for f in opened(held)}
    assert {"A7", "A9"} <= {r.source_record_id for r in held.collect()}
    # Every id is found again, and a batch can be left out.
    everyone = ledger(spark, 0, 4000).select("source_record_id")
    assert store.read_known("processed_records", everyone).count() == 4000
    assert store.read_known("processed_records", everyone, but="b2").count() == 3000
    assert store.read_known("learning_events", everyone).count() == 0


def test_false_positives_of_a_full_filter(spark, monkeypatch):
    """At four ids a word, one id in fifty at most seems to be there; every id that is there is found."""
    from studyflow.sources import filters

    monkeypatch.setattr(filters, "WORDS", 2500)
    inside = spark.range(10000).selectExpr("concat('A', id) as k", "'b' as batch", "0 as bucket")
    words = filters.filter_words(inside, "k").cache()
    assert words.count() <= 2500

    def found(prefix):
        asked = spark.range(10000).selectExpr(f"concat('{prefix}', id) as k").select(
            filters.id_word("k").alias("word_at"), filters.id_mask("k").alias("mask")
        )
        return asked.join(words, "word_at").where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")).count()

    assert found("A") == 10000
    assert found("N") < 200


def test_a_small_batch_opens_few_buckets(spark, folder):
    store = seeded_store(spark, f"{folder}/store")
    store.buckets = 16
    store.append("topic_assignments", progress_rows(spark, 0, 500), "b1")
    some = store.read_touched("topic_assignments", progress_rows(spark, 3, 4).select("enrollment_id"))
    assert len(opened(some)) == 1 and some.filter("enrollment_id = 'e3'").count() == 1
    scan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "bucket#" in scan.split("PartitionFilters: [")[1][:80]


def test_the_progress_stream_only_appends(spark, folder, monkeypatch):
    """Its handler reads event batches and nothing else; an event batch written again counts once."""
    demo = Demo(spark, folder)
    demo.learners("learners", FX.LEARNERS)
    demo.activity("progress", FX.ACTIVITY)
    store, read = demo.store, []
    real = store._read

    def watched(name, *args, **kwargs):
        read.append(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(store, "_read", watched)
    (batch,) = store.batches("learning_events")
    rows = spark.createDataFrame(real("learning_events", [batch]).drop("applied_at", "batch", "bucket").collect(), T.EVENT_SCHEMA)
    store.append("learning_events", rows, batch)
    read.clear()
    jobs.run_progress_stream(spark, store, f"{folder}/cp/chain/progress", clock=demo.clock).awaitTermination()
    assert set(read) == {"learning_events"}
    monkeypatch.undo()
    assert len(store.batches("progress_rollups")) == 2
    assert demo.topic("EMP_DEMO_002") == ("COMPLETED", "100.00", "1.25")


def test_the_chain_runs_both_queries_and_tells_failures(spark, folder):
    demo = Demo(spark, folder)
    demo.learners("learners", FX.LEARNERS)
    inbox = f"{folder}/activity"
    deliver(inbox, "one", T.ACTIVITY_INBOX, FX.ACTIVITY[:1])
    chain = jobs.start_chain(spark, inbox, demo.store, f"{folder}/cp/chain", demo.clock, "0 seconds", "0 seconds")
    try:
        chain.drain()
        assert demo.topic("EMP_DEMO_001") == ("IN_PROGRESS", "25.00", "0.50")
        deliver(inbox, "two", T.ACTIVITY_INBOX, FX.ACTIVITY[1:])
        chain.drain()
        assert demo.topic("EMP_DEMO_002") == ("COMPLETED", "100.00", "1.25")
        assert chain.activity.isActive and chain.progress.isActive
        deliver(inbox, "three", T.ACTIVITY_INBOX, [["short", "row"]])
        with pytest.raises(StreamingQueryException):
            chain.drain()
    finally:
        chain.stop()
    for _ in range(50):
        if chain.listener.failure:
            break
        time.sleep(0.1)
    assert chain.listener.failure and chain.listener.batches["activity"] >= 2 and chain.listener.rows["progress"] >= 2


def test_sums_equal_the_full_computation_and_follow_the_change(spark, folder):
    from studyflow.plans import deltas, views

    demo = Demo(spark, folder)
    store = demo.store
    as_of = F.lit(FX.CLOCK.date())
    demo.learners("learners", [[f"L{k}", f"E{k}", "N", "n@example.com", "Ops", str(k % 11)] for k in range(40)])
    now = F.lit(FX.CLOCK).cast("timestamp_ntz")

    def same():
        t = {n: store.read(n) for n in ("learners", "enrollments", "topic_progress", "path_topic_plan", "learning_paths", "study_topics", "exam_domains")}
        full = views.learner_progress(t["learners"], t["enrollments"], t["learning_paths"], t["path_topic_plan"], t["topic_progress"], as_of)
        by_domain = views.domain_progress(t["enrollments"], t["path_topic_plan"], t["study_topics"], t["exam_domains"], t["topic_progress"])
        for mine, theirs in ((deltas.learner_progress(store, as_of), full), (deltas.domain_progress(store), by_domain)):
            assert sorted(map(str, mine.collect())) == sorted(map(str, theirs.collect()))

    deltas.update_sums(store, "s1", now)
    same()
    enrolled = [r.enrollment_id for r in store.read("enrollments").collect()]
    for step in range(2):
        rng = random.Random(step)
        rows = [(f"b{step}", rng.choice(enrolled), f"D0{rng.randint(1, 3)}_T0{rng.randint(1, 5)}", rng.randint(0, 90), rng.choice([0, 40, 100]), FX.CLOCK, FX.CLOCK) for _ in range(30)]
        added = spark.createDataFrame(rows, "event_batch string, enrollment_id string, topic_id string, minutes long, new_percent int, first_activity_at timestamp_ntz, batch_last_at timestamp_ntz").dropDuplicates(["enrollment_id", "topic_id"])
        store.append("progress_rollups", added, f"r{step}", now)
        deltas.update_sums(store, f"s{step + 2}", now + F.expr(f"interval {step + 1} day"))
        same()
    one = spark.createDataFrame([("c", enrolled[0], "D01_T01", 5, 1, FX.CLOCK, FX.CLOCK)], "event_batch string, enrollment_id string, topic_id string, minutes long, new_percent int, first_activity_at timestamp_ntz, batch_last_at timestamp_ntz")
    store.append("progress_rollups", one, "r9", now)
    assert len(deltas.update_sums(store, "s9", now + F.expr("interval 9 day"))) == 1
    assert store.read_batches("progress_sums", ["s9"]).count() == 1
    assert deltas.update_sums(store, "s10", now) == []
    same()


def test_sums_fold_begun_topics_only(spark, folder, monkeypatch):
    from studyflow.plans import deltas, views

    demo = Demo(spark, folder)
    store, now = demo.store, F.lit(FX.CLOCK).cast("timestamp_ntz")
    demo.learners("learners", [[f"L{k}", f"E{k}", "N", "n@example.com", "Ops", str(k % 11)] for k in range(12)])
    fresh = store.read("topic_assignments").where("topic_id in ('D01_T01', 'D01_T02')")
    status = F.when(F.col("topic_id") == "D01_T01", "IN_PROGRESS").otherwise("COMPLETED")
    done = fresh.withColumns({"progress_status": status, "completion_percent": F.lit(40), "hours_spent": F.lit(2)})
    # A first assignment with progress counts, one after an untouched one does not.
    store.append("topic_assignments", done.where("topic_id = 'D01_T01'"), "before", now - F.expr("interval 9 day"))
    store.append("topic_assignments", done.where("topic_id = 'D01_T02'"), "after", now + F.expr("interval 9 day"))
    folded, fold = [], deltas.progress.from_logs

    def watched(assignments, rollups):
        folded.append({r.topic_id for r in assignments.collect()})
        return fold(assignments, rollups)

    monkeypatch.setattr(deltas.progress, "from_logs", watched)
    deltas.update_sums(store, "s1", now)
    monkeypatch.undo()
    assert folded == [{"D01_T01", "D01_T02"}]
    sums = ["enrollment_id", *deltas.SUMS]
    plan = views.plan_domains(store.read("path_topic_plan"), store.read("study_topics"), store.read("exam_domains"))
    full = views.progress_base(store.read("enrollments"), plan, store.read("topic_progress")).select(*sums)
    mine = sorted(map(str, deltas.base(store).select(*sums).collect()))
    assert mine == sorted(map(str, full.collect()))
    assert {r.percent for r in deltas.base(store).collect()} == {4000}


def test_learner_and_progress_streams_together(spark, folder):
    """Both add to topic progress; neither loses what the other wrote."""
    demo = Demo(spark, folder)
    demo.learners("learners", FX.LEARNERS)
    jobs.begin_progress_stream(demo.store, f"{folder}/cp/chain/progress")
    deliver(f"{folder}/activity", "a", T.ACTIVITY_INBOX, FX.ACTIVITY)
    jobs.run_activity_stream(
        spark, f"{folder}/activity", demo.store, f"{folder}/cp/chain/activity", clock=demo.clock
    ).awaitTermination()
    deliver(
        f"{folder}/learners", "more", T.LEARNER_INBOX,
        [[f"LRN_{k}", f"EMP_{k}", "N", "n@example.com", "Ops", "1"] for k in range(5)],
    )
    queries = [
        jobs.run_learner_stream(
            spark, f"{folder}/learners", demo.store, f"{folder}/cp/learners",
            clock=lambda: FX.CLOCK + timedelta(days=1),
        ),
        jobs.run_progress_stream(
            spark, demo.store, f"{folder}/cp/chain/progress", clock=lambda: FX.CLOCK + timedelta(days=1)
        ),
    ]
    for query in queries:
        query.awaitTermination()
    assert demo.store.read("topic_progress").count() == 7 * 31
    assert demo.topic("EMP_DEMO_002") == ("COMPLETED", "100.00", "1.25")
    assert len(demo.store.batches("progress_rollups")) == 1


def test_a_new_topic_reaches_plans_and_enrollments(spark, folder):
    demo = Demo(spark, folder)
    demo.learners("learners", FX.LEARNERS)
    row = ["D05_T06", "DOMAIN_05", "Added", "x", "BEGINNER", "2", "99"]
    deliver(f"{folder}/topics", "t", T.TOPIC_INBOX, [row])
    jobs.run_topic_stream(
        spark, f"{folder}/topics", demo.store, f"{folder}/cp/topics", clock=demo.clock
    ).awaitTermination()
    for _ in range(2):
        jobs.refresh_schedule(demo.store, "refresh-1", demo.clock)
    plan = demo.store.read("path_topic_plan")
    assert plan.filter("topic_id = 'D05_T06'").count() == 4 and plan.count() == 4 * 32
    held = demo.store.read("topic_progress")
    assert held.filter("topic_id = 'D05_T06'").count() == 2 and held.count() == 2 * 32


def test_direct_entry_counts_once(spark, folder):
    demo = Demo(spark, folder)
    calls = spark.createDataFrame(
        [("EMP_1", "One", "one@example.com", "Ops", 3, "calls", 1), ("EMP_2", "Two", None, "Ops", 1, "calls", 2)],
        "employee_id string, learner_name string, email string, department_name string, "
        "snowflake_experience_years int, source_file_name string, source_row_number long",
    ).withColumn("snowflake_experience_years", F.col("snowflake_experience_years").cast("decimal(4,1)"))
    for _ in range(2):
        answers = jobs.register_directly(demo.store, calls, "call-1", FX.CLOCK.date(), demo.clock)
    assert answers.filter("failure IS NULL").count() == 1 and answers.count() == 2
    assert demo.store.read("learners").count() == 1
    enrollment = demo.store.read("enrollments").first().enrollment_id
    done = spark.createDataFrame(
        [(enrollment, "D01_T01", "completed", 60, None, None, "calls", 1), (enrollment, "D09_T99", "started", 5, 1, None, "calls", 2)],
        "enrollment_id string, topic_id string, event_type string, duration_minutes int, "
        "completion_percent int, notes string, source_file_name string, source_row_number long",
    )
    jobs.begin_progress_stream(demo.store, f"{folder}/cp/direct")
    for _ in range(2):
        jobs.record_directly(demo.store, done, "record-1", demo.clock)
    assert demo.store.read("learning_events").count() == 1
    jobs.run_progress_stream(
        spark, demo.store, f"{folder}/cp/direct", clock=demo.clock
    ).awaitTermination()
    assert demo.topic("EMP_1") == ("COMPLETED", "100.00", "1.00")


def test_two_active_paths_of_a_level_fail(spark):
    from studyflow.plans import learners as L

    paths = spark.createDataFrame(
        [("A", "FRESHER", 12, True), ("B", "FRESHER", 10, True)],
        "path_id string, experience_level_code string, duration_weeks int, active_flag boolean",
    ).withColumn("certification_id", F.lit(T.CERTIFICATION_ID))
    rows = spark.createDataFrame([("FRESHER",)], "experience_level_code string")
    with pytest.raises(Exception, match="two active paths"):
        L.assign_path(rows, paths).collect()


def test_minutes_too_large_for_the_table_have_their_own_reason(spark):
    from studyflow.operators.rules import first_failure
    from studyflow.plans import activity as A

    base = dict(zip(T.ACTIVITY_INBOX, FX.ACTIVITY[0], strict=True))
    rows = [base | {"duration_minutes": m} for m in ("5999999", "6000000", "123456789", "x", "-1")]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], list(base))
    got = A.normalize_activity(frame).select("duration_minutes", first_failure(A.activity_rules()).alias("e"))
    assert {r[0]: r[1] for r in got.collect()} == {
        "5999999": None,
        "6000000": A.DURATION_TOO_LONG,
        "123456789": A.DURATION_TOO_LONG,
        "x": A.DURATION_NOT_NUMERIC,
        "-1": A.DURATION_NEGATIVE,
    }
