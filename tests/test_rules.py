from fixtures import inbox_frame
from pyspark.sql import functions as F

from studyflow import tables as T
from studyflow.operators.rules import ERROR, run_counts, split, raw_json, to_rejects
from studyflow.plans import activity as AC
from studyflow.plans import learners as L
from studyflow.plans import topics as TP
from studyflow.sources import reference
from studyflow.sources.reference import empty_table


def reasons(df):
    return [r[ERROR] for r in df.orderBy("source_row_number").collect()]


def test_topic_rules_name_the_first_failure_and_lose_no_row(spark):
    good = ["D01_T01", "DOMAIN_01", "Name", "Text", "beginner", "2", "1"]

    def but(**change):
        return [change.get(c, v) for c, v in zip(T.TOPIC_INBOX, good, strict=True)]

    cases = [
        (good, None),
        (but(topic_id=" D01_T01 "), None),
        (but(topic_id=None), TP.BAD_TOPIC_ID),
        (but(topic_id="D1_T1", domain_id="x"), TP.BAD_TOPIC_ID),
        (but(topic_id="D01_T01\n"), TP.BAD_TOPIC_ID),
        (but(domain_id="DOMAIN_1"), TP.BAD_DOMAIN_ID),
        (but(domain_id="DOMAIN_99", estimated_hours="-2"), TP.UNKNOWN_DOMAIN),
        (but(topic_name=" "), TP.NAME_REQUIRED),
        (but(difficulty_level="EXPERT"), TP.BAD_DIFFICULTY),
        (but(difficulty_level=None), TP.BAD_DIFFICULTY),
        (but(estimated_hours="abc"), TP.BAD_HOURS),
        (but(estimated_hours=None), TP.BAD_HOURS),
        (but(estimated_hours="0.04"), TP.BAD_HOURS),
        (but(estimated_hours="0.05"), None),
        (but(estimated_hours="12345.6"), TP.BAD_HOURS),
        (but(topic_order="0"), TP.BAD_ORDER),
        (but(topic_order="x"), TP.BAD_ORDER),
        (but(topic_order="0.5"), None),
    ]
    df = inbox_frame(spark, T.TOPIC_INBOX, [c[0] for c in cases])
    checked = TP.validate_topics(df, reference.domains(spark))
    assert reasons(checked) == [c[1] for c in cases]
    valid, rejected = split(checked)
    assert valid.count() + rejected.count() == len(cases)


def test_newest_topic_version_wins_and_counts_once(spark):
    rows = [
        ["D01_T01", "DOMAIN_01", f"Name {n}", None, "ADVANCED", "2.25", "1"] for n in range(3)
    ]
    df = inbox_frame(spark, T.TOPIC_INBOX, rows).withColumn(
        "ingested_at", F.lit("2026-01-01").cast("timestamp_ntz")
    )
    now = F.lit("2026-01-02").cast("timestamp_ntz")
    run = TP.process_topics(df, reference.domains(spark), empty_table(spark, T.TOPIC_SCHEMA), now)
    (topic,) = run.topics.collect()
    assert (topic.topic_name, str(topic.estimated_hours)) == ("Name 2", "2.3")
    assert run.counts.collect()[0].asDict() == {
        "records_received": 3, "records_accepted": 1, "records_rejected": 0,
    }


def learner(**change):
    base = dict(
        zip(T.LEARNER_INBOX, ["S1", "E1", "Name", "a@b.c", "Dept", "1"], strict=True)
    )
    return [(base | change)[c] for c in T.LEARNER_INBOX]


def test_learner_rules_and_band_edges(spark):
    cases = [
        (learner(source_record_id=" "), L.SOURCE_ID_REQUIRED),
        (learner(source_record_id="a", employee_id=None, email="x"), L.EMPLOYEE_REQUIRED),
        (learner(source_record_id="b", learner_name=""), L.NAME_REQUIRED),
        (learner(source_record_id="c", email=None), L.EMAIL_REQUIRED),
        (learner(source_record_id="d", email="a@b"), L.BAD_EMAIL),
        (learner(source_record_id="e", snowflake_experience_years=""), L.EXPERIENCE_REQUIRED),
        (learner(source_record_id="f", snowflake_experience_years="abc"), L.EXPERIENCE_NOT_NUMERIC),
        (learner(source_record_id="g", snowflake_experience_years="-2"), L.EXPERIENCE_NEGATIVE),
        (learner(source_record_id="h", snowflake_experience_years="-0.04"), None),
        (learner(source_record_id="done"), L.ALREADY_PROCESSED),
        # every valid copy of a repeated id is refused, and an invalid copy counts
        (learner(source_record_id="twice"), L.DUPLICATE_SOURCE_ID),
        (learner(source_record_id="twice", email=None), L.EMAIL_REQUIRED),
        (learner(source_record_id="thrice"), L.DUPLICATE_SOURCE_ID),
        (learner(source_record_id="thrice"), L.DUPLICATE_SOURCE_ID),
    ]
    ledger = spark.createDataFrame(
        [(T.LEARNERS_PIPELINE, "done", None, "x"), (T.ACTIVITY_PIPELINE, "h", None, "x")],
        T.LEDGER_SCHEMA,
    )
    df = inbox_frame(spark, T.LEARNER_INBOX, [c[0] for c in cases])
    checked = L.validate_learners(df, ledger)
    assert reasons(checked) == [c[1] for c in cases]
    counts = run_counts(checked).collect()[0]
    assert counts.records_received == counts.records_accepted + counts.records_rejected == len(cases)

    bands = {
        "0": "FRESHER", "0.04": "FRESHER", "-0.04": "FRESHER", "0.05": "EXP_0_5", "0.1": "EXP_0_5",
        "5": "EXP_0_5", "5.1": "EXP_5_9", "9": "EXP_5_9", "9.1": "EXP_9_PLUS", "40": "EXP_9_PLUS",
    }
    years = spark.createDataFrame([(t,) for t in bands], "t string").select(
        "t", F.col("t").try_cast("decimal(4,1)").alias(L.YEARS)
    )
    ladder = {
        r.t: r.b for r in years.select("t", L.experience_band(F.col(L.YEARS)).alias("b")).collect()
    }
    ranged = {
        r.t: r.experience_level_code
        for r in L.band_by_range(years, reference.levels(spark)).collect()
    }
    assert ladder == ranged == bands


def test_rejected_rows_keep_their_nulls(spark):
    df = inbox_frame(spark, T.LEARNER_INBOX, [learner(email=None, department_name=None)])
    _, rejected = split(L.validate_learners(df, empty_table(spark, T.LEDGER_SCHEMA)))
    (r,) = to_rejects(
        rejected, T.LEARNERS_PIPELINE, "source_record_id", T.LEARNER_INBOX, F.lit("2026-01-01")
    ).withColumn("raw_record", raw_json(T.LEARNER_INBOX)).collect()
    assert r.raw_record == (
        '{"SOURCE_RECORD_ID":"S1","EMPLOYEE_ID":"E1","LEARNER_NAME":"Name","EMAIL":null,'
        '"DEPARTMENT_NAME":null,"SNOWFLAKE_EXPERIENCE_YEARS":"1"}'
    )
    assert r.resolved_flag is False and r.rejection_id.startswith("REJ_")


def test_activity_row_rules(spark):
    good = ["A", "E", "D01_T01", "studied", "30", "10", "2026-01-01 10:00:00", None]

    def but(**change):
        return [change.get(c, v) for c, v in zip(T.ACTIVITY_INBOX, good, strict=True)]

    cases = [
        (good, None),
        (but(activity_id=None), AC.ACTIVITY_ID_REQUIRED),
        (but(employee_id=" "), AC.EMPLOYEE_REQUIRED),
        (but(topic_id=None), AC.TOPIC_REQUIRED),
        (but(event_type=None), AC.TYPE_REQUIRED),
        (but(event_type="PROGRESS_UPDATED"), AC.BAD_TYPE),
        (but(duration_minutes=None), AC.DURATION_REQUIRED),
        (but(duration_minutes="ten"), AC.DURATION_NOT_NUMERIC),
        (but(duration_minutes="999999999"), AC.DURATION_TOO_LONG),
        (but(duration_minutes="-1"), AC.DURATION_NEGATIVE),
        (but(duration_minutes="30.5"), None),
        (but(completion_percent=""), AC.PERCENT_REQUIRED),
        (but(completion_percent="x"), AC.PERCENT_NOT_NUMERIC),
        (but(completion_percent="100.01"), AC.PERCENT_RANGE),
        (but(completion_percent="100.004"), None),
        (but(completion_percent="-1"), AC.PERCENT_RANGE),
        (but(activity_timestamp=None), AC.TIMESTAMP_REQUIRED),
        (but(activity_timestamp="2026"), AC.TIMESTAMP_INVALID),
        (but(activity_timestamp="2026-13-24"), AC.TIMESTAMP_INVALID),
        (but(activity_timestamp="2026-01-24"), None),
    ]
    df = AC.normalize_activity(inbox_frame(spark, T.ACTIVITY_INBOX, [c[0] for c in cases]))
    got = reasons(df.withColumn(ERROR, AC.first_failure(AC.activity_rules())))
    assert got == [c[1] for c in cases]
    strict = reasons(df.withColumn(ERROR, AC.first_failure(AC.activity_rules(strict=True))))
    assert strict[10] == AC.DURATION_NOT_WHOLE
    assert [s for n, s in enumerate(strict) if n != 10] == [g for n, g in enumerate(got) if n != 10]


def test_direct_recording_forces_completed_to_100(spark):
    calls = spark.createDataFrame(
        [
            (1, "e", "t", " completed ", None, 3, None),
            (2, "e", "t", "progress_updated", 5, None, None),
            (3, "e", "x", "STUDIED", 5, 5, None),
            (4, "e", "t", "LOOKED", 5, 5, None),
            (5, "e", "t", "STUDIED", -1, 5, None),
            (6, "e", "t", "STUDIED", 1, 101, None),
            (7, "e", "t", "COMPLETED", 1, 300, None),
            (8, "e", "t", None, 1, 3, None),
        ],
        "call_id int, enrollment_id string, topic_id string, event_type string, "
        "duration_minutes int, completion_percent int, notes string",
    )
    progress = spark.createDataFrame([("e", "t")], "enrollment_id string, topic_id string")
    checked = AC.validate_direct(calls, progress, ["call_id"])
    got = {r.call_id: r[ERROR] for r in checked.collect()}
    assert got == {
        1: None, 2: None, 3: AC.DIRECT_NOT_ASSIGNED, 4: AC.DIRECT_BAD_TYPE,
        5: AC.DIRECT_NEGATIVE, 6: AC.DIRECT_RANGE, 7: None, 8: AC.DIRECT_BAD_TYPE,
    }
    events = AC.record_activity(checked, AC.new_event_id(), F.lit("2026-01-01"))
    assert sorted((int(r.duration_minutes), int(r.completion_percent)) for r in events.collect()) == [
        (0, 100), (1, 100), (5, 0),
    ]


def test_registration_checks_and_last_row_wins(spark):
    rows = [
        ["s1", "emp1", "Old", "o@b.c", "A", "0"],
        ["s2", "EMP1", "New", "n@b.c", "B", "7"],
    ]
    # The row number decides, whatever the file is called.
    df = L.typed_learners(inbox_frame(spark, T.LEARNER_INBOX, rows)).withColumn(
        "source_file_name", F.concat(F.lit("file"), 3 - F.col("source_row_number"))
    )
    placed = L.placed(df, reference.paths(spark), F.lit("2026-01-01").cast("date"))
    (last,) = L.last_per_learner(placed).collect()
    assert (last.employee_id, last.learner_name, last.path_id) == ("emp1", "New", "PATH_5_9")
    assert str(last.target_completion_date) == "2026-02-26"
    assert str(last.target_exam_date) == "2026-03-05"
    plan = spark.createDataFrame(
        [("PATH_FRESHER", "t1", True), ("PATH_5_9", "t2", True), ("PATH_5_9", "t3", False)],
        "path_id string, topic_id string, required_flag boolean",
    )
    pairs = L.first_topics(placed, plan, F.lit("2026-01-01")).select("topic_id").collect()
    assert sorted(r.topic_id for r in pairs) == ["t1", "t2"]
    key = spark.range(1).select(L.learner_key(F.lit(" emp_demo_001 ")).alias("k")).first().k
    assert key == "LRN_297ab715c8309abe2429"
