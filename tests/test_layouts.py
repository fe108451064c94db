"""Range joins by bins, tables laid out by a key, load history by content, rejected rows as variants."""

import random
from functools import partial

import fixtures as FX
from fixtures import deliver, inbox_frame, seeded_store
from pyspark.sql import functions as F

from studyflow import tables as T
from studyflow.operators.ranges import range_join
from studyflow.operators.rules import raw_field, raw_json, to_rejects
from studyflow.plans import activity as AC
from studyflow.sources.fingerprints import load_unseen
from studyflow.sources.layout import clustered


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_join_equals_a_nested_loop(spark):
    rng = random.Random(9)
    bands = []
    for k in range(3000):
        low = rng.randint(-5000, 9000)
        bands.append((k, low, low + rng.choice([0, 0, 3, 40, 700])))
    bands += [(3001, None, -4990), (3002, 8990, None), (3003, None, None), (3004, 5, 4)]
    points = [(k, rng.randint(-5100, 9100)) for k in range(300)] + [(999, None), (1000, -5000)]
    intervals = spark.createDataFrame(bands, "band int, low int, high int")
    joined = range_join(spark.createDataFrame(points, "point int, v int"), F.col("v"), intervals, F.col("low"), F.col("high"))
    got = sorted((r.point, r.band) for r in joined.collect())
    expected = sorted(
        (p, b) for p, v in points for b, low, high in bands
        if v is not None and (low is None or low <= v) and (high is None or v <= high)
    )
    assert got == expected
    plan = plan_of(joined)
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "_bin" in plan
    none = spark.createDataFrame([], "point int, v int")
    assert range_join(none, F.col("v"), intervals, F.col("low"), F.col("high")).count() == 0
    assert range_join(intervals, F.col("low"), intervals.limit(0).toDF("b", "l", "h"), F.col("l"), F.col("h")).count() == 0


def test_no_enrollment_is_moved_where_tables_are_laid_out(spark, folder):
    rows = [(f"L{k % 50}", f"E{k}", "ACTIVE", T.CERTIFICATION_ID, k) for k in range(400)]
    enrollments = spark.createDataFrame(
        rows, "learner_id string, enrollment_id string, enrollment_status string, certification_id string, n int"
    ).withColumn("created_at", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(n)"))
    learners = spark.range(50).selectExpr("concat('L', id) as learner_id", "concat('EMP', id) as employee_id")
    plain = AC.latest_enrollment(learners, enrollments)
    laid = AC.latest_enrollment(
        clustered(learners, "learner_id", 8, "learners"), clustered(enrollments, "learner_id", 8, "enrollments")
    )
    assert sorted(laid.collect()) == sorted(plain.collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(laid.select("*"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert "Exchange" in plan_of(plain)


def test_load_history_by_content(spark, folder):
    store = seeded_store(spark, f"{folder}/store")
    inbox = f"{folder}/inbox"
    now = F.lit(FX.CLOCK).cast("timestamp_ntz")

    def load(batch):
        rows = load_unseen(store, inbox, T.LEARNER_INBOX, batch, now)
        return sorted(r.source_record_id for r in rows.collect())

    def row(k):
        return [f"LRN_{k}", f"EMP_{k}", "N", "n@example.com", "Ops", "1"]

    deliver(inbox, "a", T.LEARNER_INBOX, [row(1), row(2)])
    assert load("r1") == ["LRN_1", "LRN_2"]
    assert load("r1") == ["LRN_1", "LRN_2"]
    # A copy under another name, its rows in another order, is not counted twice.
    deliver(inbox, "copy", T.LEARNER_INBOX, [row(2), row(1)])
    assert load("r2") == []
    # The same name with other content is.
    deliver(inbox, "a", T.LEARNER_INBOX, [row(1), row(3)])
    deliver(inbox, "twin", T.LEARNER_INBOX, [row(3), row(1)])
    assert load("r3") == ["LRN_1", "LRN_3"]
    assert load("r4") == []
    # A row twice is not the row once.
    deliver(inbox, "twice", T.LEARNER_INBOX, [row(1), row(2), row(2)])
    assert load("r5") == ["LRN_1", "LRN_2", "LRN_2"]


def test_rejected_rows_are_kept_as_variants(spark, folder):
    store = seeded_store(spark, f"{folder}/store")
    rows = inbox_frame(spark, T.LEARNER_INBOX, [["L1", "E1", None, 'a"b', "", "x"], ["L2", None, "N", None, None, None]])
    rejects = partial(to_rejects, rows.withColumn("validation_error", F.lit("bad")), T.LEARNERS_PIPELINE)
    store.append("rejected_records", rejects("source_record_id", T.LEARNER_INBOX, F.lit(FX.CLOCK)), "b1")
    kept = store.read("rejected_records")
    assert kept.schema["raw_record"].dataType.simpleString() == "variant"
    (one,) = kept.where(raw_field("employee_id") == "E1").select("source_record_id", raw_json(T.LEARNER_INBOX).alias("j")).collect()
    assert one.source_record_id == "L1"
    assert one.j == '{"SOURCE_RECORD_ID":"L1","EMPLOYEE_ID":"E1","LEARNER_NAME":null,"EMAIL":"a\\"b","DEPARTMENT_NAME":"","SNOWFLAKE_EXPERIENCE_YEARS":"x"}'
