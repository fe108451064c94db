"""The domain's tables derived from the star-schema Parquet tables.

Values are spoiled by key so that every validation rule fires, keys repeat, and all four experience
bands occur. Every table is made from all rows of its input; ``people`` alone leaves out customers with
negative years, as registration would refuse them.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyflow import tables as T
from studyflow.functions.scalars import enrollment_key, learner_key
from studyflow.plans import learners as L
from studyflow.plans import progress as P
from studyflow.plans import schedule as S
from studyflow.plans import topics as TP
from studyflow.session import shared_dir
from studyflow.sources import reference

REGISTERED = date(2024, 1, 1)
AS_OF = date(2024, 2, 1)
NOW = datetime(2024, 1, 1)


def as_of() -> Column:
    return F.lit(AS_OF)


def registered() -> Column:
    return F.lit(REGISTERED)


def now() -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")


# Declared, so that opening a table reads no file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "customer": """c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,
        c_mktsegment string""",
    "part": """p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,
        p_retailprice double""",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,
        value double, props string""",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def every(n: int, rest: int, key: str = "k") -> Column:
    return F.expr(f"{key} % {n} = {rest}")


def text_null() -> Column:
    return F.lit(None).cast("string")


def paths(spark: SparkSession) -> DataFrame:
    return reference.paths(spark, NOW)


def levels(spark: SparkSession) -> DataFrame:
    return reference.levels(spark, NOW)


def domains(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").selectExpr(
        "concat('DOMAIN_0', r_regionkey + 1) as domain_id",
        f"'{T.CERTIFICATION_ID}' as certification_id",
        "r_name as domain_name",
        "cast(element_at(array(31, 21, 20, 18, 10), r_regionkey + 1) as decimal(5,2)) "
        "as exam_weight_percent",
        "cast(r_regionkey + 1 as decimal(2,0)) as domain_order",
        "r_name as description",
        "true as active_flag",
        "timestamp_ntz'2024-01-01' as created_at",
        "timestamp_ntz'2024-01-01' as updated_at",
    )


def topic_inbox(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of 35 topics delivered over time, one per part."""
    src = table(spark, sf, "part").selectExpr(
        "p_partkey as k", "p_name", "p_type", "p_brand", "p_size",
        "p_partkey % 6 + 1 as dom", "(p_partkey div 6) % 7 + 1 as num",
    )
    return src.select(
        F.when(every(23, 5), "X01_T01")
        .when(every(29, 3), "d01_t01")
        .otherwise(F.expr("concat('D0', dom, '_T0', num)"))
        .alias("topic_id"),
        F.when(every(31, 7), text_null())
        .when(every(37, 9), "DOMAIN_6")
        .otherwise(F.expr("concat('DOMAIN_0', dom)"))
        .alias("domain_id"),
        F.when(every(41, 11), "  ").otherwise(F.expr("concat(p_name, ' ', k)")).alias("topic_name"),
        F.expr("concat(p_type, ' ', p_brand)").alias("topic_description"),
        F.when(every(43, 13), "EXPERT")
        .otherwise(F.expr("element_at(array('Beginner', ' intermediate ', 'ADVANCED'), p_size % 3 + 1)"))
        .alias("difficulty_level"),
        F.when(every(47, 17), "abc")
        .when(every(53, 19), "-2")
        .when(every(59, 23), text_null())
        .otherwise(F.expr("concat(1 + p_size % 5, '.', p_size % 10)"))
        .alias("estimated_hours"),
        F.when(every(61, 29), "0")
        .when(every(67, 31), "x")
        .otherwise(F.expr("cast((dom - 1) * 7 + num as string)"))
        .alias("topic_order"),
        F.expr("concat('topics_', k % 3, '.csv')").alias("source_file_name"),
        F.col("k").alias("source_row_number"),
        F.expr(
            "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, cast(k div 10 as decimal(18,6)))"
        ).alias("ingested_at"),
    )


def validated_topics(spark: SparkSession, sf: str) -> DataFrame:
    return TP.validate_topics(topic_inbox(spark, sf), domains(spark, sf))


def start_query() -> None:
    """Forget the tables stored by the previous query."""
    _stored.clear()


_stored: dict[tuple[str, str], DataFrame] = {}


def stored(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table written to the shared folder, once per query however often it is used."""
    table = _stored.get((sf, name))
    if table is None:
        df, path = build(), f"{shared_dir(spark, name)}/table"
        df.write.parquet(path)
        table = _stored[sf, name] = spark.read.schema(df.schema).parquet(path)
    return table


def topics(spark: SparkSession, sf: str) -> DataFrame:
    """Topic table after one run over the whole inbox."""
    return stored(spark, sf, "topics", lambda: _topics(spark, sf))


def _topics(spark: SparkSession, sf: str) -> DataFrame:
    latest = TP.latest_topic_version(validated_topics(spark, sf).filter(F.col(TP.ERROR).isNull()))
    return latest.select(
        *latest.columns,
        F.lit(True).alias("active_flag"),
        now().alias("created_at"),
        now().alias("updated_at"),
    )


def plan(spark: SparkSession, sf: str) -> DataFrame:
    return stored(
        spark, sf, "plan", lambda: S.build_schedule(topics(spark, sf), paths(spark))
    )


CENTS = "cast(round(c_acctbal * 100) as bigint)"


def learner_inbox(spark: SparkSession, sf: str) -> DataFrame:
    src = table(spark, sf, "customer").selectExpr(
        "c_custkey as k", "c_name", "c_mktsegment", f"{CENTS} as cents"
    )
    years = F.expr(
        "concat(if(cents < 0, '-', ''), abs(cents) div 100000, '.', "
        "lpad(cast(abs(cents) div 1000 % 100 as string), 2, '0'))"
    )
    return src.select(
        F.when(every(101, 7), "")
        .when(every(89, 11), F.expr("concat('LRN-', k + 1)"))
        .otherwise(F.expr("concat('LRN-', k)"))
        .alias("source_record_id"),
        F.when(every(103, 9), text_null())
        .when(every(17, 3), F.expr("concat('emp-', k - 1)"))
        .otherwise(F.expr("concat('EMP-', k)"))
        .alias("employee_id"),
        F.when(every(107, 13), " ").otherwise(F.col("c_name")).alias("learner_name"),
        F.when(every(97, 21), "no-at-sign")
        .when(every(109, 23), text_null())
        .otherwise(F.expr("concat(' User', k, '@Example.com ')"))
        .alias("email"),
        F.col("c_mktsegment").alias("department_name"),
        F.when(every(113, 25), "abc")
        .when(every(127, 27), text_null())
        .otherwise(years)
        .alias("snowflake_experience_years"),
        F.expr("concat('learners_', k % 4, '.csv')").alias("source_file_name"),
        F.col("k").alias("source_row_number"),
    )


def learner_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Learner ids accepted before, one for each order; most of them never come again."""
    return (
        table(spark, sf, "orders")
        .selectExpr(
            f"'{T.LEARNERS_PIPELINE}' as pipeline_name",
            "concat('LRN-', o_orderkey * 13) as source_record_id",
            "timestamp_ntz'2023-12-31' as processed_at",
            "'accepted earlier' as processing_result",
        )
    )


def validated_learners(spark: SparkSession, sf: str) -> DataFrame:
    return L.validate_learners(learner_inbox(spark, sf), learner_ledger(spark, sf))


def placed_learners(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted inbox rows with level, path, keys and dates."""
    valid = validated_learners(spark, sf).filter(F.col(L.ERROR).isNull())
    return L.placed(L.typed_learners(valid), paths(spark), registered())


def people(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as registered learners, one row each; those with negative years are left out."""
    src = table(spark, sf, "customer").selectExpr(
        "c_custkey as k", "c_name", "c_mktsegment", "c_nationkey", f"{CENTS} as cents"
    )
    rows = src.filter("cents >= 0").select(
        F.expr("concat('EMP-', k)").alias("employee_id"),
        F.col("c_name").alias("learner_name"),
        F.expr("concat('user', k, '@example.com')").alias("email"),
        F.col("c_mktsegment").alias("department_name"),
        F.expr("cast(cast(cents div 10000 as decimal(18,0)) * 0.1BD as decimal(4,1))").alias(
            "snowflake_experience_years"
        ),
        F.col("c_nationkey"),
    )
    return L.placed(rows, paths(spark), registered())


def learners(spark: SparkSession, sf: str) -> DataFrame:
    return people(spark, sf).select(
        "learner_id", "employee_id", "learner_name", "email", "department_name",
        "snowflake_experience_years", "experience_level_code",
        registered().alias("joined_date"),
        F.lit(True).alias("active_flag"),
        now().alias("created_at"),
        now().alias("updated_at"),
    )


def enrollments(spark: SparkSession, sf: str) -> DataFrame:
    """One enrollment per learner; those of the last nation have been closed."""
    return people(spark, sf).select(
        "enrollment_id", "learner_id", F.lit(T.CERTIFICATION_ID).alias("certification_id"),
        "path_id", registered().alias("enrolled_date"),
        "target_completion_date", "target_exam_date",
        F.when(F.col("c_nationkey") == 24, "CLOSED").otherwise("ACTIVE").alias("enrollment_status"),
        now().alias("created_at"),
        now().alias("updated_at"),
    )


def order_enrollments(spark: SparkSession, sf: str) -> DataFrame:
    """Many enrollments per learner: one per order, of several statuses and certifications."""
    src = table(spark, sf, "orders")
    employee = F.expr("concat('EMP-', o_custkey)")
    return src.select(
        F.expr("concat('ENR-', lpad(cast(o_orderkey as string), 12, '0'))").alias("enrollment_id"),
        learner_key(employee).alias("learner_id"),
        F.expr(
            f"if(o_orderpriority = '1-URGENT', 'CERT_OTHER', '{T.CERTIFICATION_ID}')"
        ).alias("certification_id"),
        F.expr("if(o_orderstatus = 'F', 'COMPLETED', 'ACTIVE')").alias("enrollment_status"),
        F.col("o_orderdate").alias("created_at"),
    )


TOPIC_OF_EVENT = "concat('D0', (k % 35) div 7 + 1, '_T0', k % 35 % 7 + 1)"
EVENT_TYPE = (
    "case event_type when 'view' then 'STUDIED' when 'click' then 'STARTED' "
    "when 'purchase' then 'COMPLETED' when 'signup' then 'PROGRESS_UPDATED' else event_type end"
)
PERCENT_K = "cast(get_json_object(props, '$.k') as int)"


def learning_events(spark: SparkSession, sf: str) -> DataFrame:
    """The event log: every event, errors as starts, completed ones at 100 percent."""
    src = table(spark, sf, "events").withColumnRenamed("event_id", "k")
    return src.select(
        F.expr("concat('EVT-', k)").alias("event_id"),
        enrollment_key(F.expr("concat('EMP-', user_id)")).alias("enrollment_id"),
        F.expr(TOPIC_OF_EVENT).alias("topic_id"),
        F.expr(EVENT_TYPE.replace("else event_type", "else 'STARTED'")).alias("event_type"),
        F.col("ts").alias("event_timestamp"),
        F.expr("cast(floor(value) as decimal(8,0))").alias("duration_minutes"),
        F.expr(
            f"cast(if(event_type = 'purchase', 100, {PERCENT_K}) as decimal(5,2))"
        ).alias("completion_percent"),
        F.lit("RECORD_LEARNING_ACTIVITY").alias("event_source"),
        F.lit(None).cast("string").alias("notes"),
        F.col("ts").alias("processed_at"),
        F.to_date("ts").alias("batch_day"),
    )


def initial_progress(spark: SparkSession, sf: str) -> DataFrame:
    pairs = S.fanout(enrollments(spark, sf), plan(spark, sf))
    return S.fresh_progress(pairs, now())


def progress(spark: SparkSession, sf: str) -> DataFrame:
    """Progress of all active enrollments after folding the event log day by day."""
    return P.progress_fold(
        learning_events(spark, sf), "batch_day", initial_progress(spark, sf)
    ).withColumn("updated_at", now())


def progress_table(spark: SparkSession, sf: str) -> DataFrame:
    """``progress`` written once, for queries that read it more than once."""
    return stored(spark, sf, "progress", lambda: progress(spark, sf))


def activity_inbox(spark: SparkSession, sf: str) -> DataFrame:
    src = table(spark, sf, "events").withColumnRenamed("event_id", "k")
    return src.select(
        F.when(every(101, 3), text_null())
        .when(every(89, 5), F.expr("concat('ACT-', k + 1)"))
        .otherwise(F.expr("concat('ACT-', k)"))
        .alias("activity_id"),
        F.when(every(103, 7), "")
        .when(every(19, 2), F.expr("concat('emp-', user_id)"))
        .otherwise(F.expr("concat('EMP-', user_id)"))
        .alias("employee_id"),
        F.when(every(107, 9), text_null())
        .when(F.expr("k % 38 >= 35"), F.expr("concat('D09_T0', k % 38 - 34)"))
        .otherwise(F.expr(f"concat(' ', lower({TOPIC_OF_EVENT}))"))
        .alias("topic_id"),
        F.when(every(109, 11), "")
        .otherwise(
            F.expr(
                "case event_type when 'view' then ' studied ' when 'click' then 'Started' "
                "when 'purchase' then 'COMPLETED' when 'signup' then 'PROGRESS_UPDATED' "
                "else event_type end"
            )
        )
        .alias("event_type"),
        F.when(every(113, 13), text_null())
        .when(every(127, 15), "ten")
        .when(every(131, 17), "-5")
        .when(every(137, 19), "30.5")
        .otherwise(F.expr("cast(floor(value) as string)"))
        .alias("duration_minutes"),
        F.when(every(139, 21), text_null())
        .when(every(149, 23), "x")
        .when(every(151, 25), "150")
        .when(every(157, 27), "-1")
        .otherwise(F.expr("get_json_object(props, '$.k')"))
        .alias("completion_percent"),
        F.when(every(163, 29), text_null())
        .when(every(167, 31), "2024-13-45 00:00:00")
        .when(every(173, 33), "2024")
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .alias("activity_timestamp"),
        F.expr("concat('from ', event_type)").alias("notes"),
        F.expr("concat('activity_', k % 4, '.csv')").alias("source_file_name"),
        F.col("k").alias("source_row_number"),
    )


def activity_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Activity ids accepted before, one for each order; many of them never come again."""
    return (
        table(spark, sf, "orders")
        .selectExpr(
            f"'{T.ACTIVITY_PIPELINE}' as pipeline_name",
            "concat('ACT-', o_orderkey * 17) as source_record_id",
            "timestamp_ntz'2023-12-31' as processed_at",
            "'accepted earlier' as processing_result",
        )
    )


def earlier_events(spark: SparkSession, sf: str) -> DataFrame:
    """Event ids recorded before, several rows an order."""
    return table(spark, sf, "lineitem").selectExpr("concat('ACT-', l_orderkey * 19) as event_id")


def validated_activity(spark: SparkSession, sf: str) -> DataFrame:
    from studyflow.plans import activity as A

    return A.validate_activity(
        activity_inbox(spark, sf),
        activity_ledger(spark, sf),
        earlier_events(spark, sf),
        learners(spark, sf),
        enrollments(spark, sf),
        initial_progress(spark, sf),
    )


def direct_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Single recordings in table form, some of them wrong."""
    src = table(spark, sf, "events").withColumnRenamed("event_id", "k")
    return src.select(
        F.col("k").alias("call_id"),
        enrollment_key(F.expr("concat('EMP-', user_id)")).alias("enrollment_id"),
        F.when(F.expr("k % 38 >= 35"), F.expr("concat('D09_T0', k % 38 - 34)"))
        .otherwise(F.expr(TOPIC_OF_EVENT))
        .alias("topic_id"),
        F.when(every(109, 11), text_null())
        .otherwise(F.expr(f"concat(' ', lower({EVENT_TYPE}))"))
        .alias("event_type"),
        F.when(~every(113, 13), F.expr("cast(floor(value) - 3 as decimal(38,0))")).alias(
            "duration_minutes"
        ),
        F.when(~every(139, 21), F.expr(f"cast({PERCENT_K} * 2 - 20 as decimal(38,0))")).alias(
            "completion_percent"
        ),
        F.expr("concat('from ', event_type)").alias("notes"),
    )


def assessments(spark: SparkSession, sf: str) -> DataFrame:
    score = "cast(cast(cast(round(o_totalprice * 100) as bigint) div 5000 as decimal(18,0)) * 0.01BD as decimal(5,2))"
    src = table(spark, sf, "orders").withColumn("score_percent", F.expr(score))
    return src.select(
        F.expr("concat('ASM-', lpad(cast(o_orderkey as string), 12, '0'))").alias("assessment_id"),
        enrollment_key(F.expr("concat('EMP-', o_custkey)")).alias("enrollment_id"),
        F.expr("concat('Exam ', o_orderpriority)").alias("assessment_name"),
        F.expr("if(o_orderstatus = 'F', 'MOCK_EXAM', 'PRACTICE_TEST')").alias("assessment_type"),
        F.expr(
            "if(o_orderpriority = '1-URGENT', concat('DOMAIN_0', o_custkey % 5 + 1), null)"
        ).alias("domain_id"),
        "score_percent",
        F.expr("score_percent >= 75").alias("passed_flag"),
        F.col("o_orderdate").alias("attempted_at"),
    )


def line_inbox(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as an inbox whose source ids repeat."""
    return table(spark, sf, "lineitem").selectExpr(
        "concat(l_orderkey, '-', l_linenumber) as source_record_id",
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "concat('supplier_', l_suppkey) as source_file_name",
        "l_partkey as source_row_number",
    )


