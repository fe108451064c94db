"""Topic inbox to validated topics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyflow import tables as T
from studyflow.functions.scalars import try_decimal
from studyflow.operators.keyed import latest_by, upsert
from studyflow.operators.rules import ERROR, count_columns, first_failure, split, to_rejects

# Accepted id patterns, difficulty levels and rejection reasons.
TOPIC_ID_PATTERN = r"\AD[0-9]{2}_T[0-9]{2}\z"
DOMAIN_ID_PATTERN = r"\ADOMAIN_[0-9]{2}\z"
DIFFICULTY_LEVELS = ("BEGINNER", "INTERMEDIATE", "ADVANCED")
BAD_TOPIC_ID = "Missing or invalid topic ID"
BAD_DOMAIN_ID = "Missing or invalid domain ID"
UNKNOWN_DOMAIN = "Domain does not exist in the approved domain list"
NAME_REQUIRED = "Topic name is required"
BAD_DIFFICULTY = "Difficulty level is invalid"
BAD_HOURS = "Estimated hours must be a positive number"
BAD_ORDER = "Topic order must be a positive whole number"

# The domain id pattern admits a hundred ids and the topic id pattern ten thousand, and both are
# table keys. So the domain and topic tables (and a plan of four paths over the topics) have a
# proven size bound and may be broadcast.


def _text(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)), F.lit(""))


def keep_known(df: DataFrame, domains: DataFrame, on: str = "domain_id") -> DataFrame:
    """Rows whose domain exists."""
    return df.join(F.broadcast(domains.select(on)), on, "left_semi")


def validate_topics(df: DataFrame, domains: DataFrame) -> DataFrame:
    """Typed topic values plus the first failing rule of each row.

    Valid means no rule failed, so hours or order that do not parse are rejected with their reason.
    """
    known = F.broadcast(domains.select("domain_id", F.lit(True).alias("_known")))
    hours = try_decimal(F.col("estimated_hours"), 5, 1)
    order = try_decimal(F.col("topic_order"), 3, 0)
    rules = [
        (~_text("topic_id").rlike(TOPIC_ID_PATTERN), BAD_TOPIC_ID),
        (~_text("domain_id").rlike(DOMAIN_ID_PATTERN), BAD_DOMAIN_ID),
        (F.col("_known").isNull(), UNKNOWN_DOMAIN),
        (_text("topic_name") == "", NAME_REQUIRED),
        (~F.upper(_text("difficulty_level")).isin(*DIFFICULTY_LEVELS), BAD_DIFFICULTY),
        (hours.isNull() | (hours <= 0), BAD_HOURS),
        (order.isNull() | (order <= 0), BAD_ORDER),
    ]
    return df.join(known, "domain_id", "left").select(
        *df.columns,
        hours.alias("hours_value"),
        order.alias("order_value"),
        first_failure(rules).alias(ERROR),
    )


def latest_topic_version(valid: DataFrame) -> DataFrame:
    """Newest valid row per topic; ties within one load go to the later file row."""
    newest = [F.desc("ingested_at"), F.desc("source_file_name"), F.desc("source_row_number")]
    return latest_by(valid, ["topic_id"], newest).select(
        "topic_id",
        "domain_id",
        "topic_name",
        "topic_description",
        F.upper(F.trim("difficulty_level")).alias("difficulty_level"),
        F.col("hours_value").alias("estimated_hours"),
        F.col("order_value").alias("topic_order"),
    )


TOPIC_UPDATES = [
    "domain_id", "topic_name", "topic_description",
    "difficulty_level", "estimated_hours", "topic_order",
]


def upsert_topics(topics: DataFrame, source: DataFrame, now: Column) -> DataFrame:
    return upsert(
        topics,
        source,
        ["topic_id"],
        update=TOPIC_UPDATES,
        on_update={"active_flag": F.lit(True), "updated_at": now},
        on_insert={"active_flag": F.lit(True), "created_at": now, "updated_at": now},
    )


@dataclass
class TopicRun:
    topics: DataFrame
    rejects: DataFrame
    counts: DataFrame


def topic_count_columns() -> list[Column]:
    """Counts of a topic run; accepted counts merged topics, so repeats of a topic count once.

    Ids of valid topics follow a pattern of ten thousand values, so the set of them is bounded.
    """
    received, _, rejected = count_columns()
    merged = F.size(F.collect_set(F.when(F.col(ERROR).isNull(), F.col("topic_id"))))
    return [received, merged.cast("bigint").alias("records_accepted"), rejected]


def topic_run_counts(validated: DataFrame) -> DataFrame:
    return validated.agg(*topic_count_columns())


def process_validated_topics(validated: DataFrame, topics: DataFrame, now: Column) -> TopicRun:
    valid, rejected = split(validated)
    return TopicRun(
        upsert_topics(topics, latest_topic_version(valid), now),
        to_rejects(rejected, T.TOPICS_PIPELINE, "topic_id", T.TOPIC_INBOX, now),
        topic_run_counts(validated),
    )


def process_topics(inbox: DataFrame, domains: DataFrame, topics: DataFrame, now: Column) -> TopicRun:
    """One batch of the topic pipeline: validate, keep the newest per topic, merge, reject."""
    return process_validated_topics(validate_topics(inbox, domains), topics, now)


def load_profile(df: DataFrame, key: str) -> DataFrame:
    """Rows per key value, with the total as the row whose key is null-flagged ``ALL``."""
    per_key = df.groupBy(F.col(key).alias("load_key")).agg(F.count(F.lit(1)).alias("row_count"))
    total = df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit("ALL").alias("load_key"), "row_count"
    )
    return total.unionByName(per_key)
