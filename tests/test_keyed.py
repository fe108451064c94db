from fixtures import deliver
from pyspark.sql import functions as F

import pytest

from studyflow import tables as T
from studyflow.operators.keyed import (
    duplicate_keys,
    flag_duplicates,
    insert_missing,
    key_facts,
    latest_by,
    lookup,
    upsert,
)
from studyflow.sources import inbox as IN


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_updates_listed_columns_only(spark):
    target = spark.createDataFrame(
        [(1, "a", "x", True), (2, "b", "y", None)], "k int, v string, fixed string, seen boolean"
    )
    source = spark.createDataFrame(
        [(2, None, "z"), (3, "c", "w")], "k int, v string, fixed string"
    )
    merged = upsert(
        target, source, ["k"], update=["v"],
        on_update={"seen": F.lit(True)}, on_insert={"seen": F.lit(False)},
    )
    assert rows(merged) == [(1, "a", "x", True), (2, None, "y", True), (3, "c", "w", False)]
    assert merged.schema == target.schema
    again = upsert(merged, source, ["k"], ["v"], {"seen": F.lit(True)}, {"seen": F.lit(False)})
    assert again.count() == 3


def test_insert_missing_leaves_existing_rows(spark):
    target = spark.createDataFrame([(1, "old")], "k int, v string")
    source = spark.createDataFrame([(1, "new"), (2, "new")], "k int, v string")
    assert rows(insert_missing(target, source, ["k"])) == [(1, "old"), (2, "new")]


def test_hot_and_missing_keys_keep_every_row(spark):
    """A third of the rows share one key and a third have none."""
    n = 30_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id")))
        .alias("key"),
        "id",
    )
    for threshold in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            flagged = flag_duplicates(df, "key", ["id"]).cache()
            assert flagged.count() == n
            assert flagged.filter("is_duplicate").count() == n // 3
            assert flagged.filter("is_duplicate and key <> 'hot'").count() == 0
            known = spark.createDataFrame([("k1",), ("nobody",)], "key string")
            facts = key_facts(df, "key", ["id"], {"known": known})
            assert facts.count() == n
            assert [r.id for r in facts.filter("known").collect()] == [1]
            assert facts.filter("is_duplicate").count() == n // 3
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_key_partition_is_split(spark):
    """AQE splits the hot partition of the probing side between two plain shuffles."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, 200_000, 1, 8).select(
            F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"),
            "id",
        )
        found = (
            df.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 0 or key = 'hot'")
        )
        joined = lookup(df, found, ["key"], ["id"])
        assert joined.count() == 200_000
        out = joined.select("id", "n")
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_latest_by_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    newest = latest_by(df, ["k"], [F.desc("v")])
    assert {r.v for r in newest.collect()} == set(range(993, 1000))
    assert "WindowGroupLimit" in newest._jdf.queryExecution().executedPlan().toString()
    assert duplicate_keys(df, "k").count() == 7


def test_inbox_reading(spark, folder):
    path = f"{folder}/in"
    deliver(path, "a", T.LEARNER_INBOX, [[" s1 ", "NULL", "", "null", 'say "hi", ok', " 1 "]])
    (row,) = IN.read_inbox(spark, path, T.LEARNER_INBOX, strict=True).collect()
    assert tuple(row)[:6] == ("s1", None, None, None, 'say "hi", ok', "1")
    assert row.source_file_name.endswith("/a.csv")
    topic = IN.read_inbox(spark, path, T.LEARNER_INBOX, IN.TOPIC_NULL_TOKENS).first()
    assert topic.email == "null"

    deliver(path, "b", T.LEARNER_INBOX, [["s2", "e"]])
    with pytest.raises(IN.MalformedInbox):
        IN.read_inbox(spark, path, T.LEARNER_INBOX, strict=True)
    assert IN.read_inbox(spark, path, T.LEARNER_INBOX).count() == 2


def test_row_numbers_across_blocks(spark, folder):
    path = f"{folder}/in"
    for name, n in (("a", 5000), ("b", 3), ("c", 2000)):
        deliver(
            path, name, T.LEARNER_INBOX, [[f"{name}-{i}", "e", "n", "m", "d", "1"] for i in range(1, n + 1)]
        )
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8KB")
    try:
        IN.with_position(IN.read_inbox(spark, path, T.LEARNER_INBOX)).write.parquet(f"{folder}/rows")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    stored = spark.read.parquet(f"{folder}/rows")
    assert stored.select("_block_start").distinct().count() > 5
    numbered = IN.with_row_number(stored)
    assert numbered.count() == 7003
    wrong = numbered.filter(
        F.element_at(F.split("source_record_id", "-"), 2).cast("bigint") != F.col("source_row_number")
    )
    assert wrong.count() == 0
