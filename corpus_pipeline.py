"""The corpus pipeline: five stages from documents to balanced shards of a training mix.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of
documents. Rows that share an id, or have none, are told apart by their texts, so each stays or goes by its own content;
of rows that repeat id and text the duplicate stage keeps one (texts without words are linked with nothing and stay). Empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyflow.llm import classifiers, decontaminate, ftrl, jaccard_join, mixture, sharding
from studyflow.llm.common import WORD, stored, table


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has a column of that name."""
    while name in df.columns:
        name += "_"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with a number per row content, and the names of that column and of the one that says whether the id is
    shared. The number is the id; where several rows have the id, or it is null, a hash of id and text."""
    key, shared = free_name(docs, "row_key"), free_name(docs, "id_shared")
    again = docs.groupBy(F.col("doc_id").alias("id")).count().where("count > 1 or id is null").select("id")
    again = stored(again, "shared-ids").withColumn("hit", F.lit(True))
    rows = docs.alias("d").join(again.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.id")), "left")
    number = F.when(F.col("s.hit"), F.xxhash64("d.doc_id", "d.text")).otherwise(F.col("d.doc_id").cast("long"))
    return rows.select("d.*", number.alias(key), F.col("s.hit").isNotNull().alias(shared)), key, shared


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is not in ``gone`` (one column)."""
    gone = gone.toDF("id").distinct().alias("gone")
    return rows.alias("d").join(gone, F.col(f"d.{key}") == F.col("gone.id"), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity limit."""
    model = classifiers.train_toxicity(docs, table(spark, sf_dir, "labels"))
    return ftrl.below(docs, model, classifiers.TOXIC_AT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; all without words."""
    rows, key, shared = keyed(docs)
    found = jaccard_join.linked_components(rows.select(F.col(key).alias("doc_id"), "text"))
    kept = without(rows, key, found.where("component_id < doc_id").select("doc_id"))
    repeats = F.col(shared) & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    return kept.where(~repeats).unionByName(kept.where(repeats).dropDuplicates([key])).drop(key, shared)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows, key, shared = keyed(docs)
    found = decontaminate.contaminations(
        rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")
    )
    return without(rows, key, found.select("doc_id")).drop(key, shared)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks that the mix takes, as the documents they are cut from: a row a document and pass."""
    return mixture.Mix(docs).texts(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix."""
    return sharding.sharded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_copies),
    ("source mixture", mix_sources),
    ("sharding", shard),
]

#: Learned scores, alignment and permutations are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"after-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
