"""Tables laid out by a key: bucketed and sorted when written, so that joins and groupings on the key move no row of them.

For tables that are written once and looked up many times (enrollments by learner). The layout is Spark's own bucketing;
the table is registered in the session under a name of its own, its files lie in the shared folder.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from studyflow.session import shared_dir


def clustered(df: DataFrame, key: str, buckets: int, purpose: str) -> DataFrame:
    """``df`` written in ``buckets`` sorted buckets of ``key``, and read back."""
    spark = df.sparkSession
    name = f"clustered_{purpose}_{os.urandom(6).hex()}"
    path = f"{shared_dir(spark, purpose)}/{name}"
    (
        df.repartition(buckets, key)
        .write.format("parquet")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .saveAsTable(name)
    )
    return spark.table(name)
