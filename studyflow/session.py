"""Session construction for local runs; on a cluster the submitted configuration wins."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "studyflow") -> SparkSession:
    """A local session with the settings the plans were tuned for.

    AQE coalesces small shuffles, splits skewed join partitions and turns sort-merge joins into
    broadcast joins once the real size of a side is known.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def wide(spark: SparkSession) -> int:
    """Partitions for tables of many rows that are much alike (untouched progress): as many as a shuffle has, 96 at least.

    AQE joins shuffled partitions up to a compressed size, which for such rows is many times the memory of their sort;
    a number that is asked for stays.
    """
    return max(96, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's checkpoint folder.

    Where none is set, a local session gets a temporary folder; a cluster must name one, since a
    machine-local folder would not be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        return tempfile.mkdtemp(prefix=f"studyflow-{purpose}-")
    return f"{base.rstrip('/')}/studyflow/{purpose}-{os.urandom(8).hex()}"
