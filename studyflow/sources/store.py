"""The pipelines' tables as append-only Parquet logs, written and read by plain Spark.

A log is a Parquet table partitioned by ``batch``; large ones also by ``bucket``, a hash of the column their readers look
things up by. A batch writes its rows with ``partitionOverwriteMode=dynamic``, so that writing it again replaces it and has
no further effect. Nothing is merged or rewritten. What other systems keep by merging is derived on reading, in one
grouping that combines on the map side: the newest values of changeable columns, the first values of the others.
Topic progress is derived from two logs, what was assigned and what each fold of events added.

Every row carries the time its batch was applied. Batches of one table take effect in the order of that time, then of
their name.

Logs of ids have a Bloom filter per batch, written beside them as a small table (``filters``). A batch that looks up its
ids opens only the buckets of only those earlier batches whose filter may hold one of them; fresh ids open no file of the
log.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from studyflow import tables as T
from studyflow.plans import progress
from studyflow.sources.filters import filter_words, id_mask, id_word
from studyflow.sources.reference import empty_table


@dataclass(frozen=True)
class Log:
    schema: str
    #: Column whose hash is the bucket; none for tables that are small by their keys.
    bucket: str | None = None
    #: Key of the derived table, if it is derived by key; ``first`` are the columns that keep their first value.
    keys: tuple[str, ...] = ()
    first: tuple[str, ...] = ()
    #: Id column with a Bloom filter per batch.
    ids: str | None = None


LOGS = {
    "study_topics": Log(T.TOPIC_SCHEMA, keys=("topic_id",), first=("created_at",)),
    "learning_paths": Log(T.PATH_SCHEMA, keys=("path_id",)),
    "exam_domains": Log(T.DOMAIN_SCHEMA, keys=("domain_id",)),
    "path_topic_plan": Log(T.PLAN_SCHEMA, keys=("path_id", "topic_id"), first=("created_at",)),
    "learners": Log(
        T.LEARNER_SCHEMA, "learner_id", ("learner_id",), ("employee_id", "joined_date", "created_at")
    ),
    "enrollments": Log(
        T.ENROLLMENT_SCHEMA, "learner_id", ("enrollment_id",),
        ("learner_id", "certification_id", "enrolled_date", "enrollment_status", "created_at"),
    ),
    "topic_assignments": Log(T.PROGRESS_SCHEMA, "enrollment_id"),
    "progress_rollups": Log(progress.ROLLUP_SCHEMA, "enrollment_id"),
    "progress_sums": Log(progress.SUMS_SCHEMA, "enrollment_id", ("enrollment_id",)),
    "learning_events": Log(T.EVENT_SCHEMA, "event_id", ids="event_id"),
    "processed_records": Log(T.LEDGER_SCHEMA, "source_record_id", ids="source_record_id"),
    "rejected_records": Log(T.REJECT_SCHEMA, "source_record_id", ids="source_record_id"),
    "reject_resolutions": Log(T.RESOLUTION_SCHEMA, "source_record_id"),
    "summed_batches": Log("log string, of_batch string"),
    "inbox_files": Log("source_file_name string, fingerprint string, row_count bigint"),
    "pipeline_run_log": Log(T.RUN_LOG_SCHEMA),
    "assessment_results": Log(T.ASSESSMENT_SCHEMA),
}
APPLIED = "applied_at"


def at_once(calls: Sequence[Callable[[], object]]) -> list:
    """Run Spark jobs that do not depend on each other side by side; the first failure is raised."""
    out: list = [None] * len(calls)
    failed: list[BaseException] = []

    def run(k: int) -> None:
        try:
            out[k] = calls[k]()
        except BaseException as error:
            failed.append(error)

    threads = [InheritableThread(target=run, args=(k,)) for k in range(len(calls))]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    if failed:
        raise failed[0]
    return out


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def batches(self, name: str) -> list[str]:
        """Names of the batches of a log."""
        folder = f"{self.root}/{name}"
        if not self._exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch="))

    def ensure_log(self, name: str) -> None:
        """A folder that a stream can watch before anything was written."""
        self._fs.mkdirs(self._path(f"{self.root}/{name}"))

    # --- writing ----------------------------------------------------------------------------------

    def bucket_of(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def append(self, name: str, rows: DataFrame, batch: str | Column, at: Column | None = None) -> None:
        """Write a batch, or one per value of a column; writing it again replaces it. ``at``: when it takes effect
        (the epoch for initial loads)."""
        log = LOGS[name]
        when = F.lit("1970-01-01 00:00:00") if at is None else at
        label = F.lit(batch) if isinstance(batch, str) else batch
        shaped = rows.select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in self._columns(log)],
            when.cast("timestamp_ntz").alias(APPLIED),
            label.alias("batch"),
            *([self.bucket_of(log.bucket).alias("bucket")] if log.bucket else []),
        )
        self._write(shaped, f"{self.root}/{name}", bool(log.bucket))
        if log.ids:
            # From what was written, so that the rows are not made a second time.
            written = self._read(name, [batch]) if isinstance(batch, str) else shaped
            words = filter_words(written.select("batch", "bucket", log.ids), log.ids)
            self._write(words, f"{self.root}/filters/{name}", True)

    def append_all(self, batch: str, at: Column | None, **rows: DataFrame) -> None:
        """Append to several logs, side by side: the jobs of a small batch are short and would wait for one another."""
        at_once([partial(self.append, name, df, batch, at) for name, df in rows.items()])

    @staticmethod
    def _write(rows: DataFrame, path: str, bucketed: bool) -> None:
        parts = ["batch", "bucket"] if bucketed else ["batch"]
        # Even file sizes whatever the size of a bucket: AQE splits large and joins small ones.
        rows.hint("rebalance", *[F.col(p) for p in parts]).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(*parts).parquet(path)

    def load(self, name: str, rows: DataFrame) -> None:
        """Initial content of a table."""
        if name == "topic_progress":
            self.append("topic_assignments", rows, "load")
        else:
            self.append(name, rows, "load")

    def freeze(
        self,
        purpose: str,
        batch: str,
        build: Callable[[], DataFrame],
        counts: Sequence[Column] = (),
    ) -> tuple[DataFrame, dict[str, int]]:
        """The rows of a batch, written once so that every later step, and any repeat, sees the same rows.

        ``counts`` are taken while the rows are written, by an observation, without a job of their own.
        """
        path = f"{self.root}/frozen/{purpose}/batch={batch}"
        seen: dict[str, int] | None = None
        if not self._exists(f"{path}/_SUCCESS"):
            rows = build()
            watch = Observation() if counts else None
            (rows.observe(watch, *counts) if watch else rows).write.mode("overwrite").parquet(path)
            seen = watch.get if watch else {}
        frozen = self.spark.read.parquet(path)
        if seen is None:
            seen = frozen.agg(*counts).first().asDict() if counts else {}
        return frozen, seen

    def release(self, purpose: str, batch: str) -> None:
        """Forget the frozen rows of a finished batch."""
        self._fs.delete(self._path(f"{self.root}/frozen/{purpose}/batch={batch}"), True)

    # --- reading ----------------------------------------------------------------------------------

    @staticmethod
    def _columns(log: Log):
        from pyspark.sql import types

        return types._parse_datatype_string(log.schema).fields

    def _read(
        self, name: str, batches: Sequence[str] | None = None, buckets: Sequence[int] | None = None
    ) -> DataFrame:
        """Rows of a log with ``applied_at``, ``batch`` and, where there is one, ``bucket``; partitions are pruned."""
        log = LOGS[name]
        schema = f"{log.schema}, {APPLIED} timestamp_ntz, batch string" + (", bucket int" if log.bucket else "")
        if not self.batches(name) or batches == [] or buckets == []:
            return empty_table(self.spark, schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        if batches is not None:
            rows = rows.where(F.col("batch").isin(list(batches)))
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(list(buckets)))
        return rows

    def _derive(self, name: str, rows: DataFrame) -> DataFrame:
        log = LOGS[name]
        columns = [f.name for f in self._columns(log)]
        if not log.keys:
            return rows.select(*columns)
        order = F.struct(APPLIED, "batch")
        newest = [c for c in columns if c not in log.keys and c not in log.first]
        folded = rows.groupBy(*log.keys).agg(
            F.max_by(F.struct(*newest), order).alias("newest_"),
            *([F.min_by(F.struct(*log.first), order).alias("first_")] if log.first else []),
        )
        place = {c: f"newest_.{c}" for c in newest} | {c: f"first_.{c}" for c in log.first}
        return folded.select(*[F.col(place.get(c, c)).alias(c) for c in columns])

    def read(self, name: str) -> DataFrame:
        """Current content of a table."""
        return self._content(name, None)

    def _content(self, name: str, buckets: Sequence[int] | None) -> DataFrame:
        if name == "topic_progress":
            return progress.from_logs(
                self._read("topic_assignments", buckets=buckets), self._read("progress_rollups", buckets=buckets)
            )
        rows = self._derive(name, self._read(name, buckets=buckets))
        if name == "rejected_records":
            from studyflow.plans.audit import with_resolutions

            return with_resolutions(rows, self._read("reject_resolutions", buckets=buckets))
        return rows

    def read_batches(self, name: str, batches: Sequence[str]) -> DataFrame:
        """Rows of the given batches, with their ``batch``."""
        columns = [f.name for f in self._columns(LOGS[name])]
        return self._read(name, batches).select(*columns, "batch")

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of a column of keys; at most ``buckets`` small integers come to the driver."""
        return self.touched_by(keys)[0]

    def touched_by(self, keys: DataFrame) -> list[list[int]]:
        """Buckets of each column of keys, in one pass."""
        found = keys.agg(*[F.collect_set(self.bucket_of(c)).alias(f"k{i}") for i, c in enumerate(keys.columns)])
        return [sorted(held) for held in found.first()]

    def in_buckets(self, name: str, buckets: Sequence[int], log: bool = False) -> DataFrame:
        """The content of the given buckets, or as rows of the log, with when they were added."""
        return self._read(name, buckets=buckets) if log else self._content(name, buckets)

    def read_touched(self, name: str, keys: DataFrame) -> DataFrame:
        """The content of the buckets that may hold ``keys`` (one column)."""
        return self._content(name, self.touched(keys))

    def may_hold(self, name: str, ids: DataFrame, buckets: list[int] | None = None) -> list[tuple[str, int]]:
        """(batch, bucket) pairs of an id log whose filter may hold one of ``ids`` (one column); others hold none.
        ``buckets``: those of the ids, where they are known."""
        (key,) = ids.columns
        if not self._exists(f"{self.root}/filters/{name}"):
            return []
        asked = ids.where(F.col(key).isNotNull()).select(
            self.bucket_of(key).alias("bucket"), id_word(key).alias("word_at"), id_mask(key).alias("mask")
        ).distinct()
        words = self.spark.read.schema("word_at int, word bigint, batch string, bucket int").parquet(
            f"{self.root}/filters/{name}"
        ).where(F.col("bucket").isin(self.touched(ids) if buckets is None else buckets))
        hit = asked.join(words, ["bucket", "word_at"]).where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask"))
        return sorted((r[0], r[1]) for r in hit.select("batch", "bucket").distinct().collect())

    def read_known(
        self, name: str, ids: DataFrame, but: str | None = None, buckets: list[int] | None = None
    ) -> DataFrame:
        """Rows of an id log that may have one of ``ids``: all that do, few others. Rows of batch ``but`` are left out."""
        columns = [f.name for f in self._columns(LOGS[name])]
        held = [pair for pair in self.may_hold(name, ids, buckets) if pair[0] != but]
        if not held:
            return empty_table(self.spark, LOGS[name].schema)
        folder = f"{self.root}/{name}"
        opened = [f"{folder}/batch={b}/bucket={k}" for b, k in held]
        rows = self.spark.read.schema(f"{LOGS[name].schema}, batch string, bucket int").option("basePath", folder)
        return rows.parquet(*opened).select(*columns)
