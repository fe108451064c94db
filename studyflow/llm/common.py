"""Helpers shared by the corpus operators: shared tables, word batches, distributed running sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyflow.session import shared_dir

#: Words are runs of anything but blank and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: An Arrow batch is closed at so many bytes, so that very long texts do not pile up in a worker.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back: lineage ends here."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType
) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes as well as in rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty. ``bytes.split()`` splits at exactly
    the characters that WORD excludes, and ``bytes.lower()`` changes exactly A-Z."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
            for c, f in zip(columns, schema, strict=True)
        ],
        schema=schema,
    )


class Codes(dict):
    """Word to row number of per-word value tables, made on first sight and forgotten past ``limit``
    words, so that memory stays bounded; values depend on the word alone, so forgetting changes
    nothing."""

    def __init__(self, limit: int, *makers: Callable[[bytes], int], dtype=np.uint64):
        super().__init__()
        self.limit, self.makers = limit, makers
        self.values = [np.zeros(1 << 16, dtype) for _ in makers]

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        if code >= len(self.values[0]):
            self.values = [np.concatenate([v, np.zeros_like(v)]) for v in self.values]
        for values, maker in zip(self.values, self.makers, strict=True):
            values[code] = maker(word)
        return code

    def look_up(self, words: list[bytes]) -> list[np.ndarray]:
        if len(self) > self.limit:
            self.clear()
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return [v[codes] for v in self.values]


def running_sum(df: DataFrame, order: list[str], value: str, purpose: str, group: list[str] | None = None):
    """``df`` sorted by ``order`` over range partitions, with ``before``: the sum of ``value`` over
    all earlier rows (of the same ``group``, whose columns must lead ``order``).

    Each partition sums its own rows; only one total per partition and group is summed across
    partitions, so no task sees more than its share. Rows that tie in ``order`` must be alike.
    """
    group = group or []
    fields = df.schema.fields + [
        T.StructField("part_", T.IntegerType(), False),
        T.StructField("local_", T.LongType(), False),
    ]
    schema = T.StructType(fields)
    at = [df.columns.index(c) for c in group]
    value_at = df.columns.index(value)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        part, last, total = TaskContext.get().partitionId(), None, 0
        arrow = to_arrow_schema(schema)
        for batch in batches:
            n = batch.num_rows
            values = batch.column(value_at).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = list(zip(*(batch.column(i).to_pylist() for i in at), strict=True)) if at else [()] * n
            local = np.zeros(n, np.int64)
            start = 0
            while start < n:
                end = start
                while end < n and keys[end] == keys[start]:
                    end += 1
                if keys[start] != last:
                    last, total = keys[start], 0
                sums = np.cumsum(values[start:end])
                local[start:end] = total + sums - values[start:end]
                total += int(sums[-1])
                start = end
            yield record_batch(arrow, *batch.columns, np.full(n, part, np.int32), local)

    sorted_rows = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    rows = stored(map_batches(sorted_rows, add, schema), purpose)
    totals = rows.groupBy(*group, "part_").agg(F.sum(value).alias("total_"))
    earlier = Window.partitionBy(*group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        *[F.col(c).alias(f"{c}_") for c in group],
        F.col("part_").alias("of_"),
        F.coalesce(F.sum("total_").over(earlier), F.lit(0)).alias("base_"),
    )
    same = F.col("part_") == F.col("of_")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return (
        rows.join(bases, same)
        .withColumn("before", F.col("local_") + F.col("base_"))
        .drop("part_", "local_", "of_", "base_", *[f"{c}_" for c in group])
    )


def ranked(df: DataFrame, order: list[str], rank: str, purpose: str) -> DataFrame:
    """``df`` with its row number (from 0) in ``order``, in DataFrame functions alone: range partitions,
    numbered within, and one count per partition summed across. Rows that tie in ``order`` must be alike."""
    rows = stored(
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("part_", F.spark_partition_id())
        .withColumn("local_", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        purpose,
    )
    earlier = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("part_").count().select(
        F.col("part_").alias("of_"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base_")
    )
    return (
        rows.join(bases, F.col("part_") == F.col("of_"))
        .withColumn(rank, F.col("local_") + F.col("base_"))
        .drop("part_", "local_", "of_", "base_")
    )
