"""Ordered validation rules, the valid/rejected split, reject capture and run counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ERROR = "validation_error"


def first_failure(rules: Sequence[tuple[Column, str]]) -> Column:
    """Reason of the first rule whose failing condition is true; null when none is.

    A condition that evaluates to null does not fail its rule, so write conditions to be
    true on missing values where a missing value must be refused.
    """
    (condition, reason), *rest = rules
    chain = F.when(condition, reason)
    for condition, reason in rest:
        chain = chain.when(condition, reason)
    return chain


def split(df: DataFrame, reason: str = ERROR) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected rows. The two filters are exact complements: no row falls between."""
    return df.filter(F.col(reason).isNull()), df.filter(F.col(reason).isNotNull())


def to_rejects(
    rejected: DataFrame,
    pipeline: str,
    key: str,
    record: Sequence[str],
    rejected_at: Column,
    reason: str = ERROR,
) -> DataFrame:
    """Rejected rows in the audit layout, the offending row kept whole as a variant with its nulls."""
    present = set(rejected.columns)

    def lineage(name: str, kind: str) -> Column:
        return (F.col(name) if name in present else F.lit(None)).cast(kind).alias(name)

    return rejected.select(
        F.concat(F.lit("REJ_"), F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))).alias(
            "rejection_id"
        ),
        F.lit(pipeline).alias("pipeline_name"),
        F.col(key).alias("source_record_id"),
        lineage("source_file_name", "string"),
        lineage("source_row_number", "bigint"),
        F.to_variant_object(F.struct(*[F.col(c).alias(c.upper()) for c in record])).alias("raw_record"),
        F.col(reason).alias("rejection_reason"),
        rejected_at.cast("timestamp_ntz").alias("rejected_at"),
        F.lit(False).alias("resolved_flag"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
    )


def raw_field(name: str, raw: str | Column = "raw_record") -> Column:
    """A field of the offending row, by its path."""
    return F.variant_get(raw, f"$.{name.upper()}", "string")


def raw_json(record: Sequence[str], raw: str = "raw_record") -> Column:
    """The offending row as JSON, its fields in the order of ``record``, nulls kept."""
    fields = [raw_field(c, raw).alias(c.upper()) for c in record]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def count_columns(reason: str = ERROR) -> list[Column]:
    """Received, accepted and rejected rows, for ``agg`` or ``observe``."""
    return [
        F.count(F.lit(1)).alias("records_received"),
        F.count_if(F.col(reason).isNull()).alias("records_accepted"),
        F.count_if(F.col(reason).isNotNull()).alias("records_rejected"),
    ]


def run_counts(batch: DataFrame, reason: str = ERROR) -> DataFrame:
    """Received, accepted and rejected rows of one validated batch, in a single pass."""
    return batch.agg(*count_columns(reason))


def counts_row(spark: SparkSession, counts: Mapping[str, int]) -> DataFrame:
    """Counts that were observed while a batch was written, as one row."""
    return spark.range(1).select(
        *[F.lit(counts[c]).cast("bigint").alias(c) for c in ("records_received", "records_accepted", "records_rejected")]
    )
