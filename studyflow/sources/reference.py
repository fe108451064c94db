"""The small reference tables: one certification, four levels, five domains, four paths.

Their size is fixed by the literals in ``tables``, so every use may broadcast them. They are inline
relations, known to the optimizer with their exact size.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as PT

from studyflow import tables as T

EPOCH = datetime(2024, 1, 1)


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of the given schema, as an inline relation."""
    fields = PT.StructType.fromDDL(schema).fields
    return spark.range(1).filter("false").select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    )


def inline_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A relation from literals, each column cast to the type of ``schema``."""
    fields = PT.StructType.fromDDL(schema).fields

    def literal(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(value, datetime):
            return f"timestamp_ntz'{value.isoformat(sep=' ')}'"
        return str(value).lower() if isinstance(value, bool) else str(value)

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(f.name for f in fields)
    casts = [F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})").select(*casts)


def certifications(spark: SparkSession, now: datetime = EPOCH) -> DataFrame:
    rows = [(*row, True, now, now) for row in T.CERTIFICATIONS]
    return inline_table(spark, rows, T.CERTIFICATION_SCHEMA)


def levels(spark: SparkSession, now: datetime = EPOCH) -> DataFrame:
    rows = [(*row, True, now, now) for row in T.EXPERIENCE_LEVELS]
    return inline_table(spark, rows, T.LEVEL_SCHEMA)


def domains(spark: SparkSession, now: datetime = EPOCH) -> DataFrame:
    rows = [
        (key, T.CERTIFICATION_ID, name, weight, position, text, True, now, now)
        for key, name, weight, position, text in T.EXAM_DOMAINS
    ]
    return inline_table(spark, rows, T.DOMAIN_SCHEMA)


def paths(spark: SparkSession, now: datetime = EPOCH) -> DataFrame:
    rows = [
        (key, T.CERTIFICATION_ID, level, name, weeks, hours, text, True, now, now)
        for key, level, name, weeks, hours, text in T.LEARNING_PATHS
    ]
    return inline_table(spark, rows, T.PATH_SCHEMA)
