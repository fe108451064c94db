"""CSV inboxes: every column is text, bad values are left for validation to name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens that stand for a missing field.
TOPIC_NULL_TOKENS = ("", "NULL")
CSV_NULL_TOKENS = ("", "NULL", "null")

CORRUPT = "_corrupt_line"
BLOCK = ("source_file_name", "_block_start")


class MalformedInbox(ValueError):
    """A line of the load has the wrong number of columns."""


def _schema(cols: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in [*cols, CORRUPT]])


def _options(multiline: bool) -> dict[str, str]:
    return {
        "header": "true",
        "enforceSchema": "true",
        "quote": '"',
        "escape": '"',
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
        "ignoreLeadingWhiteSpace": "true",
        "ignoreTrailingWhiteSpace": "true",
        "multiLine": str(multiline).lower(),
    }


def clean_field(name: str, null_tokens: Sequence[str]) -> Column:
    text = F.trim(F.col(name))
    return F.when(~text.isin(*null_tokens), text).alias(name)


def _shape(raw: DataFrame, cols: Sequence[str], null_tokens: Sequence[str]) -> DataFrame:
    return raw.select(
        *[clean_field(c, null_tokens) for c in cols],
        F.col(CORRUPT),
        F.col("_metadata.file_path").alias("source_file_name"),
        F.col("_metadata.file_block_start").alias("_block_start"),
    )


def refuse_malformed(df: DataFrame) -> DataFrame:
    """Fail if any line was malformed; otherwise drop the marker column.

    All columns are read for the check, since a pruned read would not notice a short line.
    """
    bad = df.filter(F.col(CORRUPT).isNotNull()).limit(1).collect()
    if bad:
        raise MalformedInbox(f"column count mismatch: {bad[0][CORRUPT]!r}")
    return df.drop(CORRUPT)


def read_inbox(
    spark: SparkSession,
    path: str,
    cols: Sequence[str],
    null_tokens: Sequence[str] = CSV_NULL_TOKENS,
    strict: bool = False,
    multiline: bool = False,
) -> DataFrame:
    """Header CSV as trimmed text with its file name; ``strict`` aborts on a malformed line.

    ``multiline`` allows line breaks inside quotes at the price of unsplittable files.
    """
    raw = spark.read.schema(_schema(cols)).options(**_options(multiline)).csv(path)
    shaped = _shape(raw, cols, null_tokens)
    return refuse_malformed(shaped) if strict else shaped.drop(CORRUPT)


def stream_inbox(
    spark: SparkSession,
    path: str,
    cols: Sequence[str],
    null_tokens: Sequence[str] = CSV_NULL_TOKENS,
    max_files: int | None = None,
    multiline: bool = False,
) -> DataFrame:
    """The same inbox as a stream of newly arrived files; the checkpoint remembers the position.

    ``multiline`` as for ``read_inbox``.
    """
    reader = spark.readStream.schema(_schema(cols)).options(**_options(multiline))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _shape(reader.csv(path), cols, null_tokens)


def with_position(df: DataFrame) -> DataFrame:
    """Add a number that grows with the position of a row inside its block.

    Store the result before numbering rows: reading the files again could cut other blocks.
    """
    return df.withColumn("_position", F.monotonically_increasing_id())


def with_row_number(stored: DataFrame) -> DataFrame:
    """Position of each row in its file, from one, without ordering a file in one task.

    A file is read in blocks. Rows per block are counted, the counts are summed along the file (one
    small row per block), and each row adds the offset of its block to its place inside it. AQE
    broadcasts the offsets of few blocks; each block has a bounded number of rows.
    """
    blocks = stored.groupBy(*BLOCK).agg(
        F.min("_position").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    offsets = blocks.selectExpr(
        "source_file_name as _file",
        "_block_start as _block",
        "_first",
        "sum(_rows) over (partition by source_file_name order by _block_start) - _rows as _before",
    )
    return (
        stored.join(
            offsets,
            (F.col("source_file_name") == F.col("_file"))
            & (F.col("_block_start") == F.col("_block")),
        )
        .withColumn(
            "source_row_number", F.col("_before") + F.col("_position") - F.col("_first") + 1
        )
        .drop("_position", "_block_start", "_file", "_block", "_first", "_before")
    )
