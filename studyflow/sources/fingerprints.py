"""Load history by content: which files of an inbox hold something that was not loaded before.

A stream knows a file by its path. Here a file is known by a fingerprint of its rows, so that a file delivered again under
its own name with other content is loaded, and a copy under another name is not loaded twice. Fingerprints add up over
rows (a count, a sum and an exclusive or of row hashes), so they combine on the map side and a file of any size is read in
splits; the order of rows does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyflow.sources.inbox import CSV_NULL_TOKENS, read_inbox
from studyflow.sources.store import Store

HISTORY = "inbox_files"
FILE = "source_file_name"


def fingerprints(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``source_file_name``, ``fingerprint`` and ``row_count`` of each file."""
    marked = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in cols]
    one, other = F.xxhash64(*marked), F.xxhash64(F.lit("other"), *marked)
    return rows.groupBy(FILE).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(one.cast("decimal(20,0)")).alias("_sum"),
        F.bit_xor(other).alias("_xor"),
    ).select(FILE, F.sha2(F.concat_ws(":", "row_count", "_sum", "_xor"), 256).alias("fingerprint"), "row_count")


def unseen(found: DataFrame, history: DataFrame) -> DataFrame:
    """Files whose content was not loaded before; of equal files the first by name."""
    fresh = found.join(history.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return fresh.groupBy("fingerprint").agg(F.min(FILE).alias(FILE), F.min_by("row_count", FILE).alias("row_count"))


def load_unseen(
    store: Store,
    inbox: str,
    cols: Sequence[str],
    batch: str,
    at: Column,
    null_tokens: Sequence[str] = CSV_NULL_TOKENS,
) -> DataFrame:
    """Rows of the files whose content is new, once for a ``batch`` name; the history remembers them."""
    rows = read_inbox(store.spark, inbox, cols, null_tokens)
    earlier = [b for b in store.batches(HISTORY) if b != batch]

    def fresh() -> DataFrame:
        return unseen(fingerprints(rows, cols), store.read_batches(HISTORY, earlier))

    files, _ = store.freeze("unseen-files", batch, fresh)
    store.append(HISTORY, files, batch, at)
    names = files.select(F.col(FILE).alias("_file"))
    return rows.join(names, F.col(FILE) == F.col("_file"), "left_semi").drop("_block_start")
