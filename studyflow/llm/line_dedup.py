"""Exact line de-duplication that returns keep bitmaps instead of texts; DataFrame functions only.

A line's key is the line without outer blanks, A-Z in lower case. Keys of at least ``min_chars`` code
points that occur in two documents or more keep their lines only in the document with the smallest id.

1. Every long enough line becomes (two 64-bit hashes of its key, document, position); the texts stay
   behind. The rows are stored once.
2. Very frequent keys are found by a sketch that is merged from all tasks, and at most ``HOT_KEYS``
   of them are set apart. Their first documents come from a grouping that is reduced before its
   shuffle; their rows then meet that small table where they are, unshuffled. Which keys are set apart
   never alters a result.
3. All other rows are range-partitioned by hash and sorted by document and position within; a
   running window streams over each key's rows and marks those after the first document.
4. Marked positions become one run-length bitmap a document: the (start, length) of its kept runs.

Cases: a null or empty text is one empty line; a null id counts as one document after all others;
rows that repeat an id are one document, and equal rows get equal bitmaps; documents without a
dropped line have no bitmap row; an empty table has none. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyflow.llm.common import stored

MIN_CHARS = 10
#: Keys set apart, and counters of the sketch that finds them: a key with over about 4 / counters of all
#: lines cannot be missed.
HOT_KEYS, COUNTERS = 1000, 16384
#: Blank and the ASCII controls from tab to carriage return; the letters that change case.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = 2**63 - 1


def line_key(line: Column) -> Column:
    inner = F.trim(line, F.lit(BLANKS))
    # lower() is right and quick where there is nothing but ASCII.
    return F.when(F.octet_length(inner) == F.char_length(inner), F.lower(inner)).otherwise(
        F.translate(inner, UPPER, LOWER)
    )


def keyed_documents(docs: DataFrame) -> DataFrame:
    """(doc_, row_, text_): the id, a hash that tells rows of one id apart, and the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.select(doc.alias("doc_"), F.xxhash64(text).alias("row_"), text.alias("text_"))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    lines = keyed_documents(docs).select("doc_", "row_", F.split("text_", "\n", -1).alias("lines_"))
    exploded = lines.select(
        "doc_", "row_", F.size("lines_").alias("n_lines"), F.posexplode("lines_").alias("pos", "line_")
    )
    keys = exploded.select("doc_", "row_", "n_lines", "pos", line_key(F.col("line_")).alias("key_"))
    return keys.where(F.char_length("key_") >= min_chars).select(
        F.xxhash64("key_").alias("h1"), F.xxhash64(F.lit(1), "key_").alias("h2"), "doc_", "row_", "pos", "n_lines"
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_, row_, n_lines, n_dropped, kept_runs) of the documents that lose lines."""
    rows = stored(hashed_lines(docs, min_chars), "lines")
    hot = rows.agg(F.expr(f"approx_top_k(h1, {HOT_KEYS}, {COUNTERS})").alias("top")).select(
        F.explode(F.transform("top", lambda x: x["item"])).alias("h1")
    )
    # At most HOT_KEYS rows from here on.
    hot = stored(hot, "hot-lines")
    firsts = rows.join(F.broadcast(hot), "h1").groupBy("h1", "h2").agg(F.min("doc_").alias("first_"))
    hot_dropped = rows.join(F.broadcast(firsts), ["h1", "h2"]).where(F.col("doc_") > F.col("first_"))

    cold = rows.join(F.broadcast(hot), "h1", "left_anti")
    order = ["h1", "h2", "doc_", "row_", "pos"]
    so_far = (
        Window.partitionBy("h1", "h2").orderBy(*order[2:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    cold_dropped = (
        cold.repartitionByRange("h1", "h2")
        .sortWithinPartitions(*order)
        .withColumn("first_", F.first("doc_").over(so_far))
        .where(F.col("doc_") > F.col("first_"))
    )
    columns = ["doc_", "row_", "n_lines", "pos"]
    dropped = cold_dropped.select(*columns).unionByName(hot_dropped.select(*columns))
    per_doc = dropped.groupBy("doc_", "row_", "n_lines").agg(F.sort_array(F.collect_set("pos")).alias("at_"))
    runs = F.zip_with(
        F.concat(F.array(F.lit(-1)), "at_"),
        F.concat("at_", F.array("n_lines")),
        lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")),
    )
    return per_doc.select(
        "doc_",
        "row_",
        "n_lines",
        F.size("at_").alias("n_dropped"),
        F.filter(runs, lambda r: r["length"] > 0).alias("kept_runs"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of every row of ``docs``."""
    lines = F.split("text_", "\n", -1)
    kept = F.array_join(
        F.flatten(F.transform("kept_runs", lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n"
    )
    return (
        keyed_documents(docs)
        .join(bitmaps.drop("n_lines"), ["doc_", "row_"], "left")
        .select(
            F.when(F.col("doc_") != NO_ID, F.col("doc_")).alias("doc_id"),
            F.size(lines).cast("long").alias("n_lines"),
            F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("kept_runs").isNull(), F.col("text_")).otherwise(kept).alias("kept_text"),
        )
    )


SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= {MIN_CHARS}
      GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first_doc, false) AS dropped
      FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
