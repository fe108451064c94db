"""Mixing sources to target weights over fixed-length blocks of words.

1. The words of a source's documents, in id order, are one stream, cut into blocks of BLOCK words (the
   last one may be short). A distributed running sum gives each document its place in the stream.
2. Targets: sources take part in ``share`` of all words by weight; none takes more than ``cap`` times its
   own words, and what it leaves is shared among the others.
3. A source's slots are as many blocks as its target needs, the last one cut so that the words add up to
   the rounded target. Its slots fall to output shards by a multinomial draw.
4. Slot k holds block p(k mod n) of the source, p being a pseudorandom permutation of its n blocks (a
   Feistel network over the index, another one for each pass), so no block is used more often than
   there are passes, and nothing is shuffled to be permuted.
5. Slots meet the documents' pieces by (source, block).

All draws depend on the seed, the source and the index alone, so reruns agree. Per-source figures stay in
a table of one row a source.

Cases: null and empty texts have no words and take nothing; a null source is a source of its own, ordered
last; null ids come first; repeated rows are separate documents of the stream; an empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyflow.llm.common import WORD, map_batches, raw_texts, record_batch, running_sum, stored

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
BLOCK, SHARD_BLOCKS, SEED = 128, 1 << 16, 20_26
ROUNDS = 4


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Permutation:
    """A permutation of range(n) that is computed index by index; ``inverse`` goes back."""

    def __init__(self, n: int, *seed: int):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = np.random.default_rng(seed).integers(0, 1 << 63, ROUNDS).tolist()

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        half = np.uint64(self.half)
        left, right = x >> half, x & self.mask
        for key in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ (mixed(left, key) & self.mask), left
            else:
                left, right = right, left ^ (mixed(right, key) & self.mask)
        return (left << half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), back)
        while (out := x >= self.n).any():  # the network permutes a range of at most 4 n
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, False)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, True)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, sid, target); one row a source.

    Sources are taken by the ratio at which they reach their cap; the first ones are capped as long as
    what is left, by weight, would give the next one its cap or more.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "sid")
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    chosen = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights) + 1)
    most = F.col("source_size") * F.lit(float(cap))
    rows = (
        sizes.withColumn("sid", F.row_number().over(by_name) - 1)
        .withColumn("weight", chosen)
        .withColumn("ratio", most / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("left_budget", F.col("budget") - F.coalesce(F.sum(most).over(earlier), F.lit(0.0)))
        .withColumn(
            "left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
        )
        .withColumn("capped", F.col("left_budget") >= F.col("ratio") * F.col("left_weight"))
    )
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    open_budget = F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), most)).over(everything), F.lit(0.0))
    target = F.when(F.col("capped"), most).otherwise(open_budget * F.col("weight") / open_weight)
    return rows.select("source", "source_size", "sid", target.alias("target"))


def slots_of(size: int, target: int, block: int, seed: int, sid: int) -> tuple[int, int, int]:
    """(blocks, slots, words of the last slot) that take exactly ``target`` words of a source."""
    if size == 0 or target == 0:
        return 0, 0, 0
    blocks = -(-size // block)
    short = blocks * block - size
    passes = -(-target // size)
    at = [p * blocks + int(Permutation(blocks, seed, sid, p).inverse(np.array([blocks - 1]))[0]) for p in range(passes)]
    words = lambda m: m * block - short * sum(m > k for k in at)
    full = next(m for j in range(passes, -1, -1) if words(m := (target + short * j) // block) <= target)
    rest = target - words(full)
    return (blocks, full + 1, rest) if rest else (blocks, full, block)


def draw(sources: DataFrame, block: int, shard_blocks: int, seed: int) -> DataFrame:
    """(sid, blocks, slots, last, shard, first, count): which of a source's slots fall to which shard."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (sid, *slots_of(size, int(round(target)), block, seed, sid))
                for sid, size, target in zip(frame["sid"], frame["source_size"], frame["target"], strict=True)
            ]
            yield pd.DataFrame(rows, columns=["sid", "blocks", "slots", "last"])

    slots = stored(
        sources.select("sid", "source_size", "target").mapInPandas(count, "sid int, blocks long, slots long, last long"),
        "slots",
    )
    total = slots.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-total // shard_blocks))

    def fall(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                rng = np.random.default_rng((seed, int(row.sid), 1))
                counts = rng.multinomial(int(row.slots), np.full(shards, 1.0 / shards))
                drawn = np.flatnonzero(counts)
                yield pd.DataFrame(
                    {
                        "sid": row.sid,
                        "blocks": row.blocks,
                        "slots": row.slots,
                        "last": row.last,
                        "shard": drawn,
                        "first": (np.cumsum(counts) - counts)[drawn],
                        "count": counts[drawn],
                    }
                )

    return slots.mapInPandas(
        fall, "sid int, blocks long, slots long, last long, shard long, first long, count long"
    )


def permuted(drawn: DataFrame, block: int, seed: int) -> DataFrame:
    """(sid, shard, slot, pass, block, words): every slot of the mix with the block it holds."""

    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                k = np.arange(row.first, row.first + row.count)
                passes, index = np.divmod(k, row.blocks)
                held = np.empty(len(k), np.int64)
                for p in np.unique(passes):
                    of = passes == p
                    held[of] = Permutation(int(row.blocks), seed, int(row.sid), int(p))(index[of])
                yield pd.DataFrame(
                    {
                        "sid": row.sid,
                        "shard": row.shard,
                        "slot": k,
                        "pass": passes.astype(np.int32),
                        "block": held,
                        "words": np.where(k == row.slots - 1, row.last, block),
                    }
                )

    # Dealt out evenly: a row stands for as many slots as a source has in a shard.
    parts = int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return drawn.repartition(parts).mapInPandas(
        expand, "sid int, shard long, slot long, pass int, block long, words long"
    )


class Mix:
    """The placed documents, the sources' targets, the slots and the pieces of documents they take."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED):
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        rows = docs.select(
            F.col("source").cast("string").alias("source"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64(text).alias("tie"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        )
        placed = running_sum(stored(rows, "sizes"), ["source", "doc_id", "tie"], "size", "stream", ["source"])
        sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
        self.sources = stored(targets(sizes), "targets")
        named = self.sources.withColumnRenamed("source", "source_")
        self.placed = placed.join(named, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
        self.slots = permuted(draw(self.sources, block, shard_blocks, seed), block, seed)
        self.block = block

    def pieces(self) -> DataFrame:
        """(sid, before, shard, slot, pass, from, to): words [from, to) of the document that begins at
        ``before`` of its source's stream, for every slot that takes some."""
        block = self.block
        covered = self.placed.where("size > 0").select(
            "sid",
            "before",
            "size",
            F.explode(
                F.sequence(
                    F.floor(F.col("before") / block).cast("long"),
                    F.floor((F.col("before") + F.col("size") - 1) / block).cast("long"),
                )
            ).alias("block"),
        )
        begin = F.col("block") * block - F.col("before")
        return (
            # The slots' estimated size is that of the few rows they are expanded from.
            covered.join(self.slots.hint("merge"), ["sid", "block"])
            .withColumn("from", F.greatest(begin, F.lit(0)))
            .withColumn("to", F.least(begin + F.col("words"), F.col("size")))
            .where("`to` > `from`")
            .select("sid", "before", "shard", "slot", "pass", "from", "to")
        )

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) of every document."""
        words = self.pieces().groupBy("sid", "before").agg(F.sum(F.col("to") - F.col("from")).alias("words"))
        # A document without words may begin where the next one does.
        rows = self.placed.withColumn("key_", F.when(F.col("size") > 0, F.col("before")))
        found = words.select(F.col("sid").alias("sid_"), F.col("before").alias("before_"), "words")
        return rows.join(found, (F.col("sid") == F.col("sid_")) & (F.col("key_") == F.col("before_")), "left").select(
            "doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken")
        )

    def texts(self, docs: DataFrame) -> DataFrame:
        """The mix as documents: a row of ``docs`` for every pass that takes words of it, with those words
        (the whole text if it takes all) and n_chars to match. ``docs`` are the mixed documents."""
        cuts = self.pieces().groupBy("sid", "before", "pass").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("cut"))
        cuts = cuts.groupBy("sid", "before").agg(F.collect_list("cut").alias("cuts_"))
        key = ["source", "doc_id", "tie"]
        # Equal rows are told apart by a number: they have the same text.
        nth = Window.partitionBy(*[f"{c}_" for c in key]).orderBy("before")
        placed = self.placed.where("size > 0").join(cuts, ["sid", "before"]).select(
            *[F.col(c).alias(f"{c}_") for c in key], "before", "size", "cuts_"
        )
        placed = placed.select("*", F.row_number().over(nth).alias("nth_")).withColumnRenamed("size", "size_").drop("before")
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        like = Window.partitionBy(F.col("source").cast("string"), F.col("doc_id").cast("long"), F.xxhash64(text)).orderBy(F.lit(1))
        rows = docs.select("*", F.xxhash64(text).alias("of_tie_"), F.row_number().over(like).alias("of_nth_"))
        same = F.col("of_tie_") == F.col("tie_")
        same &= F.col("of_nth_") == F.col("nth_")
        same &= F.col("source").cast("string").eqNullSafe(F.col("source_"))
        same &= F.col("doc_id").cast("long").eqNullSafe(F.col("doc_id_"))
        joined = rows.join(placed, same).select(*docs.columns, "size_", F.explode("cuts_").alias("cut_"))
        text_at, chars_at = (docs.columns.index(c) if c in docs.columns else None for c in ("text", "n_chars"))
        schema = T.StructType(docs.schema.fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(schema)
            for batch in batches:
                columns = list(batch.columns[: len(arrow)])
                taken = [
                    cut_text(raw, size, [(c["from"], c["to"]) for c in cut])
                    for raw, size, cut in zip(
                        raw_texts(columns[text_at]), batch.column(len(arrow)).to_pylist(), batch.column(len(arrow) + 1).to_pylist(), strict=True
                    )
                ]
                columns[text_at] = taken
                if chars_at is not None:
                    columns[chars_at] = [len(t) for t in taken]
                yield record_batch(arrow, *columns)

        return map_batches(joined, run, schema)


def cut_text(text: bytes, size: int, cut: list[tuple[int, int]]) -> str:
    """Words [from, to) of a text of ``size`` words, with what lies between them; a line break between
    stretches that do not meet."""
    joined: list[list[int]] = []
    for begin, end in cut:
        if joined and joined[-1][1] == begin:
            joined[-1][1] = end
        else:
            joined.append([begin, end])
    if joined == [[0, size]]:
        return text.decode()
    spans = [m.span() for m in re.finditer(WORD.encode(), text)]
    return b"\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in joined).decode()
