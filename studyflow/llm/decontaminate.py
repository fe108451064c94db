"""Benchmark decontamination: n-gram seeds find candidate passages, local alignment scores them.

1. The benchmark is taken in blocks of at most BLOCK_WORDS words (and one item more); a block is what is
   broadcast. A benchmark of any size is the union over its blocks.
2. Every word 3-gram of an item is a seed, however often it occurs.
3. One pass looks up the documents' 3-grams among the seeds, turns hits into windows around where the
   item would lie, and aligns item and window by Smith-Waterman over words (match +2, mismatch -1, gap
   -1). Windows that share too few words with the item to reach the score are skipped, which is exact.
   A passage counts if its score is at least ``similarity`` of the score of the item with itself. One
   without a single intact 3-gram of its item is not found, whatever its score.

Each text is handled where it is read: nothing of it is shuffled, so a passage in a third of all
documents weighs on no single task. Words are compared without case and outer punctuation.

Cases: null and empty texts and items match nothing; items with one or two words are their own seeds;
repeated rows give one row per (document, item), the best; a null id is kept as null; empty tables give
no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyflow.llm.common import Codes, map_batches, raw_texts, record_batch, running_sum, stored

GRAM = 3
BLOCK_WORDS = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, 1
SIMILARITY = 0.4
KNOWN_WORDS = 1_000_000
SIEVE_BITS = 22

_OUTER = bytes(c for c in range(128) if not chr(c).isalnum())
_POWERS = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64)) for k in range(GRAM)]


@cache
def word_codes() -> Codes:
    """One table a worker process; its words outlive a task."""
    return Codes(KNOWN_WORDS, lambda w: xxhash.xxh3_64_intdigest(w.strip(_OUTER)))


def grams(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    sums = np.full(n, np.uint64(size), np.uint64)
    for k in range(size):
        sums += words[k : k + n] * _POWERS[k]
    return sums ^ (sums >> np.uint64(31))


class Sieve:
    """Looks up many hashes among few: a bit table first, then a search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.bits = np.zeros(1 << SIEVE_BITS, bool)
        self.bits[(self.keys >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of hashes that are among the keys, and the keys' numbers."""
        at = np.flatnonzero(self.bits[(hashes >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        found = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[found] == hashes[at]
        return at[same], found[same]


class Items:
    """A block of benchmark items as word hashes, and where their grams lie."""

    def __init__(self, ids: list, words: list[np.ndarray]):
        self.ids, self.words = ids, words
        self.sizes = sorted({min(GRAM, len(w)) for w in words})
        self.sorted = [np.sort(w) for w in words]

    def places(self) -> list[tuple[int, int, int]]:
        """(gram hash, item, position) of every gram."""
        return [
            (int(h), k, p) for k, w in enumerate(self.words) for p, h in enumerate(grams(w, min(GRAM, len(w))))
        ]


def item_blocks(items: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks; the driver holds one block at a time."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sized = rows.distinct().withColumn("size", F.octet_length("text").cast("long"))
    placed = running_sum(sized, ["item_id", "text"], "size", "benchmark")
    # A word and the blank after it take two bytes at least.
    blocks = stored(placed.withColumn("block", F.floor(F.col("before") / (2 * BLOCK_WORDS))), "benchmark-blocks")
    for number in range((blocks.agg(F.max("block")).first()[0] or 0) + 1):
        codes, ids, words = word_codes(), [], []
        for row in blocks.where(F.col("block") == number).select("item_id", "text").sort("item_id", "text").toLocalIterator():
            (hashes,) = codes.look_up(row["text"].encode().lower().split())
            if len(hashes):
                ids.append(row["item_id"])
                words.append(hashes)
        if ids:
            yield Items(ids, words)


def all_seeds(items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds as (sorted hashes, first place of each, items, positions)."""
    rows = sorted(items.places())
    hashes, first = np.unique(np.array([r[0] for r in rows], np.uint64), return_index=True)
    return hashes, np.append(first, len(rows)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment score, and where in the window it ends (exclusive)."""
    n = len(window)
    slope = GAP * np.arange(n)
    before, best, end = np.zeros(n + 1, np.int64), 0, 0
    for word in item:
        row = np.where(window == word, MATCH, MISMATCH) + before[:-1]
        np.maximum(row, before[1:] - GAP, out=row)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope) - slope
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at + 1
        before[1:] = row
    return best, end


def passages(words: np.ndarray, items: Items, sieve: Sieve, seeds, similarity: float) -> list[tuple]:
    """(item number, score, first word, end) of one text, the best one an item."""
    _, first, of, position = seeds
    found: dict[int, tuple] = {}
    starts: dict[int, list[int]] = {}
    for size in items.sizes:
        for at, seed in zip(*sieve(grams(words, size)), strict=True):
            for k in range(first[seed], first[seed + 1]):
                starts.setdefault(int(of[k]), []).append(int(at) - int(position[k]))
    for item, begins in starts.items():
        target, known = items.words[item], items.sorted[item]
        m = len(target)
        least = int(np.ceil(similarity * MATCH * m))
        pad = m // 4 + 8
        begins.sort()
        k = 0
        while k < len(begins):
            last = k
            while last + 1 < len(begins) and begins[last + 1] - begins[last] <= pad:
                last += 1
            low, high = max(0, begins[k] - pad), min(len(words), begins[last] + m + pad)
            k = last + 1
            window = words[low:high]
            shared = known[np.minimum(np.searchsorted(known, window), m - 1)] == window
            if MATCH * int(shared.sum()) < least:
                continue
            score, end = align(target, window)
            if score >= least and score > found.get(item, (0, 0))[1]:
                _, back = align(target[::-1], window[:end][::-1])
                found[item] = (item, score, low + end - back, low + end)
    return list(found.values())


def contaminations(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, score, similarity, first_word, end_word), the best passage of a pair."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("item_id", pa.int64()),
            ("score", pa.int64()),
            ("similarity", pa.float64()),
            ("first_word", pa.int64()),
            ("end_word", pa.int64()),
        ]
    )
    columns = "doc_id long, item_id long, score long, similarity double, first_word long, end_word long"

    def finder(shared) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, seeds = shared.value
            codes, sieve = word_codes(), Sieve(seeds[0])
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                    (words,) = codes.look_up(text.lower().split())
                    for item, score, begin, end in passages(words, items, sieve, seeds, similarity):
                        own = score / (MATCH * len(items.words[item]))
                        rows.append((doc_id, items.ids[item], score, own, begin, end))
                if rows:
                    yield record_batch(schema, *zip(*rows, strict=True))

        return run

    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = docs.sparkSession.createDataFrame([], columns)
    for items in item_blocks(benchmark):
        shared = context.broadcast((items, all_seeds(items)))
        found = found.unionByName(map_batches(rows, finder(shared), columns))
    best = F.max(F.struct("score", "similarity", (-F.col("first_word")).alias("back"), "end_word")).alias("best")
    return (
        found.groupBy("doc_id", "item_id")
        .agg(best)
        .select("doc_id", "item_id", "best.score", "best.similarity", (-F.col("best.back")).alias("first_word"), "best.end_word")
    )
