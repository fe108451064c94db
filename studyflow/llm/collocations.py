"""Phrase collocations: frequent word n-grams by Misra-Gries summaries, counted exactly, scored and ranked per language.

First pass. Every task hashes the 1- to ``max_words``-grams of its texts (64 bits, language included), counts equal ones
and sends the counts, packed, to the hash partition they belong to. A partition keeps a Misra-Gries summary: counters in
sorted arrays, into which packed counts are merged; when there are more counters than its capacity, the largest value
that makes room is taken off all of them. What was taken off in all (the summary's error) times (capacity + 1) is no
more than the mass that went through the partition, so a capacity above mass / threshold leaves the error below the
threshold, and every n-gram that occurs ``threshold`` times keeps a counter. The number of partitions follows the size
of the input so that CAPACITY exceeds mass / threshold; the error itself is known and checked, and should a partition
exceed it, the pass is done again with twice the partitions. n-grams whose counter plus error stays below the threshold
are not survivors.

Second pass. Texts are read again and the n-grams whose hash is among the survivors' are counted as texts, exactly: equal
hashes of different phrases are told apart. A filter of FILTER_BITS bits, broadcast (its size is fixed), tells which hashes
may have survived; what it lets through in vain is dropped by its exact count. Words of a batch are numbered, so
counting within a batch compares integers, exactly.

Scores use decimals of 38 digits: with counts up to 10^15 every product is exact.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count each time; whole
texts are read; n-grams do not cross pieces or texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from studyflow.llm.common import Codes, map_batches, raw_texts, record_batch, stored

UNKNOWN = "und"
MAX_WORDS = 3
THRESHOLD = 10
#: 100 * f(longer) >= ABSORBED * f(phrase): the phrase is part of the longer one.
ABSORBED = 50
TOP = 2000
#: Counters of a hash partition: 16 bytes each.
CAPACITY = 1 << 20
#: n-grams held before their counts are sent on.
HELD = 1 << 21
#: Bytes of text worked on at a time.
SLICE = 1 << 20
#: Bits of the broadcast filter of survivors: 8 MB.
FILTER_BITS = 1 << 26
#: Words known at a time.
MAX_KNOWN = 1 << 18

# The characters that end a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
_TO_STOP = bytes(ord(".") if c in ENDS else c for c in range(256))


class Words(Codes):
    """Word numbers and hashes for the life of a worker process; the stop that ends a piece is a word of its own."""

    def __init__(self):
        super().__init__(MAX_KNOWN, lambda w: xxhash.xxh64_intdigest(w, seed=11))

    def numbered(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number and hash of every word; numbers hold for one batch."""
        if len(self) > self.limit:
            self.clear()
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return codes, self.values[0][codes]


_words: Words | None = None


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Batch:
    """The words of some texts, in lower case and with stops for all ends of pieces: ``words``, their ``hashes`` (language included), their ``codes`` (equal for equal
    words of a language), ``langs`` by number, and ``open``: how many words follow in the same piece, itself included."""

    def __init__(self, texts: list[bytes], langs: list[str | None]):
        global _words
        _words = _words or Words()
        self.words: list[bytes] = []
        counts = []
        for text in texts:
            found = text.replace(b".", b" . ").split()
            found.append(b".")
            counts.append(len(found))
            self.words += found
        self.names = sorted({x if x is not None else UNKNOWN for x in langs})
        of = {x: k for k, x in enumerate(self.names)}
        numbers = np.fromiter((of[x if x is not None else UNKNOWN] for x in langs), np.int32, len(langs))
        self.langs = np.repeat(numbers, counts)
        codes, hashes = _words.numbered(self.words)
        self.codes = codes | (self.langs.astype(np.int64) << 32)
        seeds = np.array([xxhash.xxh64_intdigest(x.encode(), seed=5) for x in self.names], np.uint64)
        self.stops = codes == _words[b"."]
        n = len(hashes)
        at = np.arange(n)
        next_stop = np.where(self.stops, at, n)
        next_stop = np.minimum.accumulate(next_stop[::-1])[::-1]
        self.open = next_stop - at
        self.hashes = hashes ^ seeds[self.langs] if n else hashes

    def grams(self, max_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: where the n-grams begin, and their hashes."""
        running = self.hashes
        for k in range(1, max_words + 1):
            if k > 1:
                running = mixed(running[:-1], self.hashes[k - 1 :])
            starts = np.flatnonzero(self.open[: len(running)] >= k)
            yield k, starts, running[starts] ^ np.uint64(k * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)


def merged(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal hashes once, in order, their counts added."""
    every, number = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, number = every[order], number[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    return every[first], np.add.reduceat(number, first) if len(first) else number


class Summary:
    """A mergeable Misra-Gries summary. ``error``: what was taken off every counter so far."""

    def __init__(self, capacity: int):
        self.capacity, self.error, self.mass = capacity, 0, 0
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, hashes: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.mass += int(sum(c.sum() for c in counts))
        self.hashes, self.counts = merged([self.hashes, *hashes], [self.counts, *counts])
        over = len(self.counts) - self.capacity
        if over > 0:
            # The (capacity + 1)-th largest counter goes to zero.
            off = int(np.partition(self.counts, over - 1)[over - 1])
            kept = self.counts > off
            self.hashes, self.counts = self.hashes[kept], self.counts[kept] - off
            self.error += off

    def survivors(self, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        kept = self.counts + self.error >= threshold
        return self.hashes[kept], self.counts[kept]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    """Texts in slices of about SLICE bytes. Longer texts are cut where a piece ends, which cuts no n-gram."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for text, lang in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            text, start = text.lower().translate(_TO_STOP), 0
            while start < len(text):
                cut = len(text) if len(text) - start <= SLICE else text.find(b".", start + SLICE) + 1
                end = cut or len(text)
                texts.append(text[start:end])
                langs.append(lang)
                size, start = size + end - start, end
                if size >= SLICE:
                    yield Batch(texts, langs)
                    texts, langs, size = [], [], 0
    if texts:
        yield Batch(texts, langs)


def summaries(docs: DataFrame, bits: int, threshold: int, max_words: int, capacity: int) -> DataFrame:
    """Survivors (``hash``, ``counter``) of 2^bits hash partitions, with the ``error`` and ``mass`` of each partition's
    summary in a row of its own (null hash)."""
    packed = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("hashes", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("hash", "counter", "error", "mass")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(packed)
        held: list[np.ndarray] = []

        def send() -> Iterator[pa.RecordBatch]:
            hashes, counts = merged(held, [np.ones(len(h), np.int64) for h in held])
            held.clear()
            buckets = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
            first = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
            ends = [*first[1:], len(hashes)]
            # Most counts are small: four bytes hold those of a task's share of the texts.
            rows = [(int(buckets[a]), hashes[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()) for a, b in zip(first, ends, strict=True)]
            for k in range(0, len(rows), 256):
                yield record_batch(arrow, *map(list, zip(*rows[k : k + 256], strict=True)))

        for batch in _batches(batches):
            held += [h for _, _, h in batch.grams(max_words) if len(h)]
            if sum(map(len, held)) >= HELD:
                yield from send()
        if held:
            yield from send()

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        bucket, summary, hashes, counts = None, None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if summary is not None:
                summary.merge(hashes, counts)
                found, counters = summary.survivors(threshold)
                nothing = pa.nulls(len(found), pa.int64())
                yield record_batch(arrow, found.view(np.int64), counters, nothing, nothing)
                none = pa.nulls(1, pa.int64())
                yield record_batch(arrow, none, none, [summary.error], [summary.mass])

        for batch in batches:
            for b, h, c in zip(*(batch.column(k) for k in range(3)), strict=True):
                if b.as_py() != bucket:
                    yield from close()
                    bucket, summary, hashes, counts = b.as_py(), Summary(capacity), [], []
                hashes.append(np.frombuffer(h.as_buffer(), np.uint64))
                counts.append(np.frombuffer(c.as_buffer(), np.uint32).astype(np.int64))
                if sum(map(len, hashes)) >= capacity:
                    summary.merge(hashes, counts)
                    hashes, counts = [], []
        yield from close()

    partial = map_batches(_texts(docs), count, packed)
    dealt = partial.repartition(1 << bits, "bucket").sortWithinPartitions("bucket")
    return map_batches(dealt, summarise, out)


def survivors(docs: DataFrame, threshold: int = THRESHOLD, max_words: int = MAX_WORDS, capacity: int = CAPACITY) -> DataFrame:
    """Hashes of n-grams, among them all that occur ``threshold`` times, with their counters."""
    size = docs.select(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("n")).first()["n"]
    # A word takes two bytes at least, so the mass is at most max_words * size / 2.
    bits = max(0, int(np.ceil(np.log2(max(1.0, max_words * size / 2 / threshold / capacity)))))
    while True:
        found = stored(summaries(docs, bits, threshold, max_words, capacity), "summaries")
        worst = found.where("hash is null").agg(F.max("error")).first()[0] or 0
        if worst < threshold:
            return found.where("hash is not null").select("hash", "counter")
        bits += 1


def bit_filter(found: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit per slot of hashes: set where a survivor falls. At most ``bits`` / 64 words come to the driver."""
    slot = F.shiftrightunsigned("hash", 64 - int(np.log2(bits)))
    words = (
        found.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).cast("int").alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("word"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.int64)
    out[words["at"].to_numpy()] = words["word"].to_numpy()
    return out.view(np.uint64)


def phrase_counts(docs: DataFrame, threshold: int = THRESHOLD, max_words: int = MAX_WORDS, capacity: int = CAPACITY) -> DataFrame:
    """``lang``, ``phrase`` (words joined by a blank), ``n_words`` and ``f`` of all n-grams that occur ``threshold``
    times in a language; and a row of ``n_words`` 0 per language with the number of all its words."""
    bits = bit_filter(survivors(docs, threshold, max_words, capacity))
    shift = np.uint64(64 - int(np.log2(len(bits) * 64)))
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    schema = T.StructType([T.StructField(c, t) for c, t in (("lang", T.StringType()), ("phrase", T.StringType()), ("n_words", T.IntegerType()), ("f", T.LongType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        known = shared.value
        for batch in _batches(batches):
            every = np.bincount(batch.langs[~batch.stops], minlength=len(batch.names))
            yield record_batch(arrow, batch.names, [""] * len(every), np.zeros(len(every), np.int32), every)
            _, codes = np.unique(batch.codes, return_inverse=True)
            running = codes
            for k, starts, hashes in batch.grams(max_words):
                if k > 1:
                    # Numbers of (n - 1)-grams and of words stay below 2^32: their pair is exact in 64 bits.
                    _, running = np.unique(running[:-1] * np.int64(1 << 32) + codes[k - 1 :], return_inverse=True)
                slots = hashes >> shift
                may = (known[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1)
                starts = starts[may.astype(bool)]
                if not len(starts):
                    continue
                _, first, number = np.unique(running[starts], return_index=True, return_counts=True)
                at = starts[first].tolist()
                words = batch.words
                phrases = [b" ".join(words[s : s + k]).decode() for s in at] if k > 1 else [words[s].decode() for s in at]
                langs = pa.array(batch.names, pa.string()).take(pa.array(batch.langs[at]))
                yield record_batch(arrow, langs, phrases, np.full(len(at), k, np.int32), number)

    counted = map_batches(_texts(docs), count, schema).groupBy("lang", "phrase", "n_words").agg(F.sum("f").alias("f"))
    return stored(counted.where((F.col("f") >= threshold) | ((F.col("n_words") == 0) & (F.col("f") > 0))), "phrase-counts")


def exact(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def collocations(
    docs: DataFrame,
    threshold: int = THRESHOLD,
    max_words: int = MAX_WORDS,
    absorbed: int = ABSORBED,
    top: int = TOP,
    capacity: int = CAPACITY,
) -> DataFrame:
    """The ``top`` phrases of 2 to ``max_words`` words of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = phrase_counts(docs, threshold, max_words, capacity)
    totals = counts.where("n_words = 0").select("lang", F.col("f").alias("n"))
    phrases = counts.where("n_words > 0")
    candidates = phrases.where("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    size = F.size(words)

    def part(first: Column, length: Column) -> Column:
        return F.array_join(F.slice(words, first, length), " ")

    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1))).select(
        "lang", "phrase", "n_words", "a", "k",
        part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, size - F.col("k")).alias("right"),
    )
    known = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(known.toDF("lang", "left", "l"), ["lang", "left"]).join(known.toDF("lang", "right", "r"), ["lang", "right"])
    # a * a * 10^6 needs 38 digits at most; the quotient is at most 10^6, since no part is rarer than the phrase.
    cuts = cuts.withColumn("square_", exact("a") * exact("a") * F.lit(1000000).cast("decimal(7,0)")).withColumn(
        "product_", exact("l") * exact("r")
    )
    scored = (
        cuts.withColumn("score", F.expr("square_ div product_"))
        .groupBy("lang", "phrase", "n_words", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "n_words", "a", "cut.l", "cut.r", "cut.score")
    )
    # Every shorter run of a candidate's words, with the greatest f of a candidate that holds it.
    lengths = F.sequence(F.lit(2), F.col("n_words") - 1)
    held = (
        candidates.where("n_words > 2")
        .withColumn("size_", F.explode(lengths))
        .withColumn("first_", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("size_") + 1)))
        .select("lang", part(F.col("first_"), F.col("size_")).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    kept = scored.join(held, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * exact("longer") < absorbed * exact("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (
        kept.withColumn("rank", F.row_number().over(order).cast("bigint"))
        .where(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


SQL = rf"""
with pieces as (
    select lang, piece as text from (
        select coalesce(lang, '{UNKNOWN}') as lang,
            unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) as piece
        from documents)
), lists as (
    select lang, list_filter(string_split_regex(text, '[\x20\x09]+'), lambda w: w <> '') as words from pieces
), grams as (
    select lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: list_aggregate(words[i:i + k - 1], 'string_agg', ' '))) as phrase
    from lists, (values (1), (2), (3)) lengths(k) where len(words) >= k
), counts as (
    select lang, k, phrase, count(*) as f from grams group by all
), totals as (
    select lang, sum(f)::bigint as n from counts where k = 1 group by lang
), candidates as (
    select lang, k, phrase, f as a, string_split(phrase, ' ') as words from counts where k > 1 and f >= {THRESHOLD}
), cuts as (
    select lang, phrase, k, a, words, p, array_to_string(words[1:p], ' ') as head, array_to_string(words[p + 1:k], ' ') as tail
    from candidates, (values (1), (2)) places(p) where p < k
), scored as (
    select c.lang, c.phrase, c.a, c.p, h.f as l, t.f as r, (1000000::hugeint * c.a * c.a) // (h.f::hugeint * t.f) as score
    from cuts c
    join counts h on h.lang = c.lang and h.phrase = c.head and h.k = c.p
    join counts t on t.lang = c.lang and t.phrase = c.tail and t.k = c.k - c.p
), lowest as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, p) = 1
), held as (
    select lang, part, max(a) as longer from (
        select lang, a, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) as part from candidates where k = 3
    ) group by all
), ranked as (
    select s.*, row_number() over (partition by s.lang order by s.score desc, s.a desc, s.phrase) as rank
    from lowest s left join held h on h.lang = s.lang and h.part = s.phrase
    where h.longer is null or 100 * h.longer < {ABSORBED} * s.a
)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join totals using (lang) where rank <= {TOP}
"""
