"""Exact self-join on Jaccard similarity of word 5-gram sets, and its connected components.

Two documents link if 100 * intersection >= 80 * union of their sets of distinct 5-word shingles. The
join keeps an inverted index over set prefixes and skips along two kinds of set relations:

* Equal sets are one class, represented by its smallest document.
* Highly similar sets form a cluster around a pivot, found by MinHash bands and an estimate of 0.9. The
  estimate only groups; every figure that decides is exact. The index lists hold a cluster once.
* Index lists are matched token by token. An entry's place in its set bounds the overlap that the rest
  of both sets can still give, so entries too far apart in place or size are skipped unseen; pairs
  must then share as many prefix tokens as sets of their sizes have to.
* A cluster's answers come from its pivot's: if the pivots of two clusters are farther apart than 0.2
  and both radii (Jaccard distance is a metric), no member can link, and none is looked at. If they
  link, so are the members linked to them one component; a member that is not (a stray) may still link
  to one of the other cluster. What lies between, and strays, are compared member by member.
* A set moves to the cluster of a hub that it links to exactly: of the sets that lead the lists it is in, by
  their share of tokens that no other prefix has, the one it has most in common with. So most of a large
  loose group is one cluster, compared with its hub alone.
* Those tokens are lost to any overlap: pairs in which the set whose prefix ends first has lost too many are
  skipped. Parities of shingles on 256 bits rule out most other pairs of members. Both bounds are exact.

Tokens are ordered by how often their hash bucket occurs in the corpus (2**18 counters), rare ones first,
so that widely shared passages stay out of prefixes. All pairs within a group are never made.

Cases: A-Z and a-z are alike; texts with fewer than five words are one shingle; null and empty texts have
empty sets, linked with nothing; a null id is linked with nothing and has no component; rows that
repeat an id are one document with several sets, linked if any is; an empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyflow.llm.common import Codes, map_batches, raw_texts, record_batch, stored

SHINGLE = 5
KNOWN_WORDS = 400_000
#: 18 bits of a shingle hash choose its counter.
COUNTER_BITS = 18
BANDS, BAND_ROWS = 4, 8
ALIKE = 0.9
#: A set is compared with a hub from this estimate on; a link of 0.8 is below it once in 10**5.
LIKELY = 0.5
#: Pairs must share so many prefix tokens, or as many as their sizes demand.
SHARED = 3
FILTER_BITS = 24
LIMITS = ["low", "high", "spare", "end_first", "end_last"]
PARITY = ["size", "parity"]
#: Linked sets are at most so far apart (and a hair more, for rounding).
REACH = 0.2 + 1e-9

_MASK = np.uint64((1 << COUNTER_BITS) - 1)
_REST = np.uint64(COUNTER_BITS)
_TOP = np.uint64(64 - COUNTER_BITS)
_SIGN = np.uint64(1 << 63)
_POWERS = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(SHINGLE)]
_ODD = np.random.default_rng(11).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, codes: Codes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    (words,) = codes.look_up(text.lower().split())
    if not len(words):
        return words
    n = max(1, len(words) - SHINGLE + 1)
    sums = np.full(n, np.uint64(min(len(words), SHINGLE)), np.uint64)
    for k in range(min(len(words), SHINGLE)):
        sums += words[k : k + n] * _POWERS[k]
    hashes = np.sort(spread(sums))
    return hashes[np.append(True, hashes[1:] != hashes[:-1])]


@cache
def word_codes() -> Codes:
    """One table a worker process; its words outlive a task."""
    return Codes(KNOWN_WORDS, xxhash.xxh3_64_intdigest)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, s1, s2, bands, minhash) of every document, and from every task one row of its counters:
    (counter, times)."""
    schema = pa.schema(
        [
            ("counts", pa.bool_()),
            ("doc_id", pa.int64()),
            ("n", pa.int64()),
            ("s1", pa.int64()),
            ("s2", pa.int64()),
            ("bands", pa.list_(pa.int64())),
            ("minhash", pa.list_(pa.int32())),
            ("counter", pa.list_(pa.int32())),
            ("times", pa.list_(pa.int64())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counters = word_codes(), np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            rows, seen = [], []
            for text in raw_texts(batch.column(1)):
                hashes = shingles(text, codes)
                if not len(hashes):
                    rows.append((0, 0, 0, [], []))
                    continue
                seen.append((hashes & _MASK).astype(np.int32))
                least = np.array([(hashes * odd).min() for odd in _ODD])
                bands = [xxhash.xxh3_64_intdigest(b.tobytes()) for b in least.reshape(BANDS, BAND_ROWS)]
                sums = [hashes.sum(), (spread(hashes ^ _POWERS[0])).sum()]
                rows.append(
                    (
                        len(hashes),
                        *np.array(sums, np.uint64).view(np.int64).tolist(),
                        np.array(bands, np.uint64).view(np.int64),
                        (least >> np.uint64(32)).astype(np.uint32).view(np.int32),
                    )
                )
            if seen:
                counters += np.bincount(np.concatenate(seen), minlength=len(counters))
            none = [None] * len(rows)
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield record_batch(schema, [False] * len(rows), batch.column(0), *columns, none, none)
        at = np.flatnonzero(counters)
        yield record_batch(schema, [True], *[[None]] * 6, [at.astype(np.int32)], [counters[at]])

    return map_batches(
        _texts(docs),
        run,
        "counts boolean, doc_id long, n long, s1 long, s2 long, bands array<long>, minhash array<int>, "
        "counter array<int>, times array<long>",
    )


def counter_ranks(table: DataFrame) -> np.ndarray:
    """Each counter's rank, rarest first: 2**18 numbers, whatever the corpus."""
    found = (
        table.where("counts")
        .select(F.explode(F.arrays_zip("counter", "times")).alias("c"))
        .groupBy("c.counter")
        .agg(F.sum("c.times").alias("times"))
        .toArrow()
    )
    totals = np.zeros(1 << COUNTER_BITS, np.int64)
    totals[found["counter"].to_numpy()] = found["times"].to_numpy()
    ranks = np.empty(len(totals), np.uint64)
    ranks[np.argsort(totals, kind="stable")] = np.arange(len(totals), dtype=np.uint64)
    return ranks


def classes(table: DataFrame) -> DataFrame:
    """(n, s1, s2, rep, bands, minhash): one row for each different non-empty set."""
    best = F.min(F.struct("doc_id", "bands", "minhash")).alias("best")
    return (
        table.where("NOT counts AND n > 0 AND doc_id IS NOT NULL")
        .groupBy("n", "s1", "s2")
        .agg(best)
        .select("n", "s1", "s2", F.col("best.doc_id").alias("rep"), "best.bands", "best.minhash")
    )


def clusters(sets: DataFrame) -> DataFrame:
    """(rep, cluster): the pivot that a set is grouped under, mostly itself."""
    banded = sets.select("rep", F.posexplode("bands").alias("band", "value"))
    pivots = banded.groupBy("band", "value").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last"))
    pivots = pivots.where("last > pivot").drop("last")
    first = stored(
        banded.join(pivots, ["band", "value"]).groupBy("rep").agg(F.min("pivot").alias("pivot")).where("pivot < rep"),
        "pivots",
    )
    # A pivot that has a pivot itself hands its sets on.
    onward = first.select(F.col("rep").alias("pivot"), F.col("pivot").alias("next"))
    claimed = first.join(onward, "pivot", "left").select("rep", F.coalesce("next", "pivot").alias("pivot"))
    claimed = claimed.join(first.select(F.col("rep").alias("pivot")), "pivot", "left_anti")
    return alike(claimed, "pivot", sets, ALIKE).groupBy("rep").agg(F.min("pivot").alias("cluster"))


def among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is in ``ids`` (one column), and few others: a bounded first look, never the last word.

    Of 2**24 bits one is set for each id's hash. They are broadcast, so that other rows are left out before a shuffle.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    words = (
        ids.toDF("id")
        .select(bit("id").alias("bit"))
        .selectExpr("CAST(shiftright(bit, 6) AS INT) AS word_", "shiftleft(1L, CAST(bit % 64 AS INT)) AS one")
        .groupBy("word_")
        .agg(F.bit_or("one").alias("bits_"))
    )
    found = rows.join(F.broadcast(words), F.shiftright(bit(key), 6).cast("int") == F.col("word_"))
    return found.where(F.getbit("bits_", bit(key) % 64) == 1).drop("word_", "bits_")


def alike(pairs: DataFrame, other: str, sets: DataFrame, least: float) -> DataFrame:
    """(rep, ``other``) of ``pairs`` for which so many MinHash values are equal."""
    hashes = sets.select("rep", "minhash")
    mine = among(hashes, "rep", pairs.select("rep"))
    theirs = among(hashes, "rep", pairs.select(other)).toDF(other, "others")
    same = F.size(F.filter(F.zip_with("minhash", "others", lambda a, b: a == b), lambda x: x))
    both = pairs.join(mine, "rep").join(theirs, other)
    return both.where(same >= int(np.ceil(least * BANDS * BAND_ROWS))).select("rep", other)


def prefixes(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """(doc_id, n, tokens): the first tokens of each set, rarest counters first."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, order = word_codes(), shared.value
        for batch in batches:
            sizes, tokens = [], []
            for text in raw_texts(batch.column(1)):
                hashes = shingles(text, codes)
                n = len(hashes)
                length = min(n, n - -(-4 * n // 5) + SHARED)
                # Counter ranks differ, so this is the hash in another order of its bits: nothing is lost. The
                # sign bit is turned, so that Spark compares tokens in the same order.
                keys = np.sort((order[hashes & _MASK] << _TOP) | (hashes >> _REST))
                sizes.append(n)
                tokens.append((keys[:length] ^ _SIGN).view(np.int64))
            yield record_batch(schema, batch.column(0), sizes, tokens)

    return map_batches(_texts(docs).where("doc_id IS NOT NULL"), run, "doc_id long, n long, tokens array<long>")


def needed(n: Column, m: Column) -> Column:
    """Shingles that linked sets of n and m share at least."""
    return F.ceil((n + m) * 4 / F.lit(9.0) - 1e-9)


def shared_entries(kept: DataFrame) -> DataFrame:
    """(rep, n, end, spare, hits) of each set: hits are (place, token) of prefix tokens that more than one entry has.

    ``end`` is the set's last prefix token. Of two sets, all prefix tokens of the one that ends first would be in
    the other's prefix too if they were in its set. So its tokens that no other prefix has are lost to the overlap,
    and a link needs ``spare`` = 5 n - 9 (lost tokens) >= 4 (size of the other).
    """
    entries = kept.select("rep", "n", F.element_at("tokens", -1).alias("end"), F.posexplode("tokens").alias("place", "token"))
    times = F.count("*").over(Window.partitionBy("token"))
    shared = entries.withColumn("times", times).where("times > 1")
    sets = shared.groupBy("rep", "n", "end").agg(F.collect_list(F.struct("place", "token")).alias("hits"))
    n = F.col("n")
    length = F.least(n, n - F.ceil(n * 4 / F.lit(5.0) - 1e-9) + SHARED)
    # Linked sets share so many tokens of their prefixes.
    enough = F.size("hits") >= F.least(F.lit(SHARED), needed(n, F.floor(n * 0.8)))
    return sets.where(enough).select("rep", "n", "end", (n * 5 - (length - F.size("hits")) * 9).alias("spare"), "hits")


def bounds() -> list[Column]:
    """LIMITS of a group of entries."""
    return [
        F.min("n").alias("low"),
        F.max("n").alias("high"),
        F.max("spare").alias("spare"),
        F.min("end").alias("end_first"),
        F.max("end").alias("end_last"),
    ]


def may_link(a: str, b: str) -> Column:
    """Whether sizes, spare tokens and ends leave a link between some of the sets of either side possible."""
    of = lambda side, name: F.col(f"{side}_{name}")
    sizes = (of(a, "high") * 5 >= of(b, "low") * 4) & (of(b, "high") * 5 >= of(a, "low") * 4)
    first = (of(a, "spare") >= of(b, "low") * 4) & (of(a, "end_first") <= of(b, "end_last"))
    second = (of(b, "spare") >= of(a, "low") * 4) & (of(b, "end_first") <= of(a, "end_last"))
    return sizes & (first | second)


def close(a: str, b: str) -> Column:
    """Whether parities leave a link possible: bits in which they differ are no more than the shingles that one set
    has and the other has not, of which linked sets have a ninth of both sizes at most."""
    bits = [F.bit_count(F.col(f"{a}_parity")[k].bitwiseXOR(F.col(f"{b}_parity")[k])) for k in range(4)]
    return F.coalesce((bits[0] + bits[1] + bits[2] + bits[3]) * 9 <= F.col(f"{a}_size") + F.col(f"{b}_size"), F.lit(True))


def claims(shared: DataFrame) -> DataFrame:
    """(rep, hub): for each set the one that it shares most prefix tokens with, among the sets that lead a token's
    list by the smallest share of lost tokens. One row a set, however long the lists."""
    central = F.struct((-F.col("spare") / F.col("n")).alias("lost"), (-F.col("n")).alias("size"), F.col("rep").alias("hub"))
    entries = shared.select("rep", "n", "spare", F.explode("hits.token").alias("token"))
    led = entries.select("rep", F.min(central).over(Window.partitionBy("token")).alias("lead"))
    counts = led.where("rep <> lead.hub").groupBy("rep", "lead").agg(F.count("*").alias("common"))
    lead = F.struct("common", (-F.col("lead.lost")).alias("lost"), F.col("lead.size"), F.col("lead.hub"))
    best = counts.groupBy("rep").agg(F.max(lead).alias("best"), F.max_by("lead", lead).alias("lead"))
    own = shared.groupBy(F.col("rep").alias("of")).agg(F.min(central).alias("mine"))
    # Only towards the middle, so that no two claim each other.
    return best.join(own, F.col("rep") == F.col("of")).where("lead < mine").select("rep", F.col("lead.hub").alias("hub"))


def regrouped(grouped: DataFrame, claimed: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, cluster): sets that link to their hub, or to its hub, go to its cluster; others stay with a pivot that stays.

    Most sets only share a passage with their hub: whole sets are made where the estimate is not far below a link.
    """
    onward = claimed.select(F.col("rep").alias("hub"), F.col("hub").alias("next"))
    far = onward.select(F.col("hub").alias("next"), F.col("next").alias("last"))
    reached = claimed.join(onward, "hub", "left").join(far, "next", "left")
    wanted = reached.select("rep", F.explode(F.array("hub", "next", "last")).alias("hub")).where("hub IS NOT NULL").distinct()
    wanted = alike(stored(wanted, "wanted"), "hub", sets, LIKELY).distinct()
    pairs = stored(wanted.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"), "rep", "hub"), "claims")
    whole = stored(whole_sets(docs, pairs.select("a").union(pairs.select("b"))), "claim-sets")
    near = similarities(pairs.select("a", "b").distinct(), whole).where("linked").drop("linked")
    found = stored(pairs.join(near, ["a", "b"]).select("rep", "hub", "distance"), "claimed")
    # The hub that most sets link to; hubs that follow no other keep their place.
    weight = found.groupBy("hub").agg(F.count("*").alias("weight"))
    ranked = found.join(weight, "hub")
    order = F.struct("weight", (-F.col("hub")).alias("least"))
    choice = ranked.groupBy("rep").agg(F.max(order).alias("best"))
    own = weight.select(F.col("hub").alias("of"), order.alias("mine"))
    choice = choice.join(own, F.col("rep") == F.col("of"), "left").where("mine IS NULL OR best > mine")
    choice = stored(choice.select("rep", (-F.col("best.least")).alias("cluster")), "choice")
    taken = choice.select(F.col("rep").alias("cluster"))
    moved = choice.join(taken, "cluster", "left_anti").select("rep", "cluster")
    gone = moved.select("rep")
    rest = grouped.join(gone, "rep", "left_anti").join(gone.select(F.col("rep").alias("cluster")), "cluster", "left_anti")
    # A hub that was a member leaves its cluster; a pivot that becomes a hub keeps its members.
    hubs = moved.select(F.col("cluster").alias("rep")).distinct()
    rest = rest.join(hubs, "rep", "left_anti").select("rep", "cluster")
    return moved.unionByName(rest)


def candidates(postings: DataFrame) -> DataFrame:
    """(a, b) of clusters, a < b, from (token, cluster, first, last and bounds): sizes and places of members
    as ranges. Lists are matched by token; entries that rule a link out are skipped."""
    left = postings.select("token", *[F.col(c).alias(f"a_{c}") for c in postings.columns if c != "token"])
    right = postings.select("token", *[F.col(c).alias(f"b_{c}") for c in postings.columns if c != "token"])
    c = F.col
    # Shared before this token: at most the smaller place. From it on: at most what either set has left.
    before = F.least("a_last", "b_last")
    after = F.least(c("a_high") - c("a_first"), c("b_high") - c("b_first"))
    least = needed(c("a_low"), c("b_low"))
    return (
        left.join(right, "token")
        .where((c("a_cluster") < c("b_cluster")) & may_link("a", "b") & (before + after >= least))
        .groupBy(c("a_cluster").alias("a"), c("b_cluster").alias("b"))
        .agg(F.count("*").alias("shared"), F.min(least).alias("least"))
        .where(c("shared") >= F.least(F.lit(SHARED), c("least")))
        .select("a", "b")
    )


def parities(hashes: np.ndarray) -> np.ndarray:
    """256 bits: whether an odd number of the set's shingles falls on each."""
    odd = np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def whole_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n, hashes, parity) of the documents in ``ids`` (and of few others, whose bit is the same)."""
    schema = pa.schema(
        [("id", pa.int64()), ("n", pa.int64()), ("hashes", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = word_codes()
        for batch in batches:
            sets = [shingles(text, codes) for text in raw_texts(batch.column(1))]
            hashes, odd = [s.view(np.int64) for s in sets], [parities(s) for s in sets]
            yield record_batch(schema, batch.column(0), [len(s) for s in sets], hashes, odd)

    rows = among(_texts(docs).where("doc_id IS NOT NULL"), "doc_id", ids)
    return map_batches(rows, run, "id long, n long, hashes array<long>, parity array<long>")


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, linked, distance) of pairs, exactly; of several sets of an id the nearest. Only sets in pairs are shuffled."""
    sets = sets.select("id", "n", "hashes")
    mine = among(sets, "id", pairs.select("a")).toDF("a", "a_n", "a_set")
    theirs = among(sets, "id", pairs.select("b")).toDF("b", "b_n", "b_set")
    both = F.size(F.array_intersect("a_set", "b_set"))
    return (
        pairs.join(mine, "a")
        .join(theirs, "b")
        .select("a", "b", "a_n", "b_n", both.alias("both"))
        .groupBy("a", "b")
        .agg(
            F.max(F.col("both") * 9 >= (F.col("a_n") + F.col("b_n")) * 4).alias("linked"),
            F.min(1 - F.col("both") / (F.col("a_n") + F.col("b_n") - F.col("both"))).alias("distance"),
        )
    )


def components(links: DataFrame) -> DataFrame:
    """(id, component) of linked ids: the smallest id takes over its neighbours, and ids jump to the
    component of their component, until nothing changes."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stored(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "id"), "components")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", "component", F.least("component", "near").alias("lower"))
        target = labels.select(F.col("id").alias("lower"), F.col("component").alias("jump"))
        moved = stored(
            lower.join(target, "lower").select("id", F.least("lower", "jump").alias("component"), F.col("component").alias("was")),
            "components",
        )
        labels = moved.select("id", "component")
        if moved.where("component <> was").isEmpty():
            return labels


def linked_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    table = stored(signatures(docs), "signatures")
    sets = stored(classes(table), "sets")
    kept = prefixes(docs, counter_ranks(table)).join(sets.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi")
    shared = stored(shared_entries(kept.withColumnRenamed("doc_id", "rep")), "shared")
    first = stored(clusters(sets), "clusters")
    grouped = stored(regrouped(first, stored(claims(shared), "hubs"), sets, docs), "regrouped")
    members = grouped.select("rep", "cluster").union(
        grouped.select(F.col("cluster").alias("rep"), "cluster").distinct()
    )
    members = stored(members, "members")
    known = sets.select("rep").distinct().join(members, "rep", "left").select("rep", F.coalesce("cluster", "rep").alias("cluster"))
    known = stored(known, "known")

    postings = (
        shared.join(known, "rep")
        .select("cluster", "n", "end", "spare", F.inline("hits"))
        .repartition("token")
        .groupBy("token", "cluster")
        .agg(F.min("place").alias("first"), F.max("place").alias("last"), *bounds())
    )
    # Most lists are of one cluster.
    several = postings.withColumn("clusters", F.count("*").over(Window.partitionBy("token"))).where("clusters > 1")
    found = stored(candidates(stored(several.drop("clusters"), "postings")), "candidates")

    spokes = grouped.select(F.col("cluster").alias("a"), F.col("rep").alias("b"))
    pairs = stored(found.union(spokes), "pairs")
    ids = pairs.select("a").union(pairs.select("b")).union(members.select("rep"))
    whole = stored(whole_sets(docs, ids), "whole-sets")
    checked = stored(similarities(pairs, whole), "checked")

    offs = checked.join(spokes, ["a", "b"], "left_semi").select(F.col("b").alias("rep"), F.col("distance").alias("off"), "linked")
    limits = shared.groupBy("rep").agg(*bounds())
    # Of an id with several sets nothing is told by one of them.
    odd = whole.groupBy(F.col("id").alias("rep")).agg(
        F.when(F.count("*") == 1, F.first("n")).alias("size"), F.when(F.count("*") == 1, F.first("parity")).alias("parity")
    )
    placed = known.join(offs, "rep", "left").join(limits, "rep", "left").join(odd, "rep", "left").select(
        "rep", "cluster", F.coalesce("off", F.lit(0.0)).alias("off"), F.coalesce("linked", F.lit(True)).alias("linked"),
        *LIMITS, *PARITY,
    )
    placed = stored(placed, "placed")
    links = checked.where("linked").select("a", "b")
    # Few members do not link to their pivot; they may to others of its cluster.
    links = links.union(linked_pairs(stray_pairs(placed), whole))
    placed = with_components(placed, components(links))
    # Linked pivots say nothing of strays: those clusters are opened too, unless all of both are one component.
    near = checked.join(spokes, ["a", "b"], "left_anti")
    links = links.union(linked_pairs(member_pairs(open_pairs(near, placed), placed), whole))
    joined = components(links)

    found_sets = sets.select("n", "s1", "s2", "rep").join(joined, F.col("rep") == F.col("id"), "left")
    found_sets = found_sets.select("n", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    rows = table.where("NOT counts").select("doc_id", "n", "s1", "s2")
    return rows.join(found_sets, ["n", "s1", "s2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def linked_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    found = similarities(stored(pairs, "member-pairs"), sets).where("linked").select("a", "b")
    return stored(found, "member-links")


def with_components(placed: DataFrame, found: DataFrame) -> DataFrame:
    rows = placed.join(found, F.col("rep") == F.col("id"), "left")
    return stored(rows.select("rep", "cluster", "off", *LIMITS, *PARITY, F.coalesce("component", "rep").alias("component")), "placed")


def stray_pairs(placed: DataFrame) -> DataFrame:
    """(a, b): members that do not link to their pivot, with those of their cluster within reach."""
    own = ["rep", "off", *LIMITS, *PARITY]
    stray = placed.where("NOT linked").select("cluster", *[F.col(c).alias(f"s_{c}") for c in own])
    other = placed.select(F.col("cluster").alias("of"), *[F.col(c).alias(f"o_{c}") for c in own])
    within = (F.col("o_rep") != F.col("s_rep")) & (F.col("o_rep") != F.col("of")) & (F.col("s_off") - F.col("o_off") <= REACH)
    pairs = stray.join(other, (F.col("cluster") == F.col("of")) & within & may_link("s", "o") & close("s", "o"))
    return pairs.select(F.least("s_rep", "o_rep").alias("a"), F.greatest("s_rep", "o_rep").alias("b")).distinct()


def open_pairs(near: DataFrame, placed: DataFrame) -> DataFrame:
    """(a, b, apart, a_reach, b_reach): clusters with members near enough that some might link, and that
    are not of one component already, with all their members."""
    state = placed.groupBy("cluster").agg(
        F.max("off").alias("reach"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    for side in ("a", "b"):
        near = near.join(state.select(F.col("cluster").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("reach", "low", "high")]), side)
    one = (F.col("a_low") == F.col("b_high")) & (F.col("b_low") == F.col("a_high")) & (F.col("a_low") == F.col("a_high"))
    reach = F.col("a_reach") + F.col("b_reach")
    return near.where((reach > 0) & (F.col("distance") <= REACH + reach) & ~one).select(
        "a", "b", F.col("distance").alias("apart"), "a_reach", "b_reach"
    )


def member_pairs(opened: DataFrame, placed: DataFrame) -> DataFrame:
    """(a, b) of the sets in open pairs of clusters that the distances to their pivots and their own limits leave possible."""

    def side(name: str, off: str, of: str) -> DataFrame:
        limits = [F.col(c).alias(f"{name}_{c}") for c in LIMITS + PARITY]
        return placed.where("low IS NOT NULL").select(
            "cluster", F.col("rep").alias(name), F.col("off").alias(off), F.col("component").alias(of), *limits
        )

    c = F.col
    state = placed.groupBy(c("cluster").alias("b")).agg(
        F.min("low").alias("b_low"), F.max("high").alias("b_high"), F.max("spare").alias("b_spare"),
        F.min("end_first").alias("b_end_first"), F.max("end_last").alias("b_end_last"),
        *[F.when(F.count("*") == 1, F.first(name)).alias(f"b_{name}") for name in PARITY],
    )
    first = opened.join(state, "b").join(
        side("x", "x_off", "x_of"),
        (c("a") == c("cluster")) & (c("apart") - c("x_off") - c("b_reach") <= REACH) & may_link("x", "b") & close("x", "b"),
    )
    first = first.drop("cluster", *[f"b_{name}" for name in LIMITS + PARITY])
    possible = (c("apart") - c("x_off") - c("y_off") <= REACH) & (F.abs(c("x_off") - c("y_off")) - c("apart") <= REACH)
    both = first.join(
        side("y", "y_off", "y_of"), (c("b") == c("cluster")) & possible & (c("x_of") != c("y_of")) & may_link("x", "y") & close("x", "y")
    )
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
