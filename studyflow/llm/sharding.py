"""Shards of even row counts that keep linked documents together: balanced label propagation.

Documents are numbered; a link leads from a document to one with a smaller number, which it follows, so
that no two documents swap places for ever. Every document begins in shard number mod S. In each
round, linked documents look up the labels of those they follow (one join), take the most frequent one
as their wish (a grouping), and move there as far as the shard's quota of linked documents has room.
Claims are admitted in the order of a hash of the followed document, so a group is admitted as a
whole or, with all in its bucket, turned away; those turned away agree on another shard. A group larger than a shard's room divides itself into parts that wish for shards of their own. Unlinked documents fill what is left, which makes all counts equal to within one.

Everything is DataFrame functions. What the driver sees is one count a shard.

Equal texts are linked to the first of them (a star, not all pairs). Two texts are equal if their length,
CRC-32 and two 64-bit hashes are.

Cases: a null text counts as empty; a null id is numbered first; repeated rows are documents each (their
texts are linked); an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyflow.llm.common import ranked, stored

SHARDS, ROUNDS = 24, 6
BUCKETS = 4096


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, h1, h2, node): documents numbered by id and text hash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
    )
    return ranked(rows, ["doc_id", "h1", "h2"], "node", "nodes")


def same_text_links(nodes: DataFrame) -> DataFrame:
    """(node, follows): every later copy of a text follows its first."""
    key = ["h1", "h2", "size", "text_crc32"]
    firsts = nodes.groupBy(*key).agg(F.min("node").alias("follows"), F.max("node").alias("last"))
    # Stored, so that the join shuffles anew and Spark can split the rows of a very frequent text.
    firsts = stored(firsts.where("last > follows").drop("last"), "first-texts")
    return nodes.join(firsts, key).where("node <> follows").select("node", "follows")


def _turn(*columns: Column | str) -> Column:
    """A hash as a fraction in [0, 1)."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 20)) / float(1 << 20)


def propagate(links: DataFrame, n_rows: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(node, label, leader) of all linked documents; leader: the smallest one it follows, or itself."""
    followers = links.groupBy("node").agg(F.min("follows").alias("leader"))
    led = links.select(F.col("follows").alias("node")).distinct().withColumn("leader", F.lit(None).cast("long"))
    room = n_rows // shards
    # Groups that no shard can hold: at most one for each shard.
    large = (
        followers.groupBy("leader")
        .count()
        .where(F.col("count") > room)
        .select(F.col("leader").alias("large_"), (F.ceil(F.col("count") / max(room, 1)) + 1).alias("parts_"))
    )
    part = F.when(F.col("parts_").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("parts_")))
    labels = (
        followers.unionByName(led)
        .groupBy("node")
        .agg(F.coalesce(F.min("leader"), F.col("node")).alias("leader"))
        .join(F.broadcast(large), F.col("leader") == F.col("large_"), "left")
        .withColumn("part", part.cast("int"))
        .drop("large_", "parts_")
        .withColumn("label", F.pmod("node", F.lit(shards)).cast("int"))
        .withColumn("denied", F.lit(0))
    )
    labels = stored(labels, "labels")
    for turn in range(rounds):
        seen = links.join(labels.select(F.col("node").alias("follows"), "label"), "follows")
        votes = seen.groupBy("node", "label").count()
        wishes = votes.groupBy("node").agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("wish"))
        agreed = F.pmod(F.xxhash64("leader", "part", "denied"), F.lit(shards)).cast("int")
        wish = F.pmod(F.coalesce("wish", "label") + F.col("part"), F.lit(shards))
        state = stored(
            labels.join(wishes, "node", "left").withColumn(
                "wish", F.when(F.col("denied") > 0, agreed).otherwise(wish)
            ),
            "wishes",
        )
        claim = F.col("wish") != F.col("label")
        bucket = F.pmod(F.xxhash64("leader", "part"), F.lit(BUCKETS)).cast("int")
        # At most shards x BUCKETS rows of a few numbers from here on.
        staying = state.where(~claim).groupBy("label").count().select(F.col("label").alias("wish"), F.col("count").alias("stay"))
        queue = state.where(claim).groupBy("wish", bucket.alias("bucket")).agg(F.count("*").alias("n"))
        ahead = Window.partitionBy("wish").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        # A group that does not fit tries elsewhere; in the last round it may be taken in part.
        rest = F.col("left") / F.col("n") if turn == rounds - 1 else F.lit(0.0)
        admitted = (
            queue.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
            .join(staying, "wish", "left")
            .withColumn("left", F.lit(room) - F.coalesce("stay", F.lit(0)) - F.col("ahead"))
            .withColumn("share", F.when(F.col("left") >= F.col("n"), 1.0).otherwise(rest))
            .select("wish", "bucket", "share")
        )
        # Members that are there already, the followed one among them, leave with a group that is turned away.
        moves = claim & F.coalesce(_turn(F.lit(turn), "node") < F.col("share"), F.lit(False))
        denied = F.coalesce(F.col("share") == 0, F.lit(False)).cast("int")
        moved = (
            state.withColumn("bucket", bucket)
            .join(F.broadcast(admitted), ["wish", "bucket"], "left")
            .select(
                "node",
                "leader",
                "part",
                F.when(moves, F.col("wish")).otherwise(F.col("label")).alias("label"),
                (F.col("denied") + denied).alias("denied"),
            )
        )
        labels = stored(moved, "labels")
    return labels.select("node", "label", "leader")


def balanced(nodes: DataFrame, linked: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``nodes`` with shard and slot: counts at most one apart, slots gapless from 0.

    Within a shard linked documents come first; what exceeds the shard's quota at the end goes to the
    free places of others, by arithmetic on its number.
    """
    known = linked.select(F.col("node").alias("node_"), "label", "leader")
    rows = nodes.join(known, F.col("node") == F.col("node_"), "left").drop("node_")
    rows = rows.withColumn("filler", F.col("label").isNull().cast("int")).withColumn(
        "label", F.coalesce("label", F.pmod("node", F.lit(shards)).cast("int"))
    )
    placed = ranked(rows, ["label", "filler", "leader", "node"], "place", "placed")
    counts = [0] * shards
    for row in placed.groupBy("label").count().collect():  # one row a shard
        counts[row["label"]] = row["count"]
    total = sum(counts)
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    over = [max(0, c - q) for c, q in zip(counts, quota, strict=True)]
    free = [max(0, q - c) for c, q in zip(counts, quota, strict=True)]
    sums = lambda xs: [sum(xs[:s]) for s in range(shards)]
    fixed = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    at = lambda xs, index: F.element_at(fixed(xs), index + 1)

    slot = F.col("place") - at(sums(counts), F.col("label"))
    excess = at(sums(over), F.col("label")) + slot - at(quota, F.col("label"))
    ends = [a + b for a, b in zip(sums(free), free, strict=True)]
    other = F.size(F.filter(fixed(ends), lambda end: end <= F.col("excess_")))
    stays = F.col("slot_") < at(quota, F.col("label"))
    return (
        placed.withColumn("slot_", slot)
        .withColumn("excess_", excess)
        .withColumn("shard", F.when(stays, F.col("label")).otherwise(other).cast("int"))
        .withColumn(
            "slot",
            F.when(stays, F.col("slot_")).otherwise(
                at(counts, F.col("shard")) + F.col("excess_") - at(sums(free), F.col("shard"))
            ),
        )
    )


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document."""
    nodes = numbered(docs)
    links = stored(same_text_links(nodes), "links")
    linked = propagate(links, nodes.count(), shards)
    return balanced(nodes, linked, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
