"""Prefix trie of conversations, with subtree totals rolled up by centroid decomposition.

A node stands for a distinct sequence of first turns. It is named by its smallest member and its depth, which no other
node shares. Members and depths of all nodes come from one grouping by the hash of the prefix: 192 bits, the running
sums of six 32-bit lanes of SHA-256 over (position, role, text), so that a conversation of any length is hashed in
parallel over range partitions.

Subtree totals (leaves, saved tokens) are sums over distinct nodes and cannot be read off members. They are rolled up in
the forest of parent edges by centroid decomposition:

1. A component (at first the whole trie) has a *mass*: the turns of its members at or below its top, which the grouping
   gives for every node as the sum of (length - depth + 1). The nodes with more than half of the mass form a path from
   the top; the deepest of them is the centroid.
2. The component's total below and including the centroid is added to every node of that path, and the centroid's mass
   taken from theirs; the centroid's own total is final.
3. The component splits into the subtrees of the centroid's children and what is left above it. Each has at most half of
   the mass, so there are no more rounds than the logarithm of the mass, however deep or wide the trie is.

Components above LOCAL_MASS are split by Spark joins, all at once, a round for each halving; which child's subtree a node
falls in is read from the paths of members, by (member, depth). The components that are left fit in a task and are
finished there by the same three steps, in a stream over sorted components. No step depends on the depth of the trie or
gathers an unbounded group: per-component facts are salted, counts are combined before they are shuffled, and prefixes
that more than a thousandth of all turns share (at most a thousand of them) are joined by broadcast.

Defined results: turns are ordered by turn (null first), then role and text; null roles and texts count as empty;
repeated rows are turns of their own; rows without a conv_id belong to no conversation and are left out; an empty table
has no node, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from studyflow.llm.common import map_batches, record_batch, stored

LANES = 6
#: A prefix with more than this share of all turns is joined by broadcast; there are at most 1 / share of them.
HEAVY_SHARE = 1000
#: Components up to this mass (and so at most this many nodes) are finished in one task.
LOCAL_MASS = 16384
#: Facts of a large component go to so many tasks.
SALTS = 32
#: A chunk of a node's member list, in bytes.
CHUNK_BYTES = 1 << 20
NODE = ["conv_id", "depth"]


# --- Running sums over sorted rows ----------------------------------------------------------------


def running_totals(df: DataFrame, group: str, order: list[str], values: list[str], keep: list[str], purpose: str) -> DataFrame:
    """``group``, ``keep`` and ``values``, each of ``values`` (long) summed over this and all earlier rows of its group.

    Rows are range-partitioned and sorted by ``group`` and ``order``. A partition sums its own rows; only its first
    group can have begun before, so that one carried row per partition settles the rest.
    """
    out = [group, *keep, *values]
    fields = [T.StructField(f.name, f.dataType) for f in df.select(*out).schema.fields]
    schema = T.StructType([*fields, T.StructField("part_", T.IntegerType()), T.StructField("last_", T.BooleanType())])
    value_at = [out.index(v) for v in values]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        arrow, part = to_arrow_schema(schema), TaskContext.get().partitionId()
        last, carry, held = None, [0] * len(value_at), None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            lengths = np.diff(np.append(starts, n))
            columns = list(batch.columns)
            for k, at in enumerate(value_at):
                total = np.cumsum(batch.column(at).to_numpy(zero_copy_only=False))
                before = np.where(starts > 0, total[starts - 1], 0)
                before[0] = -carry[k] if keys[0] == last else 0
                total = total - np.repeat(before, lengths)
                columns[at], carry[k] = pa.array(total), int(total[-1])
            last = keys[-1]
            if held is not None:
                yield record_batch(arrow, *held, np.full(len(held[0]), part, np.int32), np.zeros(len(held[0]), bool))
            held = columns
        if held is not None:
            ends = np.zeros(len(held[0]), bool)
            ends[-1] = True
            yield record_batch(arrow, *held, np.full(len(held[0]), part, np.int32), ends)

    ordered = df.repartitionByRange(*[F.col(c) for c in [group, *order]]).sortWithinPartitions(group, *order)
    rows = stored(map_batches(ordered.select(*out), add, schema), purpose)
    tails = rows.where("last_")
    so_far = Window.partitionBy(group).orderBy("part_")
    carried = tails.select(
        F.lead("part_").over(Window.orderBy("part_")).alias("to_"),
        F.col(group).alias("group_"),
        *[F.sum(v).over(so_far).alias(f"{v}_") for v in values],
    )
    # One row per partition at most.
    return rows.join(
        F.broadcast(carried), (F.col("part_") == F.col("to_")) & (F.col(group) == F.col("group_")), "left"
    ).select(group, *keep, *[(F.col(v) + F.coalesce(f"{v}_", F.lit(0))).alias(v) for v in values])


# --- Nodes ------------------------------------------------------------------------------------------


def rebuilt(conversations: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """``conv_id``, ``depth``, ``length``, ``digest`` and ``bytes``: a row per rebuilt turn and one of depth 0 per
    conversation. Conversation c takes its first crc32(c) % ``heads`` turns from conversation c - c % ``family``."""
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
        F.lit(1).cast("bigint").alias("place"),
    )
    turns = turns.select(
        "*",
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("digest"),
        F.octet_length("text").cast("bigint").alias("bytes"),
    )
    own = running_totals(turns, "conv_id", ["turn", "role", "text"], ["place"], ["digest", "bytes"], "turns")
    taken = F.crc32(F.col("conv_id").cast("string")) % heads
    base = (
        own.where((F.col("conv_id") % family == 0) & (F.col("place") < heads))
        .select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "digest", "bytes")
    )
    known = base.groupBy("base").agg(F.count(F.lit(1)).alias("offered"))
    convs = (
        own.groupBy("conv_id")
        .agg(F.count(F.lit(1)).alias("own"))
        .select("*", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), taken.alias("taken"))
        .join(known, "base", "left")
        .withColumn("head", F.least("taken", F.coalesce("offered", F.lit(0))))
        .select("*", (F.col("head") + F.greatest(F.col("own") - F.col("taken"), F.lit(0))).alias("length"))
    )
    facts = convs.select("conv_id", "base", "taken", "head", "length")
    first = facts.join(base, "base").where("depth <= taken")
    then = own.where(F.col("place") > taken).join(facts, "conv_id")
    columns = ["conv_id", "depth", "length", "digest", "bytes"]
    return (
        first.select(*columns)
        .unionByName(then.withColumn("depth", F.col("place") - F.col("taken") + F.col("head")).select(*columns))
        .unionByName(
            facts.select(
                "conv_id", F.lit(0).cast("bigint").alias("depth"), "length", F.lit("").alias("digest"),
                F.lit(0).cast("bigint").alias("bytes"),
            )
        )
    )


def member_paths(turns: DataFrame) -> DataFrame:
    """The rows of ``turns`` (a row of depth 0 included) with the node each leads to: ``owner`` (its smallest member),
    ``n_convs``, ``bytes`` and ``mass`` of that node, and ``up``, the owner of its parent."""
    named = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")), 256)
    lanes = [f"lane_{k}" for k in range(LANES)]
    hashed = turns.select(
        "conv_id", "depth", "length", "bytes", named.alias("named")
    ).select(
        "conv_id", "depth", "length", "bytes",
        *[
            F.when(F.col("depth") == 0, F.lit(0))
            .otherwise(F.conv(F.substring("named", 8 * k + 1, 8), 16, 10).cast("bigint"))
            .cast("bigint")
            .alias(c)
            for k, c in enumerate(lanes)
        ],
    )
    summed = running_totals(hashed, "conv_id", ["depth"], lanes, ["depth", "length", "bytes"], "prefixes")
    prefix = F.unhex(F.sha2(F.concat_ws(",", "depth", *lanes), 256)).alias("prefix")
    rows = stored(summed.select("conv_id", "depth", "length", "bytes", prefix), "prefix-rows")
    nodes = stored(
        rows.groupBy("prefix").agg(
            F.min("conv_id").alias("owner"),
            F.count(F.lit(1)).alias("n_convs"),
            F.sum(F.col("length") - F.col("depth") + 1).alias("mass"),
        ),
        "prefix-nodes",
    )
    turns_in_all = rows.count()
    heavy = F.broadcast(nodes.where(F.col("n_convs") * HEAVY_SHARE > turns_in_all))
    light = nodes.where(F.col("n_convs") * HEAVY_SHARE <= turns_in_all)
    owned = stored(
        rows.join(heavy, "prefix")
        .unionByName(rows.join(heavy.select("prefix"), "prefix", "left_anti").join(light, "prefix"))
        .drop("prefix"),
        "owned-rows",
    )
    above = owned.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("up"))
    return stored(owned.join(above, NODE, "left"), "member-paths")


# --- Subtree totals -----------------------------------------------------------------------------------


def settle(up: np.ndarray, mass: list[int], parts: list[list[int]], weights: np.ndarray, totals: np.ndarray) -> None:
    """Centroid decomposition of the components ``parts`` (rows in order of depth), into ``totals``. ``up`` has the row
    of each row's parent; ``mass`` is changed."""
    work = [p for p in parts]
    while work:
        rows = work.pop()
        if len(rows) == 1:
            totals[rows[0]] += weights[rows[0]]
            continue
        half = mass[rows[0]]
        path = [r for r in rows if 2 * mass[r] > half]
        centre = path[-1]
        branch: dict[int, list[int]] = {}
        of = {}
        rest = []
        for r in rows:
            if r == centre:
                continue
            top = of.get(up[r]) if up[r] != centre else r
            if top is None:
                rest.append(r)
            else:
                of[r] = top
                branch.setdefault(top, []).append(r)
        whole = weights[centre] + sum((weights[r] for r in of), np.zeros_like(weights[centre]))
        for r in path:
            totals[r] += whole
        for r in path[:-1]:
            mass[r] -= mass[centre]
        work += branch.values()
        if rest:
            work.append(rest)


def finish_components(ready: DataFrame, values: list[str]) -> DataFrame:
    """Totals of components that fit in a task: a stream over sorted components, a bounded number of rows at a time."""
    columns = ["top_conv", "top_depth", "conv_id", "depth", "up", "mass", *values, *[f"total_{v}" for v in values]]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in [*NODE, *[f"total_{v}" for v in values]]])
    k = len(values)

    def solve(block: np.ndarray) -> np.ndarray:
        rows = {(c, d): r for r, (c, d) in enumerate(zip(block[2].tolist(), block[3].tolist(), strict=True))}
        tops = zip(block[0].tolist(), block[1].tolist(), strict=True)
        parents = zip(block[4].tolist(), (block[3] - 1).tolist(), strict=True)
        parts: dict[tuple, list[int]] = {}
        up = []
        for r, (top, parent) in enumerate(zip(tops, parents, strict=True)):
            parts.setdefault(top, []).append(r)
            up.append(rows.get(parent, -1))
        totals = block[6 + k :].T.copy()
        settle(up, block[5].tolist(), list(parts.values()), block[6 : 6 + k].T, totals)
        return totals.T

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        kept = np.zeros((len(columns), 0), np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            kept = np.concatenate([kept, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
            differs = (kept[0] != kept[0, -1]) | (kept[1] != kept[1, -1])
            whole = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            if whole:
                yield record_batch(arrow, kept[2, :whole], kept[3, :whole], *solve(kept[:, :whole]))
                kept = kept[:, whole:]
        if kept.shape[1]:
            yield record_batch(arrow, kept[2], kept[3], *solve(kept))

    dealt = ready.repartition("top_conv", "top_depth").sortWithinPartitions("top_conv", "top_depth", "depth", "conv_id")
    cast = [F.coalesce(F.col(c), F.lit(-1)).cast("bigint").alias(c) for c in columns]
    return map_batches(dealt.select(*cast), stream, schema)


def _salted(rows: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """Join per-component ``facts`` to ``rows``; the rows of one component meet them in SALTS tasks."""
    salt = F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int")
    copies = facts.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt_", salt).join(copies, ["top_conv", "top_depth", "salt_"], how).drop("salt_")


def subtree_totals(nodes: DataFrame, paths: DataFrame, values: list[str], local_mass: int = LOCAL_MASS) -> DataFrame:
    """Sum of each of ``values`` over the subtree of every node, as ``total_<value>``.

    ``nodes`` has conv_id, depth, ``up`` (the parent is (up, depth - 1)), ``mass`` and the values, all long; ``paths``
    has ``owner`` and ``up`` by (conv_id, depth) for the members that name nodes. There is one root.
    """
    sums = [f"total_{v}" for v in values]
    roots = nodes.where("depth = 0").select("conv_id", "mass").take(1)
    top, whole = roots[0] if roots else (None, 0)
    active = nodes.select(
        *NODE, "up", "mass", *values, *[F.lit(0).cast("bigint").alias(s) for s in sums],
        F.lit(top).cast("bigint").alias("top_conv"), F.lit(0).cast("bigint").alias("top_depth"),
        F.lit(whole).cast("bigint").alias("whole"), F.lit(False).alias("settled"),
    )
    columns, rounds = active.columns, [active]
    component = ["top_conv", "top_depth"]
    largest = whole
    while largest > local_mass:
        big = rounds[-1].where((F.col("whole") > local_mass) & ~F.col("settled"))
        rounds[-1] = rounds[-1].where((F.col("whole") <= local_mass) | F.col("settled"))
        on_path = 2 * F.col("mass") > F.col("whole")
        centroids = stored(
            big.where(on_path)
            .groupBy(*component)
            .agg(F.max(F.struct("depth", "conv_id", "mass")).alias("z"))
            .select(*component, F.col("z.conv_id").alias("z_conv"), F.col("z.depth").alias("z_depth"), F.col("z.mass").alias("z_mass")),
            "centroids",
        )
        placed = _salted(big, centroids)
        deeper = placed.where("depth > z_depth").select(*component, "conv_id", "z_conv", "z_depth").distinct()
        lower = paths.select("conv_id", (F.col("depth") - 1).alias("z_depth"), F.col("owner").alias("child"), F.col("up").alias("z_conv"))
        sizes = big.select(F.col("conv_id").alias("child"), (F.col("depth") - 1).alias("z_depth"), F.col("mass").alias("child_mass"))
        below = deeper.join(lower, ["conv_id", "z_depth", "z_conv"]).join(sizes, ["child", "z_depth"])
        labelled = stored(
            placed.join(below.select(*component, "conv_id", "child", "child_mass"), [*component, "conv_id"], "left")
            .withColumn("is_centre", (F.col("conv_id") == F.col("z_conv")) & (F.col("depth") == F.col("z_depth")))
            .withColumn("is_below", F.col("child").isNotNull() & (F.col("depth") > F.col("z_depth")))
            .withColumn("on_path", on_path),
            "labelled",
        )
        inside = labelled.where("is_centre or is_below").groupBy(*component).agg(*[F.sum(v).alias(f"{v}_in") for v in values])
        added = _salted(labelled.where("on_path"), inside).unionByName(labelled.where("not on_path"), allowMissingColumns=True)
        split = {
            "mass": F.when(F.col("on_path") & ~F.col("is_centre"), F.col("mass") - F.col("z_mass")).otherwise(F.col("mass")),
            **{s: F.col(s) + F.coalesce(f"{v}_in", F.lit(0)) for v, s in zip(values, sums, strict=True)},
            "top_conv": F.when(F.col("is_below"), F.col("child")).otherwise(F.col("top_conv")),
            "top_depth": F.when(F.col("is_below"), F.col("z_depth") + 1).otherwise(F.col("top_depth")),
            "whole": F.when(F.col("is_below"), F.col("child_mass")).otherwise(F.col("whole") - F.col("z_mass")),
            "settled": F.col("is_centre"),
        }
        done = stored(added.select(*[split.get(c, F.col(c)).alias(c) for c in columns]), "components")
        rounds.append(done)
        largest = done.where("not settled").agg(F.max("whole")).first()[0] or 0
    settled = rounds[0].where("settled")
    ready = rounds[0].where("not settled")
    for table in rounds[1:]:
        settled, ready = settled.unionByName(table.where("settled")), ready.unionByName(table.where("not settled"))
    return settled.select(*NODE, *sums).unionByName(finish_components(ready, values))


# --- Members that end at a node -------------------------------------------------------------------


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 over the comma-joined ``member`` ids of each node (conv_id, depth), ascending, hashed in a stream.

    Sorted range partitions write a node's ids as chunks of text; only chunks, in order, reach the task that hashes."""
    longs = [T.StructField(c, T.LongType()) for c in (*NODE, "first")]
    chunked = T.StructType([*longs, T.StructField("chunk", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, members, size = None, [], 0
        for batch in batches:
            out = []
            for c, d, m in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (c, d) != node or size >= CHUNK_BYTES:
                    if members:
                        out.append((*node, members[0], ",".join(map(str, members)).encode()))
                    node, members, size = (c, d), [], 0
                members.append(m)
                size += 20
            if out:
                yield _rows(out, chunked)
        if members:
            yield _rows([(*node, members[0], ",".join(map(str, members)).encode())], chunked)

    digested = T.StructType([*longs[:2], T.StructField("ends_sha256", T.StringType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for c, d, chunk in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "depth", "chunk")), strict=True):
                if (c, d) != node:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (c, d), hashlib.sha256(chunk)
                else:
                    state.update(b"," + chunk)
            if out:
                yield _rows(out, digested)
        if node:
            yield _rows([(*node, state.hexdigest())], digested)

    keys = ["conv_id", "depth", "member"]
    sorted_ends = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    chunks = map_batches(sorted_ends, pack, chunked)
    return map_batches(chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first"), digest, digested)


def _rows(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    return record_batch(to_arrow_schema(schema), *[list(c) for c in zip(*rows, strict=True)])


def trie(conversations: DataFrame) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt conversations, with their subtree totals."""
    paths = member_paths(rebuilt(conversations))
    nodes = paths.where(F.col("owner") == F.col("conv_id"))
    children = (
        nodes.where("depth > 0")
        .groupBy(F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    nodes = stored(
        nodes.join(children, NODE, "left").select(
            *NODE, "up", "mass", "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
            F.col("n_children").isNull().cast("bigint").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
        ),
        "trie-nodes",
    )
    totals = subtree_totals(nodes, paths, ["leaves", "saved"])
    ends = paths.where("depth = length").select(F.col("owner").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    return (
        nodes.join(totals, NODE)
        .join(end_digests(ends), NODE, "left")
        .select(
            *NODE,
            F.col("up").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            F.col("total_leaves").alias("n_leaves"),
            F.col("total_saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


#: CRC-32 of a short ASCII text in SQL, bit by bit.
_CRC = """xor(4294967295, list_reduce(
    list_concat([4294967295::bigint], list_transform(range(1, length({s}) + 1), lambda i: ascii(({s})[i])::bigint)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
        lambda v, w: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end)))"""

SQL = f"""
with turns as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place
    from conversations where conv_id is not null
), convs as (
    select conv_id, conv_id - conv_id % 5 as base, {_CRC.format(s="cast(conv_id as varchar)")} % 9 as taken
    from (select distinct conv_id from turns)
), sized as (
    select c.*, (select count(*) from turns t where t.conv_id = c.base and t.place <= c.taken) as head from convs c
), rebuilt as (
    select c.conv_id, t.place as depth, t.role, t.text from sized c join turns t on t.conv_id = c.base and t.place <= c.taken
    union all
    select c.conv_id, t.place - c.taken + c.head, t.role, t.text from sized c join turns t using (conv_id) where t.place > c.taken
), prefixed as (
    select conv_id, depth, strlen(text) as bytes,
        string_agg(sha256(length(role) || ':' || role || text), ',') over (partition by conv_id order by depth) as prefix
    from rebuilt
    union all
    select conv_id, 0, 0, '' from convs
), named as (
    select *, min(conv_id) over (partition by depth, prefix) as owner,
        max(depth) over (partition by conv_id) as length
    from prefixed
), nodes as (
    select owner, depth, any_value(bytes) as bytes, count(*) as n_convs from named group by owner, depth
), linked as (
    select distinct child.owner, child.depth, parent.owner as up
    from named child left join named parent on parent.conv_id = child.conv_id and parent.depth = child.depth - 1
), counted as (
    select n.*, l.up, (select count(*) from linked k where k.up = n.owner and k.depth = n.depth + 1) as n_children
    from nodes n join linked l on l.owner = n.owner and l.depth = n.depth
), inside as (
    select distinct top.owner as top_owner, top.depth as top_depth, sub.owner, sub.depth
    from named top join named sub on sub.conv_id = top.conv_id and sub.depth >= top.depth
), totals as (
    select i.top_owner, i.top_depth, count(*) filter (c.n_children = 0) as n_leaves,
        sum((c.n_convs - 1) * c.bytes) as saved
    from inside i join counted c on c.owner = i.owner and c.depth = i.depth group by 1, 2
), ends as (
    select owner, depth, string_agg(conv_id::varchar, ',' order by conv_id) as members from named where depth = length group by 1, 2
)
select c.owner as conv_id, c.depth, c.up as parent_conv_id, c.n_convs, c.n_children, t.n_leaves,
    t.saved::bigint as saved_tokens, sha256(coalesce(e.members, '')) as ends_sha256
from counted c
join totals t on t.top_owner = c.owner and t.top_depth = c.depth
left join ends e on e.owner = c.owner and e.depth = c.depth
"""
