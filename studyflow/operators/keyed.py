"""Keyed operators: upserts, newest row per key, and lookups against other tables.

None of them gathers the rows of one key in a single task. Counts and newest-row picks are reduced
on the map side first; lookups bring back at most one row per key, and a hot key on the probing
side is split by AQE.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order.

    The rank filter is pushed below the shuffle (window group limit), so each map task sends at
    most one row per key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter(F.col("row_count") > 1)
    )


def lookup(
    df: DataFrame,
    found: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
) -> DataFrame:
    """Left join against ``found``, which holds at most one row per (text) key.

    Rows without a key match nothing but would all hash to one partition, so they get a stand-in
    drawn from the ``spread`` columns; real keys carry a mark no stand-in has. The marked key also
    differs from whatever ``found`` was grouped by, so the join reads two plain shuffles: only then
    does AQE split the partition of a hot key on the probing side, and see the true size of
    ``found`` (a small one is broadcast).
    """
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()

    def marked(k: str) -> Column:
        return F.concat(F.lit("="), F.col(k))

    first, *others = keys
    stand_in = F.xxhash64(*[F.col(c) for c in spread]).cast("string")
    left = df.withColumn("_k_0", F.when(complete, marked(first)).otherwise(stand_in))
    right = found.withColumn("_r_0", marked(first)).withColumnsRenamed(
        {k: f"_r_{k}" for k in others}
    )
    condition = F.col("_k_0") == F.col("_r_0")
    for k in others:
        condition = condition & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(right.drop(first), condition, "left").drop(
        "_k_0", "_r_0", *[f"_r_{k}" for k in others]
    )


def restrict(table: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` without rows that cannot match the batch; AQE broadcasts the keys of a small one."""
    return table.join(batch.select(*keys).distinct(), list(keys), "left_semi")


def flag_duplicates(
    df: DataFrame, key: str, spread: Sequence[str], flag: str = "is_duplicate"
) -> DataFrame:
    """Mark every copy of a key that appears more than once in ``df``."""
    repeated = duplicate_keys(df, key).select(key, F.lit(True).alias(flag))
    return lookup(df, repeated, [key], spread).withColumn(flag, F.coalesce(flag, F.lit(False)))


def flag_existing(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    flag: str,
    unique: bool = False,
) -> DataFrame:
    """Mark rows whose key is present in ``table``; say ``unique`` if the key is its primary key."""
    known = table.select(*keys)
    known = (known if unique else known.distinct()).withColumn(flag, F.lit(True))
    return lookup(df, known, keys, spread).withColumn(flag, F.coalesce(flag, F.lit(False)))


def key_facts(
    df: DataFrame,
    key: str,
    spread: Sequence[str],
    known_in: Mapping[str, DataFrame],
) -> DataFrame:
    """Duplicate flag and one presence flag per table in ``known_in``, with one join on the batch.

    Keys of the batch and of the tables are counted together in one grouping, combined on the map
    side. Only keys with something to report are kept; there are few of them in the usual case
    (few repeats, few re-deliveries), and then AQE broadcasts them.
    """
    flags = list(known_in)
    seen = df.select(key, F.lit("batch").alias("_seen"))
    for flag, table in known_in.items():
        seen = seen.unionByName(table.select(key, F.lit(flag).alias("_seen")))
    facts = (
        seen.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count_if(F.col("_seen") == "batch").alias("_copies"),
            *[F.max(F.col("_seen") == flag).alias(flag) for flag in flags],
        )
        .withColumn("is_duplicate", F.col("_copies") > 1)
    )
    reported = F.col("is_duplicate")
    for flag in flags:
        reported = reported | F.col(flag)
    facts = facts.filter((F.col("_copies") > 0) & reported).drop("_copies")
    joined = lookup(df, facts, [key], spread)
    return joined.withColumns(
        {flag: F.coalesce(F.col(flag), F.lit(False)) for flag in ["is_duplicate", *flags]}
    )


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update: Sequence[str],
    on_update: Mapping[str, Column] | None = None,
    on_insert: Mapping[str, Column] | None = None,
) -> DataFrame:
    """New snapshot of ``target`` after merging ``source`` (unique per key).

    ``update`` columns take the source value on a match; any other source column is written only
    when the row is new. ``on_update`` and ``on_insert`` set columns the source does not carry.
    """
    on_update, on_insert = dict(on_update or {}), dict(on_insert or {})
    t = target.select(
        *keys, *[F.col(c).alias(f"_t_{c}") for c in target.columns if c not in keys],
        F.lit(True).alias("_in_t"),
    )
    s = source.select(
        *keys, *[F.col(c).alias(f"_s_{c}") for c in source.columns if c not in keys],
        F.lit(True).alias("_in_s"),
    )
    matched = F.col("_in_t") & F.col("_in_s")

    def value(c: str, kind: str) -> Column:
        if c in keys:
            return F.col(c)
        old = F.col(f"_t_{c}")
        offered = F.col(f"_s_{c}") if c in source.columns else on_insert.get(c, F.lit(None))
        fresh = on_insert[c] if c in on_insert else offered
        if c in update:
            changed = F.col(f"_s_{c}")
        else:
            changed = on_update.get(c, old)
        merged = F.when(matched, changed).when(F.col("_in_t"), old).otherwise(fresh)
        return merged.cast(kind).alias(c)

    joined = t.join(s, list(keys), "full_outer")
    return joined.select(*[value(f.name, f.dataType.simpleString()) for f in target.schema.fields])


def insert_missing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` plus the source rows whose key it lacks; existing rows are untouched."""
    fresh = source.join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)
