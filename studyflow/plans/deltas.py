"""Reports kept by deltas: sums per enrollment, renewed only where something has changed.

``progress_sums`` holds a row of exact whole numbers per enrollment (see ``views.progress_base``). An update finds the batches
of enrollments, assignments and rollups that no earlier update has seen, takes the enrollments they name, and appends
new sums for those alone; the newest row of an enrollment counts. It opens only the buckets of progress that hold a changed
enrollment, and folds the topics that were begun: one that was only assigned adds nothing to a sum. So its cost follows the
change. Reports read the sums and never progress.

A change of the plan or of the topics concerns every enrollment: call ``update_sums`` with ``everything=True`` after it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyflow.plans import progress, views
from studyflow.sources.store import Store

INPUTS = ("enrollments", "topic_assignments", "progress_rollups")
SUMS = ["completed", "in_progress", "begun", "percent", "hours"]


def unseen(store: Store) -> dict[str, list[str]]:
    """Batches of each input log that no update has seen yet. Only names of batches come to the driver."""
    seen = {(r.log, r.of_batch) for r in store.read("summed_batches").collect()}
    return {log: [b for b in store.batches(log) if (log, b) not in seen] for log in INPUTS}


def begun_progress(store: Store, changed: DataFrame, buckets: list[int], batch: str) -> DataFrame:
    """Topic progress of ``changed`` enrollments, without topics that no event and no assignment has begun.

    Of the assignments, by far the larger log, only those of (enrollment, topic) pairs with some progress in one of them
    are folded. Which of these counts is left to the fold.
    """
    assigned = store.in_buckets("topic_assignments", buckets, log=True)
    rollups = store.in_buckets("progress_rollups", buckets, log=True).join(changed, "enrollment_id", "left_semi")
    some = (F.col("progress_status") != "NOT_STARTED") | (F.col("completion_percent") != 0) | (F.col("hours_spent") != 0)
    pairs, _ = store.freeze("begun", batch, lambda: assigned.where(some).select(*progress.KEYS).distinct())
    mine = assigned.join(changed, "enrollment_id", "left_semi").join(pairs, progress.KEYS, "left_semi")
    return progress.from_logs(mine, rollups)


def update_sums(store: Store, batch: str, now: Column, everything: bool = False) -> list[int]:
    """Append the sums of changed enrollments. Returns the buckets of progress that were opened.

    A repeat of ``batch`` after a failure finds the same batches unseen, or more, and writes in place of its rows.
    """
    fresh = unseen(store)
    names = [(log, b) for log, batches in fresh.items() for b in batches]
    if not names and not everything:
        return []
    if everything:
        changed = store.read("enrollments").select("enrollment_id")
    else:
        changed = reduce(
            DataFrame.unionByName,
            [store.read_batches(log, batches).select("enrollment_id") for log, batches in fresh.items()],
        ).distinct()
    changed, _ = store.freeze("changed", batch, lambda: changed)
    buckets = store.touched(changed)
    folded = begun_progress(store, changed, buckets, batch)
    enrolled = store.read("enrollments").join(changed, "enrollment_id", "left_semi")
    plan = views.plan_domains(store.read("path_topic_plan"), store.read("study_topics"), store.read("exam_domains"))
    sums = views.progress_base(enrolled, plan, folded).select("enrollment_id", *SUMS, "by_domain")
    store.append("progress_sums", sums, batch, now)
    if names:
        seen = F.array(*[F.struct(F.lit(log).alias("log"), F.lit(b).alias("of_batch")) for log, b in names])
        store.append("summed_batches", store.spark.range(1).select(F.inline(seen)), batch, now)
    for frozen in ("changed", "begun"):
        store.release(frozen, batch)
    return buckets


def base(store: Store) -> DataFrame:
    """``views.progress_base`` of all enrollments, from the sums."""
    held = store.read("enrollments").select(*views.ENROLLMENT)
    joined = held.join(store.read("progress_sums"), "enrollment_id", "left")
    return joined.select(*views.ENROLLMENT, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in SUMS], "by_domain")


def learner_progress(store: Store, as_of: Column) -> DataFrame:
    return views.learner_progress_from(
        base(store).drop("by_domain"), store.read("learners"), store.read("learning_paths"),
        store.read("path_topic_plan"), as_of,
    )


def domain_progress(store: Store) -> DataFrame:
    domains = store.read("exam_domains")
    plan = views.plan_domains(store.read("path_topic_plan"), store.read("study_topics"), domains)
    return views.domain_progress_from(base(store), plan, domains)


def weighted_progress(store: Store) -> DataFrame:
    return views.weighted_progress(domain_progress(store))
