"""The four pipelines as Structured Streaming queries over ``foreachBatch``.

Each query calls the same batch functions as the jobs in ``plans``. The checkpoint is the position
in the inbox: rows are consumed once, an empty inbox starts no batch, and a new checkpoint folder
starts over; the ledger then refuses what was accepted before, and the progress stream, which has no
ledger, begins with the events that come after it was created. The offset is committed after the batch's writes; a batch repeated after a failure writes
the same rows again, in place of those it wrote before, and so has no further effect.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from studyflow import tables as T
from studyflow.operators.rules import count_columns, counts_row
from studyflow.plans import activity, audit, learners, progress, schedule, topics
from studyflow.sources.inbox import (
    TOPIC_NULL_TOKENS,
    MalformedInbox,
    refuse_malformed,
    stream_inbox,
    with_position,
    with_row_number,
)
from studyflow.sources.reference import empty_table
from studyflow.sources.store import Store

Clock = Callable[[], datetime]


def _utc_now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def _ts(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def _batch_name(spark: SparkSession, batch_id: int) -> str:
    """Batch id qualified by the query, which a new checkpoint renews."""
    query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
    return f"{query}-{batch_id:012d}"


def start(
    source: DataFrame,
    checkpoint: str,
    interval: str | None,
    handle: Callable[[DataFrame, int], None],
) -> StreamingQuery:
    """Run until the inbox is drained, or every ``interval`` when one is given."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        source.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def _logged(store: Store, pipeline: str, clock: Clock, work: Callable[[DataFrame, str, datetime], dict[str, int]]):
    """Wrap the work of a batch, which returns its counts: append its log row, or a FAILED row before the query stops.

    The rows of the batch are frozen first, as a columnar table every later step reads.
    """

    def log(counts: dict[str, int], batch: str, started: datetime, *failure: str) -> None:
        row = audit.log_run(
            counts_row(store.spark, counts), pipeline, F.lit(f"RUN_{batch}"), _ts(started), _ts(clock()), *failure
        )
        name = f"{batch}-failed-{started:%Y%m%d%H%M%S%f}" if failure else batch
        store.append("pipeline_run_log", row, name, _ts(started))

    def handle(df: DataFrame, batch_id: int) -> None:
        batch = f"{pipeline.lower()}-{_batch_name(store.spark, batch_id)}"
        started = clock()
        try:
            raw, _ = store.freeze(f"{pipeline}-raw", batch, lambda: with_position(df))
            rows = with_row_number(refuse_malformed(raw))
            log(work(rows, batch, started), batch, started)
            for frozen in (pipeline, f"{pipeline}-raw"):
                store.release(frozen, batch)
        except Exception as error:
            if isinstance(error, MalformedInbox):
                # Read the files again next time: they may have been repaired by then.
                store.release(f"{pipeline}-raw", batch)
            none = dict.fromkeys(("records_received", "records_accepted", "records_rejected"), 0)
            log(none, batch, started, "FAILED", str(error))
            raise

    return handle


def refresh_schedule(store: Store, batch: str, clock: Clock = _utc_now) -> None:
    """Topics to the plan of every active path, then first progress for what active enrollments lack.

    Runs once for a ``batch`` name; a repeat has no further effect.
    """
    now = _ts(clock())
    built, _ = store.freeze(
        "schedule",
        batch,
        lambda: schedule.build_schedule(
            store.read("study_topics").filter("active_flag"), store.read("learning_paths").filter("active_flag")
        ),
    )
    plan = schedule.upsert_plan(empty_table(store.spark, T.PLAN_SCHEMA), built, now)
    store.append("path_topic_plan", plan, batch, now)
    wanted = schedule.fanout(store.read("enrollments"), store.read("path_topic_plan"))
    held = store.read_touched("topic_assignments", wanted.select("enrollment_id"))
    missing = wanted.join(held.select("enrollment_id", "topic_id"), ["enrollment_id", "topic_id"], "left_anti")
    fresh, _ = store.freeze("assigned", batch, lambda: schedule.fresh_progress(missing, now))
    store.append("topic_assignments", fresh, batch, now)
    for frozen in ("schedule", "assigned"):
        store.release(frozen, batch)


def register_directly(
    store: Store, calls: DataFrame, batch: str, as_of: date, clock: Clock = _utc_now
) -> DataFrame:
    """Single registrations, once for a ``batch`` name: the accepted ones reach learners, enrollments
    and first progress. Returns one result text a call. ``calls`` carry file name and row number."""
    now, today = _ts(clock()), F.lit(as_of)
    answered, _ = store.freeze(
        "register", batch, lambda: learners.register_learners(calls, store.read("learning_paths"), today)
    )
    _register(store, answered.filter(F.col("failure").isNull()), batch, today, now)
    return answered


def record_directly(
    store: Store, calls: DataFrame, batch: str, clock: Clock = _utc_now
) -> DataFrame:
    """Single recordings, once for a ``batch`` name: the accepted ones become learning events. Returns
    the checked calls with their event ids. ``calls`` carry file name and row number."""

    def checked() -> DataFrame:
        held = _assigned(store, calls.select("enrollment_id")).distinct()
        return activity.validate_direct(calls, held, T.LINEAGE).withColumn(
            "event_id", activity.new_event_id()
        )

    now = _ts(clock())
    answered, _ = store.freeze("record", batch, checked)
    events = activity.record_activity(answered, F.col("event_id"), now)
    store.append("learning_events", events, batch, now)
    return answered


def _assigned(store: Store, enrollments: DataFrame) -> DataFrame:
    """(enrollment, topic) pairs that have progress, assigned or added by events, of the buckets of ``enrollments``; a
    pair may come several times."""
    buckets = store.touched(enrollments)
    pairs = [
        store.in_buckets(log, buckets).select("enrollment_id", "topic_id")
        for log in ("topic_assignments", "progress_rollups")
    ]
    return pairs[0].unionByName(pairs[1])


def _register(
    store: Store, rows: DataFrame, batch: str, today: Column, now: Column, **more: DataFrame
) -> None:
    """Append placed rows to learners, enrollments and assignments (and ``more`` rows to other logs); what they change
    there is derived on reading."""
    last = learners.last_per_learner(rows)
    none = {k: empty_table(store.spark, s) for k, s in (("l", T.LEARNER_SCHEMA), ("e", T.ENROLLMENT_SCHEMA))}
    store.append_all(
        batch,
        now,
        learners=learners.upsert_learners(none["l"], last, today, now),
        enrollments=learners.upsert_enrollments(none["e"], last, today, now),
        topic_assignments=learners.first_topics(rows, store.read("path_topic_plan"), now),
        **more,
    )


def _settle(store: Store, pipeline: str, accepted: DataFrame, batch: str, now: Column) -> None:
    """Append resolutions of the open rejects whose id this batch has accepted.

    A stream-static join: the filters of the reject log name the few batches that may hold one of the ids.
    """
    buckets = store.touched(accepted)
    found = store.read_known("rejected_records", accepted, batch, buckets)
    settled = store.in_buckets("reject_resolutions", buckets).select("rejection_id")
    still_open = found.join(settled, "rejection_id", "left_anti")
    store.append("reject_resolutions", audit.resolutions(still_open, accepted, pipeline, now), batch, now)


def run_topic_stream(
    spark: SparkSession,
    inbox: str,
    store: Store,
    checkpoint: str,
    interval: str | None = None,
    clock: Clock = _utc_now,
    max_files: int | None = None,
    multiline: bool = False,
) -> StreamingQuery:
    """Topic inbox to topics and rejects."""

    def work(df: DataFrame, batch: str, started: datetime) -> dict[str, int]:
        now = _ts(started)

        def validated() -> DataFrame:
            rows = df.withColumn("ingested_at", now)
            return topics.validate_topics(rows, store.read("exam_domains"))

        staged, counts = store.freeze(T.TOPICS_PIPELINE, batch, validated, topics.topic_count_columns())
        run = topics.process_validated_topics(staged, empty_table(spark, T.TOPIC_SCHEMA), now)
        store.append_all(batch, now, study_topics=run.topics, rejected_records=run.rejects)
        return counts

    source = stream_inbox(spark, inbox, T.TOPIC_INBOX, TOPIC_NULL_TOKENS, max_files, multiline)
    return start(source, checkpoint, interval, _logged(store, T.TOPICS_PIPELINE, clock, work))


def run_learner_stream(
    spark: SparkSession,
    inbox: str,
    store: Store,
    checkpoint: str,
    interval: str | None = None,
    clock: Clock = _utc_now,
    as_of: date | None = None,
    max_files: int | None = None,
    multiline: bool = False,
) -> StreamingQuery:
    """Learner inbox to learners, enrollments, first progress, ledger and rejects."""

    def work(df: DataFrame, batch: str, started: datetime) -> dict[str, int]:
        now, today = _ts(started), F.lit(as_of or started.date())

        def validated() -> DataFrame:
            ids = df.select(F.trim("source_record_id").alias("source_record_id"))
            return learners.validate_learners(df, store.read_known("processed_records", ids, but=batch))

        staged, counts = store.freeze(T.LEARNERS_PIPELINE, batch, validated, count_columns())
        valid, rejected = learners.split(staged)
        rows = learners.placed(learners.typed_learners(valid), store.read("learning_paths"), today)
        ledger = learners.record_processed(
            rows, T.LEARNERS_PIPELINE, "source_record_id", learners.registration_text(), now
        )
        rejects = learners.to_rejects(rejected, T.LEARNERS_PIPELINE, "source_record_id", T.LEARNER_INBOX, now)
        _register(store, rows, batch, today, now, processed_records=ledger, rejected_records=rejects)
        _settle(store, T.LEARNERS_PIPELINE, valid.select("source_record_id"), batch, now)
        return counts

    source = stream_inbox(spark, inbox, T.LEARNER_INBOX, max_files=max_files, multiline=multiline)
    return start(source, checkpoint, interval, _logged(store, T.LEARNERS_PIPELINE, clock, work))


def run_activity_stream(
    spark: SparkSession,
    inbox: str,
    store: Store,
    checkpoint: str,
    interval: str | None = None,
    clock: Clock = _utc_now,
    max_files: int | None = None,
    strict: bool = False,
    multiline: bool = False,
) -> StreamingQuery:
    """Activity inbox to learning events, ledger and rejects."""

    def work(df: DataFrame, batch: str, started: datetime) -> dict[str, int]:
        now = _ts(started)

        def validated() -> DataFrame:
            # Learners and their enrollments lie in the same buckets; only those of the batch's learners are opened.
            clean = activity.normalize_activity(df)
            buckets, id_buckets = store.touched_by(learners.with_keys(clean).select("learner_id", "activity_id"))
            enrolled = store.in_buckets("enrollments", buckets)
            named = store.in_buckets("learners", buckets).join(
                clean.select("employee_id").distinct(), "employee_id", "left_semi"
            )
            mine = enrolled.join(named.select("learner_id"), "learner_id", "left_semi").select("enrollment_id")
            ids = clean.select("activity_id")
            return activity.validate_activity(
                df,
                store.read_known("processed_records", ids, batch, id_buckets),
                store.read_known("learning_events", ids, batch, id_buckets),
                named,
                enrolled,
                _assigned(store, mine),
                strict,
            )

        staged, counts = store.freeze(T.ACTIVITY_PIPELINE, batch, validated, count_columns())
        run = activity.process_validated_activity(staged, now)
        store.append_all(
            batch, now, learning_events=run.events, rejected_records=run.rejects, processed_records=run.ledger
        )
        accepted = run.ledger.select("source_record_id")
        _settle(store, T.ACTIVITY_PIPELINE, accepted, batch, now)
        return counts

    source = stream_inbox(spark, inbox, T.ACTIVITY_INBOX, max_files=max_files, multiline=multiline)
    return start(source, checkpoint, interval, _logged(store, T.ACTIVITY_PIPELINE, clock, work))


def begin_progress_stream(store: Store, checkpoint: str) -> list[str]:
    """Remember, once for a checkpoint folder, which event batches were there before its stream."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    present = F.array(*[F.lit(b) for b in store.batches("learning_events")]).cast("array<string>")
    earlier, _ = store.freeze(
        "progress-begin", name, lambda: store.spark.range(1).select(F.explode(present).alias("earlier"))
    )
    return sorted(r.earlier for r in earlier.collect())


def run_progress_stream(
    spark: SparkSession,
    store: Store,
    checkpoint: str,
    interval: str | None = None,
    clock: Clock = _utc_now,
) -> StreamingQuery:
    """New learning events, rolled up per (enrollment, topic) and appended; progress is folded from the rollups on
    reading, and neither it nor earlier rollups are read here.

    Events that were there when the stream was created (its checkpoint folder first used) are not
    folded: an earlier stream has done that.
    """

    def handle(df: DataFrame, batch_id: int) -> None:
        batch = _batch_name(store.spark, batch_id)
        # A few batch names come back; their events are read as a whole, whichever of their files are new.
        names = sorted({r.batch for r in df.select("batch").distinct().collect()} - earlier)
        if names:
            added = progress.rollup(store.read_batches("learning_events", names), F.col("batch").alias("event_batch"))
            store.append("progress_rollups", added, f"progress-{batch}", _ts(clock()))

    store.ensure_log("learning_events")
    earlier = set(begin_progress_stream(store, checkpoint))
    schema = f"{T.EVENT_SCHEMA}, applied_at timestamp_ntz, batch string, bucket int"
    source = spark.readStream.schema(schema).parquet(f"{store.root}/learning_events")
    return start(source, checkpoint, interval, handle)


class ChainListener(StreamingQueryListener):
    """What the queries of a chain have done: batches and rows by query, and the first failure."""

    def __init__(self) -> None:
        self.ids: dict[str, str] = {}
        self.batches: dict[str, int] = {}
        self.rows: dict[str, int] = {}
        self.failure: str | None = None

    def watch(self, name: str, query: StreamingQuery) -> None:
        self.ids[str(query.id)] = name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        name = self.ids.get(str(event.progress.id))
        if name and event.progress.numInputRows:
            self.batches[name] = self.batches.get(name, 0) + 1
            self.rows[name] = self.rows.get(name, 0) + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.ids.get(str(event.id)) and event.exception and self.failure is None:
            self.failure = event.exception


class Chain:
    """The activity stream and the progress stream, running side by side, each with its own trigger."""

    def __init__(self, spark: SparkSession, activity_query: StreamingQuery, progress_query: StreamingQuery):
        self.spark, self.listener = spark, ChainListener()
        self.activity, self.progress = activity_query, progress_query
        spark.streams.addListener(self.listener)
        for name in ("activity", "progress"):
            self.listener.watch(name, getattr(self, name))

    def drain(self) -> None:
        """Wait until what is in the inbox now has reached progress; raises if a query has failed."""
        self.activity.processAllAvailable()
        self.progress.processAllAvailable()

    def stop(self) -> None:
        for query in (self.activity, self.progress):
            query.stop()
        self.spark.streams.removeListener(self.listener)


def start_chain(
    spark: SparkSession,
    inbox: str,
    store: Store,
    checkpoint: str,
    clock: Clock = _utc_now,
    activity_every: str = "1 minute",
    progress_every: str = "5 minutes",
) -> Chain:
    """Activity inbox to events, and events to progress, as two running queries."""
    begin_progress_stream(store, f"{checkpoint}/progress")
    first = run_activity_stream(spark, inbox, store, f"{checkpoint}/activity", activity_every, clock)
    return Chain(spark, first, run_progress_stream(spark, store, f"{checkpoint}/progress", progress_every, clock))


def run_chain(
    spark: SparkSession,
    inbox: str,
    store: Store,
    checkpoint: str,
    clock: Clock = _utc_now,
) -> ChainListener:
    """Run the chain until the inbox is drained and its events have reached progress."""
    chain = start_chain(spark, inbox, store, checkpoint, clock, "0 seconds", "0 seconds")
    try:
        chain.drain()
    finally:
        chain.stop()
    return chain.listener
