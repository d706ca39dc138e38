"""Streaming forms of scoring, webhook replies, feedback and statistics.

Each job uses the batch operators inside ``foreachBatch`` or directly on the
stream.  Batches are written under the id that the checkpoint gives the query and
their batch number, so a batch that is repeated after a failure replaces itself
and another query's batches stay.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from msgsieve import fixed_values as fixed
from msgsieve.functions import validation
from msgsieve.functions.evaluation import computed_once
from msgsieve.functions.responses import parse_response
from msgsieve.operators import scoring, stats
from msgsieve.plans import score as scoring_job
from msgsieve.sources import logs
from msgsieve.sources.webhooks import text_events

logger = logging.getLogger(__name__)

# State in files of each executor, with one bounded cache an executor, instead of on its heap.
STATE_STORE = "spark.sql.streaming.stateStore"
STATE_ON_DISK = {
    f"{STATE_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STATE_STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{STATE_STORE}.rocksdb.maxMemoryUsageMB": "256",
    f"{STATE_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
}


def file_stream(
    spark: SparkSession, path: str, schema: StructType, file_format: str = "parquet", **options
) -> DataFrame:
    """A stream over files that arrive in a folder, with an explicit schema."""
    return spark.readStream.schema(schema).format(file_format).options(**options).load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, value: str = "body", **options) -> DataFrame:
    """A stream over a topic; needs Spark's Kafka package on the class path."""
    rows = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    return rows.select(F.col("value").cast("string").alias(value), "timestamp")


def drop_redelivered(events: DataFrame, time_column: str, late: str = "1 hour", key: str = "message_id") -> DataFrame:
    """Drop events delivered again within ``late``; state is bounded by it."""
    return events.withWatermark(time_column, late).dropDuplicatesWithinWatermark([key])


def first_deliveries(requests: DataFrame, time_column: str | None, late: str, key: str = "message_id") -> DataFrame:
    """Drop redelivered rows by ``time_column``, or by arrival when there is none.

    Nothing tells whether rows without a key were delivered before, so all of them stay.
    """
    keyed = requests.withColumn("_delivery", F.coalesce(F.concat(F.lit("key:"), F.col(key)), F.expr("uuid()")))
    if time_column is not None:
        return drop_redelivered(keyed, time_column, late, "_delivery").drop("_delivery")
    arrived = keyed.withColumn("_arrived", F.current_timestamp())
    return drop_redelivered(arrived, "_arrived", late, "_delivery").drop("_delivery", "_arrived")


def _each_batch(
    stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, str, int], None]
) -> DataStreamWriter:
    """Hand every batch on with the query's id, which the checkpoint keeps over restarts."""

    def named(batch: DataFrame, batch_id: int) -> None:
        metadata = batch.sparkSession.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata")
        handle(batch, metadata.first()["id"], batch_id)

    return stream.writeStream.foreachBatch(named).option("checkpointLocation", checkpoint)


def score_stream(
    requests: DataFrame,
    scorer,
    output: str,
    checkpoint: str,
    threshold: float = 0.80,
    created_at: str | None = None,
    late: str = "1 hour",
) -> DataStreamWriter:
    """Check, score and log requests; those delivered again within ``late`` are dropped.

    Writes ``predictions``, ``telemetry`` and ``rejected`` under ``output``.
    Scores of a batch are kept while the three are written.
    """

    def handle(batch: DataFrame, job: str, batch_id: int) -> None:
        rows = batch if created_at is None else batch.withColumn("created_at", F.col(created_at))
        checked = scoring_job.check_requests(rows).persist()
        started = time.monotonic()
        records = scoring_job.score_messages(
            scoring_job.accepted(checked), scorer, threshold=threshold
        )
        records = records.persist()
        try:
            n = records.count()
            elapsed = (time.monotonic() - started) * 1000
            timed = records.withColumn("processing_time_ms", F.round(F.lit(elapsed / max(n, 1)), 1))
            when = F.col("created_at") if created_at is not None else None
            logs.append_batch(logs.prediction_log(timed, when), f"{output}/predictions", job, batch_id)
            logs.append_batch(scoring_job.rejected(checked), f"{output}/rejected", job, batch_id, day=None)
            try:
                logs.append_batch(logs.telemetry(timed), f"{output}/telemetry", job, batch_id, day=None)
            except Exception as error:  # telemetry never breaks scoring
                logger.warning("telemetry of batch %s not written: %s", batch_id, error)
        finally:
            records.unpersist()
            checked.unpersist()

    return _each_batch(first_deliveries(requests, created_at, late), checkpoint, handle)


def arbitrated(
    classified: DataFrame,
    answers: DataFrame,
    created_at: str,
    answered_at: str,
    wait: str = "1 hour",
    threshold: float = scoring.DEFAULT_THRESHOLD,
    spam_keywords: Sequence[str] = tuple(fixed.SPAM_KEYWORDS),
    phishing_keywords: Sequence[str] = tuple(fixed.PHISHING_KEYWORDS),
) -> DataFrame:
    """Decision records of a stream of classified messages and one of second opinions.

    A message below the threshold waits for an answer that is given from its own time
    until ``wait`` later.  The first valid answer to arrive counts.  When both streams'
    watermarks have passed that time the message is decided without one.  Confident
    messages, and those without an id or a time, leave at once and keep no state: the
    join's condition on them needs no answer, and their key spreads them over the tasks.
    Answers without a message or a time, and those that do not parse, are ignored.

    ``classified`` has a watermark on ``created_at``.  State is bounded by ``wait`` and
    the messages' watermark.
    """
    waits = (
        scoring.needs_second_opinion(threshold) & F.col("message_id").isNotNull() & F.col(created_at).isNotNull()
    )
    asking = classified.withColumns(
        {
            "_waits": F.coalesce(waits, F.lit(False)),
            "_question": F.when(waits, F.col("message_id")).otherwise(F.md5(F.coalesce("text", F.lit("")))),
        }
    )
    timed = answers.withWatermark(answered_at, wait)
    parsed = computed_once(
        timed.select("message_id", F.col(answered_at).alias("_answered_at"), "response"),
        {"second": parse_response(F.col("response"))},
    )
    usable = parsed.where(F.col("message_id").isNotNull() & F.col("_answered_at").isNotNull() & F.col("second.parse_ok"))
    # An answer that may still meet its message has all earlier ones in state: the watermark trails by ``wait``.
    first = usable.dropDuplicatesWithinWatermark(["message_id"]).select(
        F.col("message_id").alias("_answers"),
        "_answered_at",
        F.struct("second.label", "second.confidence", "second.reason").alias("second"),
    )
    in_time = (F.col("_answered_at") >= F.col(created_at)) & (
        F.col("_answered_at") <= F.col(created_at) + F.expr(f"INTERVAL {wait}")
    )
    joined = asking.join(first, (F.col("_question") == F.col("_answers")) & F.col("_waits") & in_time, "left_outer")
    kept = joined.drop("_waits", "_question", "_answers", "_answered_at")
    return scoring.decide_joined(kept, spam_keywords, phishing_keywords)


def arbitrate_stream(
    messages: DataFrame,
    answers: DataFrame,
    scorer,
    output: str,
    checkpoint: str,
    created_at: str = "created_at",
    answered_at: str = "answered_at",
    wait: str = "1 hour",
    **options,
) -> DataStreamWriter:
    """Score messages as they come and log their records once they are decided.

    Messages delivered again within ``wait`` are dropped.  Writes ``records`` and, as
    score_stream does, ``predictions`` under ``output``.  ``options`` go to arbitrated.

    State holds the texts of all messages that wait, so start it within ``state_on_disk``.
    """
    once = first_deliveries(messages, created_at, wait)
    classified = scoring_job.classify_messages(once, scorer)
    records = arbitrated(classified, answers, created_at, answered_at, wait, **options)

    def handle(batch: DataFrame, job: str, batch_id: int) -> None:
        decided = batch.persist()  # reading a batch again would run its joins again
        try:
            when = F.col("created_at") if "created_at" in decided.columns else None
            logs.append_batch(decided, f"{output}/records", job, batch_id, day=None)
            logs.append_batch(logs.prediction_log(decided, when), f"{output}/predictions", job, batch_id)
        finally:
            decided.unpersist()

    return _each_batch(records, checkpoint, handle)


def webhook_stream(
    bodies: DataFrame, scorer, output: str, checkpoint: str, body: str = "body", late: str = "1 hour"
) -> DataStreamWriter:
    """Score text events of webhook bodies and write replies to risky ones.

    Events delivered again within ``late`` are dropped.  A batch that cannot be scored
    or written fails, and Spark repeats it.
    """

    def handle(batch: DataFrame, job: str, batch_id: int) -> None:
        logs.append_batch(webhook_replies(batch, scorer), f"{output}/replies", job, batch_id, day=None)

    return _each_batch(first_deliveries(text_events(bodies, body), None, late), checkpoint, handle)


def webhook_replies(events: DataFrame, scorer) -> DataFrame:
    """Replies to risky events and apologies to those without a score: ``reply_token, user_id, reply``.

    Without a model every event is told so.  The reply token rides along as the
    message id, which the records keep.
    """
    if scorer is None:
        return events.select("reply_token", "user_id", F.lit(fixed.REPLY_NOT_READY).alias("reply"))
    keyed = events.select(F.col("reply_token").alias("message_id"), "user_id", "text")
    records = scoring_job.score_messages(keyed, scorer)
    reply = F.when(F.col("label").isNull(), F.lit(fixed.REPLY_FAILED)).otherwise(scoring_job.reply_column())
    answered = records.where(F.col("label").isNull() | F.col("label").isin("spam", "phishing"))
    return answered.select(F.col("message_id").alias("reply_token"), "user_id", reply.alias("reply"))


def feedback_stream(feedback: DataFrame, output: str, checkpoint: str) -> DataStreamWriter:
    """Check feedback and write it to the log; bad rows go to ``rejected``."""

    def handle(batch: DataFrame, job: str, batch_id: int) -> None:
        user = F.col("user_id") if "user_id" in batch.columns else None
        rules = validation.feedback_rules(
            F.col("text"), F.col("predicted_label"), F.col("actual_label"), user
        )
        checked = batch.withColumn("reasons", rules).persist()
        try:
            good = checked.where(F.size("reasons") == 0).drop("reasons")
            when = F.col("created_at") if "created_at" in batch.columns else None
            logs.append_batch(logs.feedback_log(good, when), f"{output}/feedback", job, batch_id)
            logs.append_batch(checked.where(F.size("reasons") > 0), f"{output}/rejected", job, batch_id, day=None)
        finally:
            checked.unpersist()

    return _each_batch(feedback, checkpoint, handle)


def stats_stream(
    predictions: DataFrame, output: str, checkpoint: str, duration: str = "1 hour", late: str = "10 minutes"
) -> DataStreamWriter:
    """Rates per period, written once the watermark has passed the period."""
    return (
        stats.windowed_stats(predictions, duration, late)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
    )


def user_counter_stream(
    predictions: DataFrame, output: str, checkpoint: str, user: str = "user_id"
) -> DataStreamWriter:
    """All-time totals per user as predictions come; the checkpoint carries them over restarts.

    A batch writes the users it changed, with their totals so far.  State is one row per
    user, spread by user; tasks combine before the shuffle.
    """

    def handle(batch: DataFrame, job: str, batch_id: int) -> None:
        logs.append_batch(batch, f"{output}/counters", job, batch_id, day=None)

    return _each_batch(stats.user_counters(predictions, user), checkpoint, handle).outputMode("update")


def latest_counters(spark: SparkSession, output: str, user: str = "user_id") -> DataFrame:
    """Current totals per user: totals never fall, so a job's latest are its largest; jobs add up."""
    written = spark.read.option("basePath", f"{output}/counters").parquet(f"{output}/counters/job=*/batch=*")
    totals = ("total_checked", "flagged")
    of_job = written.groupBy(user, "job").agg(*[F.max(n).alias(n) for n in totals])
    return of_job.groupBy(user).agg(*[F.sum(n).alias(n) for n in totals])


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in files; settings that the session has of its own stay.

    A stream takes the settings when it starts, and one that goes on from a checkpoint keeps the
    kind of store that the checkpoint has.
    """
    added = {key: value for key, value in STATE_ON_DISK.items() if spark.conf.get(key, None) is None}
    for key, value in added.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in added:
            spark.conf.unset(key)


def run_available(writer: DataStreamWriter) -> None:
    """Process everything that has arrived, then stop."""
    writer.trigger(availableNow=True).start().awaitTermination()
