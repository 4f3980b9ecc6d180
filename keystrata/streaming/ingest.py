"""Change streams into tables: Structured Streaming micro-batches, each folded into the active snapshot.

A batch's number is kept in the version that it made, so a batch that is replayed after a failure is recognised and
not applied twice, which matters as arrays are appended to.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.operators import cdc
from keystrata.plans.catalog import Table
from keystrata.plans.metrics import Registry
from keystrata.plans.settings import StreamSource

#: Partitions for each core that a batch's parsed operations are kept in, at most.
PARTS_A_CORE = 4


def seek_ms(watermark_sec: int, rewind_minutes: int) -> int:
    """Where a catch-up starts: the watermark less the rewind, in milliseconds, at least 0."""
    return max(0, (watermark_sec - rewind_minutes * 60) * 1000)


def seek_column(watermark: Column, rewind_minutes: Column) -> Column:
    """seek_ms() of columns: of a time, and of minutes."""
    return F.greatest(F.lit(0).cast("long"), (F.unix_timestamp(watermark) - rewind_minutes * 60) * 1000)


def resume_offset(saved: int | None) -> int | None:
    """The offset after the saved one; None, the beginning, for none or a negative one."""
    return saved + 1 if saved is not None and saved >= 0 else None


def kafka_options(source: StreamSource, *, start_ms: int | None = None, saved: int | None = None) -> dict[str, str]:
    """Options of Spark's Kafka reader for one partition of a topic.

    A time with no message at or after it starts at the end: there is nothing left to catch up with.
    """
    out = {"kafka.bootstrap.servers": source.brokers, "assign": json.dumps({source.topic: [source.partition]}), "failOnDataLoss": "false"}
    if start_ms is not None:
        out["startingOffsetsByTimestamp"] = json.dumps({source.topic: {str(source.partition): start_ms}})
        out["startingOffsetsByTimestampStrategy"] = "latest"
    else:
        at = resume_offset(saved)
        out["startingOffsets"] = "earliest" if at is None else json.dumps({source.topic: {str(source.partition): at}})
    return out


def kafka_messages(spark: SparkSession, source: StreamSource, **where: int | None) -> DataFrame:
    """A stream of (offset, value); needs Spark's Kafka package."""
    raw = spark.readStream.format("kafka").options(**kafka_options(source, **where)).load()
    return raw.select("offset", F.col("value").cast("string").alias("value"))


def file_messages(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """A stream of (offset, value) from JSON lines {"offset": n, "value": "..."} in a folder."""
    return spark.readStream.schema("offset long, value string").option("maxFilesPerTrigger", per_batch).json(folder)


def apply_batch(table: Table, messages: DataFrame, batch: int | None = None, metrics: Registry | None = None, run: str | None = None) -> str | None:
    """Folds messages into the table and commits; None if there is nothing to do or the batch was applied before.

    run names the stream that numbers the batches, such as its checkpoint; without it any stream's numbers count.
    The base is read, compared with the batch's number and replaced under the table's lock.
    """
    began, schema = time.time(), table.schema()
    state = messages.agg(F.max("offset").alias("last"), F.count("*").alias("n")).first()
    if not state["n"]:
        return None
    # Read by the choice of buckets, three times by the fold, and by the metrics; parsed once. A shuffle's partitions
    # are put together to a few a core, as each reading would start a task for each of them.
    parsed = cdc.parse(messages, schema).coalesce(PARTS_A_CORE * messages.sparkSession.sparkContext.defaultParallelism).persist()

    def folded(base: DataFrame) -> DataFrame | None:
        last = table.acquire().meta.get("stream", {}) if table.active() is not None else {}
        if batch is not None and last.get("batch", -1) >= batch and (run is None or last.get("run", run) == run):
            return None
        return cdc.fold_into(parsed, schema, base)

    try:
        # Only buckets of the batch's keys are read and written.
        build = table.change(folded, keys=parsed.where("status = 'ok'").select("key"), extra={"stream": {"offset": state["last"], **({} if batch is None else {"batch": batch, "run": run})}})
        if build is None:
            return None
        table.files.replace(f"{table.root}/kafka.offset", str(state["last"]))
        if metrics is not None:
            bad = {r["status"]: r["n"] for r in parsed.groupBy("status").agg(F.count("*").alias("n")).collect()}
            metrics["kafka_messages_consumed_total"].add(table.name, by=state["n"])
            metrics["kafka_parse_errors_total"].add(table.name, by=bad.get("parse_error", 0))
            metrics["kafka_apply_errors_total"].add(table.name, by=bad.get("apply_error", 0))
            metrics["kafka_committed_offset"].set(table.name, to=state["last"])
            metrics["kafka_apply_latency_us"].observe(table.name, value=(time.time() - began) * 1e6)
        return build
    finally:
        parsed.unpersist()


def run(table: Table, messages: DataFrame, checkpoint: str, *, available_now: bool = True, metrics: Registry | None = None, after: Callable[[str], None] | None = None):
    """Starts the query that folds every micro-batch into the table."""

    def each(frame: DataFrame, batch: int) -> None:
        kept = frame.persist()
        try:
            build = apply_batch(table, kept, batch, metrics, checkpoint)
        finally:
            kept.unpersist()
        if build and after:
            after(build)

    writer = messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def catch_up(table: Table, messages: DataFrame, checkpoint: str, source: StreamSource, watermark_sec: int, rewind_minutes: int, limit_sec: int = 7200) -> dict:
    """Reads a stream to its present end and writes kafka_meta.json; at the time limit what is applied stays."""
    query = run(table, messages, checkpoint)
    done = query.awaitTermination(limit_sec)
    if not done:
        query.stop()
    if query.exception():
        raise query.exception()
    offset = table.acquire().meta.get("stream", {}).get("offset", -1) if table.active() else -1
    meta = {
        "topic": source.topic, "partition": source.partition, "brokers": source.brokers, "offline_watermark_sec": watermark_sec,
        "rewind_minutes": rewind_minutes, "last_committed_offset": offset, "catchup_completed_unix": int(time.time()),
    }
    table.files.replace(f"{table.root}/kafka_meta.json", json.dumps(meta, indent=2))
    return meta
