"""Event topics: rows to topic records, topic records to checked events, and dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from quillon.operators.events import EVENT_TYPES, check_events
from quillon.session import stored_for_a_while
from quillon.sources.files import TEXT_TIMES

# Fixed value: the ending of a dead-letter topic.
DEAD_LETTER_SUFFIX = ".dlq"
HEADER_FIELDS = ["event_type", "event_name", "source_service", "schema_version"]


def topic_records(events: DataFrame, key: str | None = None, time: str = "timestamp", principal: str | None = None) -> DataFrame:
    """key, value and headers of each event; the key defaults to the event id.

    The value is the whole event as JSON. Headers repeat type, name, service, schema version and
    the epoch second.
    """

    def header(name: str, text: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), text.cast("string").cast("binary").alias("value"))

    headers = [header(name, F.col(name)) for name in HEADER_FIELDS]
    headers.append(header("timestamp", F.unix_seconds(F.col(time).cast("timestamp"))))
    headers.append(header("encrypted", F.lit("False")))
    if principal:
        headers.append(header("principal", F.lit(principal)))
    return events.select(
        F.coalesce(F.col(key) if key else F.lit(None), F.col("event_id")).cast("string").alias("key"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns]), TEXT_TIMES).alias("value"),
        F.array(*headers).alias("headers"),
    )


def topic_writer(records: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    """Stream topic records to Kafka (needs the Kafka connector on the classpath)."""
    return (
        records.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("includeHeaders", "true")
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )


def topic_reader(spark: SparkSession, servers: str, topics: list[str], offsets_per_trigger: int = 1_000_000) -> DataFrame:
    """Stream of topic records from Kafka, with a bound on each micro-batch."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("includeHeaders", "true")
        .option("maxOffsetsPerTrigger", offsets_per_trigger)
        .load()
    )


def dead_letters(rejected: DataFrame, group: str = "default") -> DataFrame:
    """Rejected records for the dead-letter topic: where each came from, its text, and why."""
    where = {"topic": "original_topic", "partition": "original_partition", "offset": "original_offset", "timestamp": "original_timestamp"}
    origin = [F.col(c).alias(name) for c, name in where.items() if c in rejected.columns]
    return rejected.select(
        F.concat(F.col("topic"), F.lit(DEAD_LETTER_SUFFIX)).alias("topic"),
        F.to_json(
            F.struct(
                *origin,
                F.col("value").cast("string").alias("original_value"),
                F.array_join("errors", "; ").alias("error_message"),
                F.lit(group).alias("consumer_group"),
            ),
            TEXT_TIMES,
        ).alias("value"),
    )


def consume(
    records: DataFrame,
    handlers: dict[str, Callable[[DataFrame, int], None]],
    reject: Callable[[DataFrame, int], None],
    checkpoint: str,
    schema_name: str = "base_event",
    group: str = "default",
) -> DataStreamWriter:
    """Check every record; valid events go to the handler of their type, the others to `reject`.

    The checked micro-batch is written to the shared folder while the handlers read it, so it is decoded once.
    """

    def handle(batch: DataFrame, number: int) -> None:
        with stored_for_a_while(check_events(batch, "value", schema_name), "checked") as checked:
            for event_type in EVENT_TYPES:
                if event_type in handlers:
                    handlers[event_type](checked.filter("is_valid").filter(F.col("event_type") == event_type), number)
            reject(dead_letters(checked.filter(~F.col("is_valid")), group), number)

    return records.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
