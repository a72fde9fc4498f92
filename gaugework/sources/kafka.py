"""Kafka topics of envelopes, and routing of messages to handlers. Decoding is apart from the connector, for any source of such rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.sources.envelopes import explode_envelopes

Handler = Callable[[DataFrame, int], None]
HANDLERS: dict[str, Handler] = {}


def read_kafka_samples(spark: SparkSession, servers: str, topic: str, group: str | None = None, starting: str = "latest") -> DataFrame:
    """A stream of samples; offsets are kept by the query's checkpoint."""
    reader = spark.readStream.format("kafka").option(
        "kafka.bootstrap.servers", servers
    ).option("subscribe", topic).option("startingOffsets", starting)
    return decode_messages((reader.option("kafka.group.id", group) if group else reader).load())


def decode_messages(rows: DataFrame) -> DataFrame:
    """Samples of rows with value (JSON, bytes or text) and offset, which gives seq."""
    seq = F.col("offset") if "offset" in rows.columns else F.lit(0).cast("long")
    return explode_envelopes(rows.select(F.col("value").cast("string").alias("payload"), seq.alias("seq")))


def encode_messages(envelopes: DataFrame) -> DataFrame:
    """key and value of messages, by host."""
    return envelopes.select(F.col("host_id").alias("key"), F.to_json(F.struct("*")).alias("value"))


def write_kafka_samples(envelopes: DataFrame, servers: str, topic: str, checkpoint: str | None = None):
    """Publishes a batch, or starts a query for a stream."""
    rows, options = encode_messages(envelopes), {"kafka.bootstrap.servers": servers, "topic": topic}
    if rows.isStreaming:
        return rows.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).start()
    return rows.write.format("kafka").options(**options).save()


def register_handler(topic: str, handle: Handler) -> None:
    HANDLERS[topic] = handle


def route_topics(messages: DataFrame, batch_id: int, handlers: dict[str, Handler] | None = None) -> None:
    """Hands every topic's rows of one batch to its handler; for foreachBatch. The batch is read once."""
    messages.persist()
    try:
        for topic, handle in (HANDLERS if handlers is None else handlers).items():
            handle(messages.where(F.col("topic") == topic), batch_id)
    finally:
        messages.unpersist()
