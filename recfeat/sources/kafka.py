"""Kafka JSON events (A3, A4).  Needs the Kafka connector on the classpath; the parser works on any string column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "user_id string, item_id string, action string, timestamp string, session_id string, category_id int, brand_id int, price double"


def parse_events(raw: DataFrame, column: str = "value", schema: str = EVENT_SCHEMA) -> DataFrame:
    """Typed events from JSON text; malformed messages are dropped."""
    parsed = raw.select(F.from_json(F.col(column).cast("string"), schema, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    return parsed.filter("user_id is not null and item_id is not null and action is not null").withColumn("ts", F.to_timestamp("timestamp")).filter("ts is not null")


def read_events(spark: SparkSession, servers: str, topic: str, offsets: str = "latest") -> DataFrame:
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", offsets)
    return parse_events(source.load())


def write_features(long: DataFrame, servers: str, topic: str, checkpoint: str):
    """Long-format features to a topic, keyed by feature_key."""
    out = long.select(F.col("feature_key").alias("key"), F.to_json(F.struct("*")).alias("value"))
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()
