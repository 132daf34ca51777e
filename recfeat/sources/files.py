"""Batch sources and sinks with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERACTION_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("action", T.StringType()),
    T.StructField("timestamp", T.LongType()), T.StructField("session_id", T.StringType()), T.StructField("platform", T.StringType()),
])


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A1: a Parquet scan; with a schema no footer is read to infer one."""
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def read_json_logs(spark: SparkSession, path: str, schema: T.StructType = INTERACTION_SCHEMA) -> DataFrame:
    """A2: JSON lines; what can't be parsed is kept in ``_corrupt_record`` with null fields."""
    kept = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(kept).option("mode", "PERMISSIVE").json(path)


def clean(logs: DataFrame) -> DataFrame:
    """Valid ids and times, calendar columns, repeated rows dropped."""
    ok = logs.filter("user_id is not null and item_id is not null and timestamp > 0")
    ts = F.timestamp_millis("timestamp")
    return ok.dropDuplicates(["user_id", "item_id", "timestamp"]).withColumns({"ts": ts, "date": F.to_date(ts), "hour": F.hour(ts), "day_of_week": F.dayofweek(ts)})


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Overwrite; with ``partition_by`` only the partitions that ``df`` holds are replaced."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by)
    writer.parquet(path)


def write_statistics(stats: DataFrame, path: str) -> None:
    """One JSON text line a row."""
    stats.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_atomic(interactions: DataFrame, path: str) -> None:
    """Tab-separated files with typed headers, as sequence trainers read them."""
    cols = interactions.select(F.col("user_id").alias("user_id:token"), F.col("item_id").alias("item_id:token"), F.unix_seconds("ts").cast("double").alias("timestamp:float"))
    cols.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
