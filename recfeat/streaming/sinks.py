"""Stream sinks: idempotent batch writers for ``foreachBatch`` and the fan-out of one source to several targets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def exactly_once(path: str) -> Callable[[DataFrame, int], None]:
    """A10: each micro-batch overwrites the folder of its own id, so a repeated batch leaves the same rows once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest_by_key(path: str, key: str, version: str, ttl_s: int) -> Callable[[DataFrame, int], None]:
    """Keep the newest row of each key, with its expiry; versions of the table are written side by side and
    the newest complete one is the table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("expires_at", F.col(version) + ttl_s)
        if batch_id > 0:
            rows = spark.read.schema(rows.schema).parquet(f"{path}/v={batch_id - 1}").unionByName(rows)
        w = W.partitionBy(key).orderBy(F.desc(version))
        rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn").write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return write


def fan_out(*writers: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One source, several sinks; the batch is computed once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for w in writers:
                w(batch, batch_id)
        finally:
            batch.unpersist()

    return write


def long_features(df: DataFrame, kind: str, key: str, at: str) -> DataFrame:
    """(feature_type, feature_key, feature_value as JSON, update_time)."""
    values = [c for c in df.columns if c not in (key, at)]
    return df.select(F.lit(kind).alias("feature_type"), F.col(key).cast("string").alias("feature_key"), F.to_json(F.struct(*values)).alias("feature_value"), F.col(at).alias("update_time"))


def serving_map(df: DataFrame, prefix: str, key: str, at: str, ttl_s: int) -> DataFrame:
    """Key -> map of strings, with the second it expires."""
    values = [c for c in df.columns if c not in (key, at)]
    pairs = [x for c in values for x in (F.lit(c), F.col(c).cast("string"))]
    return df.select(F.concat_ws(":", F.lit(prefix), F.col(key).cast("string")).alias("feature_key"), F.create_map(*pairs).alias("features"), (F.col(at) + ttl_s).alias("expires_at"))
