"""Canonical views over the given tables: interactions, items, purchases, vectors, comments.

``AS_OF`` is the default evaluation time; every windowed operator takes it as a parameter.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

AS_OF = datetime(2024, 1, 31)
SESSION_GAP_S = 1800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_events(events: DataFrame) -> DataFrame:
    """Events (batch or stream) as interactions: one row an event, without sessions."""
    item = F.get_json_object("props", "$.k").cast("int")
    action = F.when(F.col("event_type") == "signup", "add_cart").when(F.col("event_type") == "error", "impression").otherwise(F.col("event_type"))
    return events.select(
        F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("long").alias("user_id"),
        item.alias("item_id"), action.alias("action"), F.col("value").alias("price"), (item % 10).alias("category_id"), (item % 7).alias("brand_id"),
        F.element_at(F.array(F.lit("PS5"), F.lit("PS4"), F.lit("Mobile")), (F.col("user_id") % 3 + 1).cast("int")).alias("platform"),
    )


def with_sessions(interactions: DataFrame, gap_s: int = SESSION_GAP_S) -> DataFrame:
    """Add session_id: a user's events with gaps of at most ``gap_s`` seconds share one."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    fresh = F.when(gap.isNull() | (gap > gap_s * 1_000_000), 1).otherwise(0)
    return interactions.withColumn("_fresh", fresh).withColumn("session_id", F.concat_ws("-", F.col("user_id").cast("string"), F.sum("_fresh").over(w).cast("string"))).drop("_fresh")


def interactions(spark: SparkSession, sf_dir: str, sessions: bool = False) -> DataFrame:
    out = from_events(table(spark, sf_dir, "events"))
    return with_sessions(out) if sessions else out


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("long").alias("item_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"), F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("price"),
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with customer, item, brand, category and paid amount."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return (
        line.join(order, line.l_orderkey == order.o_orderkey).join(part, line.l_partkey == part.p_partkey)
        .select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("l_partkey").alias("item_id"), F.col("p_brand").alias("brand"),
            F.col("p_type").alias("category"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("l_quantity").alias("quantity"), "amount",
        )
    )


#: The same views for DuckDB, as the head of a WITH list.
SQL_INTERACTIONS = """with interactions as (
  select event_id::bigint event_id, ts, user_id::bigint user_id, cast(json_extract_string(props, '$.k') as integer) item_id,
    case event_type when 'signup' then 'add_cart' when 'error' then 'impression' else event_type end as action, value price,
    cast(json_extract_string(props, '$.k') as integer) % 10 category_id, cast(json_extract_string(props, '$.k') as integer) % 7 brand_id,
    ['PS5', 'PS4', 'Mobile'][(user_id % 3 + 1)::int] platform
  from events)"""
SQL_SESSIONS = (
    SQL_INTERACTIONS
    + """, gaps as (
  select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) <= 1800000000 then 0 else 1 end fresh from interactions),
sessions as (select * exclude (fresh), user_id::varchar || '-' || (sum(fresh) over (partition by user_id order by ts, event_id))::bigint::varchar session_id from gaps)"""
)
SQL_PURCHASES = """with purchases as (
  select o_orderkey order_id, o_custkey customer_id, l_partkey item_id, p_brand brand, p_type category, o_orderdate::timestamp ts, l_quantity quantity,
    l_extendedprice * (1 - l_discount) amount
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)"""
SQL_AS_OF = "timestamp '2024-01-31 00:00:00'"
