"""Event-time windows over interactions.  Each function serves a stream and its batch twin with the same body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recfeat.functions.exprs import action_weight, count_if, hash_bucket, sd
from recfeat.functions.sized import small


def late(df: DataFrame, watermark: str | None) -> DataFrame:
    """Bounded lateness on a stream; a batch passes as it is."""
    return df.withWatermark("ts", watermark) if watermark and df.isStreaming else df


def dedup(df: DataFrame, watermark: str = "5 seconds") -> DataFrame:
    """Each event once; on a stream, repeated ids within the watermark."""
    return df.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"]) if df.isStreaming else df.dropDuplicates(["event_id"])


def _n(action: str) -> Column:
    return count_if(F.col("action") == action)


def _span(out: DataFrame) -> DataFrame:
    names = [c for c in out.columns if c != "window"]
    return out.select(F.unix_seconds("window.start").alias("start_s"), F.unix_seconds("window.end").alias("end_s"), *names)


def user_tumbling(df: DataFrame, size: str = "5 minutes", watermark: str | None = "5 seconds") -> DataFrame:
    """A user's events, items, categories, actions and prices per tumbling window."""
    return _span(late(df, watermark).groupBy(F.window("ts", size), "user_id").agg(
        F.count(F.lit(1)).alias("events"), F.size(F.collect_set("item_id")).cast("long").alias("items"), F.size(F.collect_set("category_id")).cast("long").alias("categories"),
        _n("view").alias("views"), _n("click").alias("clicks"), _n("purchase").alias("purchases"), F.avg("price").alias("avg_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"),
    ))


def user_hopping(df: DataFrame, size: str = "30 minutes", slide: str = "5 minutes", watermark: str | None = "5 seconds") -> DataFrame:
    """Engagement score, diversity, purchase rate and categories per hopping window."""
    score = F.sum(F.when(F.col("action").isin("favorite"), 0.0).otherwise(action_weight(F.col("action"), "stream")))
    return _span(late(df, watermark).groupBy(F.window("ts", size, slide), "user_id").agg(
        F.count(F.lit(1)).alias("events"), score.alias("engagement"), F.size(F.collect_set("category_id")).cast("long").alias("categories"),
        (_n("purchase") / F.count(F.lit(1))).alias("purchase_rate"), F.avg("price").alias("avg_price"), F.array_join(F.sort_array(F.collect_set("category_id")), ",").alias("category_list"),
    ))


def item_tumbling(df: DataFrame, size: str = "10 minutes", watermark: str | None = "5 seconds") -> DataFrame:
    """I4: an item's views, clicks, purchases, users, ctr and cvr (0 without a denominator) per tumbling window."""
    v, c, p = _n("view"), _n("click"), _n("purchase")
    return _span(late(df, watermark).groupBy(F.window("ts", size), "item_id").agg(
        v.alias("views"), c.alias("clicks"), p.alias("purchases"), F.size(F.collect_set("user_id")).cast("long").alias("users"), sd(c, v).alias("ctr"), sd(p, c).alias("cvr"),
    ))


def sessions(df: DataFrame, gap: str = "30 minutes", watermark: str | None = "5 seconds") -> DataFrame:
    """Events, items, duration, action sequence and purchase flag of each session window."""
    order = F.sort_array(F.collect_list(F.struct("ts", "event_id", "action")))
    out = late(df, watermark).groupBy(F.session_window("ts", gap).alias("window"), "user_id").agg(
        F.count(F.lit(1)).alias("events"), F.size(F.collect_set("item_id")).cast("long").alias("items"), ((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6).alias("duration"),
        F.array_join(F.transform(order, lambda x: x["action"]), ">").alias("actions"), F.bool_or(F.col("action") == "purchase").alias("has_purchase"),
    )
    return out.select(F.unix_micros("window.start").alias("start_us"), *[c for c in out.columns if c != "window"])


def behaviour(df: DataFrame, size: str = "10 minutes", slide: str = "2 minutes", watermark: str | None = "5 seconds") -> DataFrame:
    """The mergeable user accumulator (count, items, counts by action, weight, last time) in sliding windows."""
    return _span(late(df, watermark).groupBy(F.window("ts", size, slide), "user_id").agg(
        F.count(F.lit(1)).alias("events"), F.size(F.collect_set("item_id")).cast("long").alias("items"), *[_n(a).alias(f"n_{a}") for a in ("view", "click", "add_cart", "purchase")],
        F.sum(action_weight(F.col("action"), "stream")).alias("weight"), F.max(F.unix_micros("ts")).alias("last_us"),
    ))


def item_sliding(df: DataFrame, size: str = "20 minutes", slide: str = "5 minutes", watermark: str | None = "5 seconds") -> DataFrame:
    """An item's exposures, clicks, purchases, ctr, cvr and log popularity in sliding windows."""
    e, c, p = _n("impression"), _n("click"), _n("purchase")
    return _span(late(df, watermark).groupBy(F.window("ts", size, slide), "item_id").agg(
        e.alias("exposures"), c.alias("clicks"), p.alias("purchases"), (c / F.greatest(e, F.lit(1))).alias("ctr"), (p / F.greatest(c, F.lit(1))).alias("cvr"), F.log1p(c + p).alias("popularity"),
    ))


def ab_hourly(df: DataFrame, watermark: str | None = "5 seconds") -> DataFrame:
    """I16: hourly clicks, purchases and values by hashed group."""
    c, p = _n("click"), _n("purchase")
    return _span(late(df, watermark).withColumn("grp", hash_bucket(F.col("user_id"), 2)).groupBy(F.window("ts", "1 hour"), "grp").agg(
        F.count(F.lit(1)).alias("events"), sd(c, _n("view")).alias("ctr"), sd(p, c).alias("cvr"), F.avg("price").alias("avg_value"),
    ))


def with_dimension(events: DataFrame, dimension: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """C11, A5: events, batch or stream, with the columns of a lookup table; events without a row there stay.

    The table is read anew in each micro-batch; it is broadcast up to ``most`` rows, else both sides are shuffled."""
    return events.join(small(dimension, most), key, "left")


def _closed(df: DataFrame, key: str, size: str, watermark: str | None, **aggs: Column) -> DataFrame:
    """Windows of ``key`` with the last instant that belongs to them, which is an event time again."""
    out = late(df, watermark).groupBy(F.window("ts", size), F.col(key).alias(f"_{key}")).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(f"_{key}", F.window_time("window").alias(f"_{key}_at"), *aggs)


def cross_scores(df: DataFrame, user_size: str = "5 minutes", item_size: str = "10 minutes", watermark: str | None = "5 seconds") -> DataFrame:
    """I8: each event with what the closed windows just before it know of its user and its item.

    A user's activity and mean price come from the tumbling window that ended last before the event, an item's popularity
    likewise; what had no event there counts as 0.  On a stream two joins of watermarked streams with bounds on their times do it:
    a window waits for events of the next one only, an event until its windows have closed, and both go as the
    watermark passes; later rows are dropped.  A batch gives the same rows.
    """
    users = _closed(df, "user_id", user_size, watermark, activity=F.count(F.lit(1)), avg_price=F.avg("price"))
    items = _closed(df, "item_id", item_size, watermark, popularity=F.count(F.lit(1)))
    events = late(df, watermark).select("event_id", "ts", "user_id", "item_id", "price")
    for side, key, size in ((users, "user_id", user_size), (items, "item_id", item_size)):
        at = F.col(f"_{key}_at")
        on = (F.col(key) == F.col(f"_{key}")) & (F.col("ts") > at) & (F.col("ts") <= at + F.expr(f"interval {size}"))
        events = events.join(side, on, "left").drop(f"_{key}", f"_{key}_at")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    activity, popularity, mean, one = zero("activity"), zero("popularity"), zero("avg_price"), F.lit(1.0)
    apart = F.abs(mean - F.col("price")) / F.greatest(mean, one)
    score = 0.3 * F.least(activity / 100, one) + 0.3 * F.least(popularity / 1000, one) + 0.4 * (1 - F.least(apart, one))
    return events.select(
        "event_id", "ts", "user_id", "item_id", (activity * popularity).alias("activity_popularity_match"), apart.alias("price_sensitivity"), score.alias("personalized_score"),
    )
