"""User, item, pair and session features.  All take interactions and, where windowed, an explicit ``as_of``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recfeat.functions.exprs import action_weight, count_if, half_up, p1, r6, sd, seconds_between
from recfeat.operators.quantiles import with_quantiles
from recfeat.operators.running import Recent, exact, recent_sums, running_sums

#: Seconds of the named windows.
WINDOWS = {"1h": 3600, "6h": 21_600, "1d": 86_400, "3d": 259_200, "7d": 604_800, "14d": 1_209_600, "30d": 2_592_000}


def since(as_of: datetime, seconds: int) -> Column:
    """Literal start of a window, so that the comparison reaches the scan."""
    return F.lit(as_of).cast("timestamp") - F.expr(f"interval {seconds} seconds")


def n_action(action: str, when: Column | None = None) -> Column:
    hit = F.col("action") == action
    return count_if(hit if when is None else hit & when)


def user_profile(interactions: DataFrame) -> DataFrame:
    """Activity counts, weights, first and last time, most used platform (ties: greatest name)."""
    weight = action_weight(F.col("action"), "profile")
    platform = interactions.groupBy("user_id", "platform").agg(F.count(F.lit(1)).alias("n"))
    platform = platform.groupBy("user_id").agg(F.max_by("platform", F.struct("n", "platform")).alias("modal_platform"))
    out = interactions.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_interactions"), F.countDistinct("item_id").alias("unique_items"), F.countDistinct("session_id").alias("total_sessions"),
        F.countDistinct(F.to_date("ts")).alias("active_days"), F.avg(weight).alias("avg_weight"), F.stddev_samp(weight).alias("std_weight"),
        *[n_action(a).alias(f"n_{a}") for a in ("view", "click", "purchase", "like", "share")],
        F.min(F.unix_micros("ts")).alias("first_us"), F.max(F.unix_micros("ts")).alias("last_us"), F.max(F.to_date("ts")).alias("last_day"), F.min(F.to_date("ts")).alias("first_day"),
    )
    return out.join(platform, "user_id")


def user_ratios(profile: DataFrame) -> DataFrame:
    """Conversion, engagement, diversity and lifetime from D1."""
    return profile.select(
        "user_id", p1(F.col("n_purchase"), F.col("n_view")).alias("conversion_rate"), p1(F.col("total_interactions"), F.col("active_days")).alias("engagement_score"),
        p1(F.col("unique_items"), F.col("total_interactions")).alias("diversity"), F.datediff("last_day", "first_day").cast("long").alias("lifetime_days"),
    )


def last_n(df: DataFrame, key: str, n: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last ``n`` rows of each key."""
    w = W.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def item_stats(interactions: DataFrame, recent: int = 1000) -> DataFrame:
    """D3: item totals, statistics of the last ``recent`` interactions, popularity and conversion."""
    weight = action_weight(F.col("action"), "profile")
    whole = interactions.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("total_interactions"), F.countDistinct("user_id").alias("unique_users"), F.avg(weight).alias("avg_weight"), n_action("view").alias("views"), n_action("purchase").alias("purchases"),
    )
    late = last_n(interactions, "item_id", recent).groupBy("item_id").agg(F.count(F.lit(1)).alias("recent_interactions"), F.avg(weight).alias("recent_weight"))
    out = whole.join(late, "item_id", "left")
    return out.withColumn(
        "popularity", 0.3 * F.col("total_interactions") + 0.3 * F.col("unique_users") + 0.4 * F.coalesce("recent_interactions", F.lit(0))
    ).withColumn("conversion_rate", p1(F.col("purchases"), F.col("views")))


def distinct_in_windows(base: DataFrame, key: str, values: dict[str, Column], starts: dict[str, Column], prefix: str) -> DataFrame:
    """Distinct values of each kind in each window, per key, without one distinct aggregate for every pair.

    Each (key, kind, value) keeps its latest time only; it belongs to a window if that time does.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in values.items()])
    last = base.select(key, "ts", F.explode(kinds).alias("x")).groupBy(key, "x.kind", "x.value").agg(F.max("ts").alias("last")).filter("value is not null")
    hits = [count_if((F.col("kind") == k) & (F.col("last") >= start)).alias(f"{prefix}_{k}_{w}") for k in values for w, start in starts.items()]
    return last.groupBy(key).agg(*hits)


def top_platforms(base: DataFrame, key: str, starts: dict[str, Column], prefix: str) -> DataFrame:
    """How many platforms each key uses in each window, and the commonest (the greatest name of a tie)."""
    each = base.groupBy(key, "platform").agg(*[count_if(F.col("ts") >= start).alias(w) for w, start in starts.items()]).filter("platform is not null")
    hits = [f for w in starts for f in (
        count_if(F.col(w) > 0).alias(f"{prefix}_platforms_{w}"), F.max_by("platform", F.when(F.col(w) > 0, F.struct(w, "platform"))).alias(f"{prefix}_platform_{w}"),
    )]
    return each.groupBy(key).agg(*hits)


def user_windows(interactions: DataFrame, as_of: datetime, windows: dict[str, int] | None = None) -> DataFrame:
    """Sixteen aggregates a window and four ratios of user behaviour, and two trends, from one filtered read.

    A window without events has counts of 0, no hours and days, and neither mean, deviation nor platform.
    """
    windows = windows or WINDOWS
    starts = {w: since(as_of, s) for w, s in windows.items()}
    base = interactions.filter((F.col("ts") >= since(as_of, max(windows.values()))) & (F.col("ts") < F.lit(as_of).cast("timestamp")))
    weight = action_weight(F.col("action"), "offline")
    aggs = []
    for w, start in starts.items():
        on = F.col("ts") >= start
        aggs += [
            count_if(on).alias(f"user_interactions_{w}"), F.coalesce(F.sum(F.when(on, weight)), F.lit(0.0)).alias(f"user_engagement_{w}"),
            F.avg(F.when(on, weight)).alias(f"user_avg_engagement_{w}"), F.stddev_samp(F.when(on, weight)).alias(f"user_std_engagement_{w}"),
            *[n_action(a, on).alias(f"user_{a}s_{w}") for a in ("purchase", "view", "click", "like", "share")],
            F.sort_array(F.collect_set(F.when(on, F.hour("ts")))).alias(f"user_hours_{w}"), F.sort_array(F.collect_set(F.when(on, F.dayofweek("ts")))).alias(f"user_weekdays_{w}"),
        ]
    distinct = distinct_in_windows(base, "user_id", {"items": F.col("item_id"), "sessions": F.col("session_id"), "days": F.to_date("ts")}, starts, "user")
    out = base.groupBy("user_id").agg(*aggs).join(distinct, "user_id").join(top_platforms(base, "user_id", starts, "user"), "user_id", "left")
    for w in windows:
        out = out.withColumns({
            f"user_conversion_{w}": p1(F.col(f"user_purchases_{w}"), F.col(f"user_views_{w}")),
            f"user_engagement_per_session_{w}": p1(F.col(f"user_engagement_{w}"), F.col(f"user_sessions_{w}")),
            f"user_items_per_session_{w}": p1(F.col(f"user_items_{w}"), F.col(f"user_sessions_{w}")),
            f"user_intensity_{w}": p1(F.col(f"user_interactions_{w}"), F.col(f"user_days_{w}")),
        })
    if {"1d", "7d", "30d"} <= set(windows):
        out = out.withColumns({
            "user_trend_engagement": F.col("user_avg_engagement_7d") / (F.col("user_avg_engagement_30d") + 0.001),
            "user_trend_activity": F.col("user_interactions_1d") / (F.col("user_interactions_7d") / 7 + 0.001),
        })
    return out


def item_windows(interactions: DataFrame, as_of: datetime, windows: dict[str, int] | None = None) -> DataFrame:
    """Eight aggregates a window, purchase rate and popularity of items, and two trends, from one filtered read.

    A window without events has counts of 0 and neither mean nor deviation.
    """
    windows = windows or WINDOWS
    starts = {w: since(as_of, s) for w, s in windows.items()}
    base = interactions.filter((F.col("ts") >= since(as_of, max(windows.values()))) & (F.col("ts") < F.lit(as_of).cast("timestamp")))
    weight = F.when(F.col("action") == "purchase", 10.0).otherwise(1.0)
    aggs = []
    for w, start in starts.items():
        on = F.col("ts") >= start
        aggs += [
            count_if(on).alias(f"item_n_{w}"), F.coalesce(F.sum(F.when(on, weight)), F.lit(0.0)).alias(f"item_engagement_{w}"),
            F.avg(F.when(on, weight)).alias(f"item_avg_engagement_{w}"), F.stddev_samp(F.when(on, weight)).alias(f"item_std_engagement_{w}"),
            n_action("purchase", on).alias(f"item_purchases_{w}"), n_action("view", on).alias(f"item_views_{w}"),
        ]
    distinct = distinct_in_windows(base, "item_id", {"users": F.col("user_id"), "platforms": F.col("platform")}, starts, "item")
    out = base.groupBy("item_id").agg(*aggs).join(distinct, "item_id")
    for w in windows:
        out = out.withColumns({
            f"item_purchase_rate_{w}": p1(F.col(f"item_purchases_{w}"), F.col(f"item_views_{w}")),
            f"item_popularity_{w}": F.log1p(f"item_n_{w}") * F.log1p(f"item_users_{w}"),
        })
    if {"1d", "7d", "30d"} <= set(windows):
        out = out.withColumns({
            "item_trend_popularity": F.col("item_popularity_7d") / (F.col("item_popularity_30d") + 0.001),
            "item_trend_engagement": F.col("item_avg_engagement_1d") / (F.col("item_avg_engagement_7d") + 0.001),
        })
    return out


def pair_features(interactions: DataFrame) -> DataFrame:
    """User-item counts, span, conversion, intensity, action sequence and last action."""
    weight = action_weight(F.col("action"), "behaviour")
    seq = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "action"))), lambda x: x["action"])
    out = interactions.groupBy("user_id", "item_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(weight).alias("engagement"), n_action("view").alias("views"), n_action("purchase").alias("purchases"),
        F.datediff(F.max("ts"), F.min("ts")).cast("long").alias("span_days"), seq.alias("actions"),
    )
    return out.withColumns({
        "conversion": p1(F.col("purchases"), F.col("views")), "intensity": p1(F.col("engagement"), F.col("span_days")),
        "last_action": F.element_at("actions", -1), "has_purchase": F.array_contains("actions", "purchase"), "action_path": F.array_join("actions", ">"),
    }).drop("actions")


def user_item_matrix(interactions: DataFrame, as_of: datetime) -> DataFrame:
    """Summed weight with exponential decay by the day since the last interaction."""
    out = interactions.groupBy("user_id", "item_id").agg(
        F.sum(action_weight(F.col("action"), "profile")).alias("score"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"),
    )
    fade = F.exp(-seconds_between(F.lit(as_of).cast("timestamp"), F.col("last_ts")) / 86_400.0)
    return out.select("user_id", "item_id", "score", "n", fade.alias("time_decay"), (F.col("score") * fade).alias("weighted_score"))


def user_window_stats(interactions: DataFrame, as_of: datetime, windows: dict[str, int]) -> DataFrame:
    """Long form, one row a user and window that has events: action counts, rates, repeat purchases, active days,
    order values.  Events are read once, not once a window; distinct counts come from each value's latest time."""
    starts = {w: since(as_of, s) for w, s in windows.items()}
    base = interactions.filter((F.col("ts") >= since(as_of, max(windows.values()))) & (F.col("ts") < F.lit(as_of).cast("timestamp")))
    buy, actions = F.col("action") == "purchase", ("impression", "click", "view", "add_cart", "purchase", "favorite", "share")
    aggs = []
    for w, start in starts.items():
        on = F.col("ts") >= start
        paid = F.when(on & buy, F.col("price"))
        aggs += [count_if(on).alias(f"u_n_{w}"), *[n_action(a, on).alias(f"u_n_{a}_{w}") for a in actions]]
        aggs += [F.coalesce(f(paid), F.lit(0.0)).alias(f"u_order_{n}_{w}") for n, f in (("sum", F.sum), ("avg", F.avg), ("max", F.max))]
    kinds = {"items": F.col("item_id"), "categories": F.col("category_id"), "bought": F.when(buy, F.col("item_id")), "active_days": F.to_date("ts"), "sessions": F.col("session_id")}
    wide = base.groupBy("user_id").agg(*aggs).join(distinct_in_windows(base, "user_id", kinds, starts, "u"), "user_id")
    names = ["n", *[f"n_{a}" for a in actions], *kinds, "order_sum", "order_avg", "order_max"]
    each = F.array(*[F.struct(F.lit(w).alias("window"), *[F.col(f"u_{n}_{w}").alias(n) for n in names]) for w in windows])
    out = wide.select("user_id", F.inline(each)).filter("n > 0")
    return out.withColumns({
        "repeat_purchases": F.greatest(F.lit(0), F.col("n_purchase") - F.col("bought")).cast("long"), "click_rate": sd(F.col("n_click"), F.col("n_view")),
        "cart_rate": sd(F.col("n_add_cart"), F.col("n_click")), "purchase_rate": sd(F.col("n_purchase"), F.col("n_click")),
    }).drop("bought", "n")


def top_values(df: DataFrame, keys: list[str], value: str, k: int, name: str) -> DataFrame:
    """The ``k`` most frequent values of each key, joined by commas; ties go to the smaller value."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*keys).orderBy(F.desc("n"), F.asc(value))
    top = counts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rn", F.col(value).cast("string").alias("v")))), lambda x: x["v"])
    return top.groupBy(*keys).agg(F.array_join(listed, ",").alias(name))


def item_window_stats(interactions: DataFrame, as_of: datetime, seconds: int) -> DataFrame:
    """Item counts, repeat buyers, rates, popularity, and the trend against the window before."""
    start, before, end = since(as_of, seconds), since(as_of, 2 * seconds), F.lit(as_of).cast("timestamp")
    by_user = interactions.filter((F.col("ts") >= before) & (F.col("ts") < end)).withColumn("now", F.col("ts") >= start).groupBy("item_id", "user_id").agg(
        *[n_action(a, F.col("now")).alias(f"n_{a}") for a in ("impression", "click", "view", "add_cart", "purchase")],
        n_action("view", ~F.col("now")).alias("prev_views"), F.coalesce(F.sum(F.when(F.col("now") & (F.col("action") == "purchase"), F.col("price"))), F.lit(0.0)).alias("revenue"),
    )
    out = by_user.groupBy("item_id").agg(
        *[F.sum(f"n_{a}").alias(f"n_{a}") for a in ("impression", "click", "view", "add_cart", "purchase")], F.sum("prev_views").alias("prev_views"),
        count_if(F.col("n_view") > 0).alias("viewers"), count_if(F.col("n_purchase") > 0).alias("buyers"), count_if(F.col("n_purchase") > 1).alias("repeat_buyers"), F.sum("revenue").alias("revenue"),
    )
    c = F.col
    return out.withColumns({
        "ctr": sd(c("n_click"), c("n_impression")), "view_rate": sd(c("n_view"), c("n_click")), "cart_rate": sd(c("n_add_cart"), c("n_view")), "purchase_rate": sd(c("n_purchase"), c("n_view")),
        "popularity": F.least(F.lit(1.0), c("viewers") / 1000.0), "trend": sd(c("n_view") - c("prev_views"), c("prev_views")),
    })


def session_stats(interactions: DataFrame, least_events: int = 2) -> DataFrame:
    """Sessions of at least ``least_events`` events: duration, actions a minute, engagement score, conversion."""
    duration = (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6
    out = interactions.groupBy("user_id", "session_id").agg(
        duration.alias("duration"), F.count(F.lit(1)).alias("events"), F.countDistinct("item_id").alias("items"),
        F.sum(action_weight(F.col("action"), "engagement")).alias("engagement"), F.max((F.col("action") == "purchase").cast("int")).cast("long").alias("converted"),
    ).filter(F.col("events") >= least_events)
    return out.withColumn("actions_per_minute", F.col("events") / F.greatest(F.col("duration") / 60, F.lit(0.1)))


def session_summary(sessions: DataFrame) -> DataFrame:
    """Totals and the duration histogram of D12."""
    d = F.col("duration")
    out = sessions.agg(
        F.count(F.lit(1)).alias("sessions"), F.avg("duration").alias("mean_duration"), F.avg("events").alias("events_per_session"),
        F.avg("items").alias("items_per_session"), F.avg("converted").alias("conversion"), F.avg((F.col("engagement") > 5).cast("int")).alias("high_engagement"),
        count_if(d < 60).alias("under_1m"), count_if((d >= 60) & (d < 300)).alias("under_5m"), count_if((d >= 300) & (d < 900)).alias("under_15m"), count_if(d >= 900).alias("longer"),
    )
    return with_quantiles(out, sessions, d, (0.5,)).withColumn("median_duration", F.get("q", F.lit(0))).drop("q")


def gaps(interactions: DataFrame) -> DataFrame:
    """Seconds from each event to the user's next one: a stand-in for dwell time."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return interactions.withColumn("dwell", (F.lead(F.unix_micros("ts")).over(w) - F.unix_micros("ts")) / 1e6)


def dwell_distribution(dwell: DataFrame, column: str = "dwell") -> DataFrame:
    """Mean, interpolated percentiles, population deviation, depth classes and score, to four places (halves go up).

    Sums are those of whole microseconds, so that no result depends on the order of the rows.
    """
    d, n = F.col(column), F.count(F.lit(1))
    us = exact(d)
    mean = F.sum(us.cast("decimal(38,0)")).cast("double") / n
    out = dwell.filter(d.isNotNull()).agg(
        n.alias("n"), mean.alias("mean"), F.sqrt(F.sum(us.cast("decimal(19,0)") * us.cast("decimal(19,0)")).cast("double") / n - mean * mean).alias("std"),
        count_if(d < 5).alias("bounce"), count_if((d >= 5) & (d < 30)).alias("brief"), count_if((d >= 30) & (d < 120)).alias("engaged"), count_if(d >= 120).alias("deep"),
    )
    out = with_quantiles(out, dwell, us, (0.25, 0.5, 0.75, 0.9, 0.95), "p")
    places = lambda c: half_up(c / 100, 0) / 10_000
    score = half_up(sd(1000 * (3 * F.col("brief") + 7 * F.col("engaged") + 10 * F.col("deep")), F.col("n")), 0) / 10_000
    return out.select(
        "n", places(F.col("mean")).alias("mean"), *[places(F.get("p", F.lit(i))).alias(f"p{q}") for i, q in enumerate((25, 50, 75, 90, 95))], places(F.col("std")).alias("std"),
        "bounce", "brief", "engaged", "deep", score.alias("score"),
    )


def hourly_usage(interactions: DataFrame) -> DataFrame:
    """Events and users by hour of day and weekday (Monday is 0)."""
    return interactions.groupBy(F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"))


def cohorts(interactions: DataFrame) -> DataFrame:
    """Users by behaviour, and each cohort's size, share and means.  Users of fewer than two events are left out."""
    c = F.col
    users = gaps(interactions).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"), F.coalesce(F.sum(F.least("dwell", F.lit(1800.0))), F.lit(0.0)).alias("dwell"),
        *[n_action(a).alias(a) for a in ("view", "like", "favorite", "share", "add_cart", "purchase")],
    ).filter("n >= 2")
    users = users.select(
        "user_id", "n", ((c("like") + c("favorite") + c("share")) / c("n")).alias("eng"), ((c("add_cart") + c("purchase")) / F.greatest(c("view"), F.lit(1))).alias("conv"),
        "dwell", (c("dwell") / F.greatest(c("items"), F.lit(1))).alias("per_item"), (c("items") / c("n")).alias("div"),
    )
    cohort = (
        F.when((c("eng") > 0.3) & (c("conv") > 0.2) & (c("dwell") > 300), "power").when((c("per_item") > 60) & (c("eng") < 0.1), "casual")
        .when((c("conv") > 0.4) & (c("per_item") < 30), "quick").when((c("div") > 0.7) & (c("eng") > 0.1), "explorer").otherwise("passive")
    )
    out = users.groupBy(cohort.alias("cohort")).agg(F.count(F.lit(1)).alias("users"), F.avg("conv").alias("conversion"), F.avg("div").alias("diversity"), F.avg("dwell").alias("dwell"))
    return out.withColumn("share", c("users") / F.sum("users").over(W.partitionBy()))


def sequence_steps(interactions: DataFrame) -> DataFrame:
    """Previous and next item, seconds since the last action and session start, place in the session."""
    u, s = W.partitionBy("user_id").orderBy("ts", "event_id"), W.partitionBy("user_id", "session_id").orderBy("ts", "event_id")
    us = F.unix_micros("ts")
    return interactions.select(
        "event_id", "user_id", F.lag("item_id").over(u).alias("prev_item"), F.lead("item_id").over(u).alias("next_item"), ((us - F.lag(us).over(u)) / 1e6).alias("since_last"),
        F.row_number().over(s).cast("long").alias("session_position"), ((us - F.first(us).over(s)) / 1e6).alias("since_session_start"),
    )


def rolling(interactions: DataFrame, seconds: int) -> DataFrame:
    """Counts, mean price and distinct items of a user in [t - seconds, t), events at t excluded."""
    base = interactions.select("event_id", "user_id", "item_id", "action", "price", F.unix_micros("ts").alias("us"))
    out = recent_sums(base, ["user_id"], "us", {
        "n": Recent(seconds, F.lit(1)), "_sum": Recent(seconds, exact(F.col("price"))), "_priced": Recent(seconds, F.col("price").isNotNull().cast("int")),
        "items": Recent(seconds, distinct="item_id"), "purchases": Recent(seconds, (F.col("action") == "purchase").cast("int")),
    })
    return out.select("event_id", "n", F.when(F.col("_priced") > 0, F.col("_sum") / F.col("_priced") / 1_000_000).alias("avg_price"), "items", "purchases")


def bursts(interactions: DataFrame, seconds: int = 60, more_than: int = 20) -> DataFrame:
    """Events up to which their user had more than ``more_than`` distinct items within ``seconds``."""
    base = interactions.select("event_id", "user_id", "item_id", F.unix_micros("ts").alias("us"))
    out = recent_sums(base, ["user_id"], "us", {"items": Recent(seconds, distinct="item_id")}, with_now=True)
    return out.filter(F.col("items") > more_than).select("event_id", "user_id", "items")


def running_rates(interactions: DataFrame) -> DataFrame:
    """E14, the batch twin of I7: an item's click and conversion rates after each event."""
    base = interactions.select("event_id", "item_id", "action", F.unix_micros("ts").alias("us"))
    sums = {f"{a}s": (F.col("action") == a).cast("int") for a in ("view", "click", "purchase")}
    return running_sums(base, ["item_id"], "us", sums, ties=["event_id"]).drop("action", "us").withColumns({
        "ctr": sd(F.col("clicks"), F.col("views")), "cvr": sd(F.col("purchases"), F.col("clicks")),
    })


def item_similarity(matrix: DataFrame, least: int = 5, chunk: int = 200, full_norms: bool = False) -> DataFrame:
    """J1 (J2 with ``full_norms``): cosine of item columns over users who have both; norms over the same users, or whole.

    Pairs grow with the square of a user's history, so a longer one is dealt into chunks of about ``chunk`` items by
    a hash, and each pair of chunks is a join key of its own: every pair of items is formed once, in many tasks.
    """
    m = matrix.select("user_id", "item_id", "score")
    chunks = m.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_n"))
    dealt = m.join(chunks, "user_id").withColumn("_c", F.pmod(F.xxhash64("item_id"), F.col("_n")).cast("int"))
    a = dealt.select("user_id", F.col("_c").alias("lo"), F.explode(F.sequence("_c", F.col("_n") - 1)).alias("hi"), F.col("item_id").alias("ia"), F.col("score").alias("sa"))
    b = dealt.select("user_id", F.explode(F.sequence(F.lit(0), "_c")).alias("lo"), F.col("_c").alias("hi"), F.col("item_id").alias("ib"), F.col("score").alias("sb"))
    up = F.col("ia") < F.col("ib")
    pairs = a.join(b, ["user_id", "lo", "hi"]).filter((F.col("lo") < F.col("hi")) | up).select(
        F.least("ia", "ib").alias("item1"), F.greatest("ia", "ib").alias("item2"), F.when(up, F.col("sa")).otherwise(F.col("sb")).alias("s1"), F.when(up, F.col("sb")).otherwise(F.col("sa")).alias("s2"),
    ).groupBy("item1", "item2").agg(
        F.count(F.lit(1)).alias("users"), F.sum(F.col("s1") * F.col("s2")).alias("dot"), F.sum(F.col("s1") * F.col("s1")).alias("q1"), F.sum(F.col("s2") * F.col("s2")).alias("q2"),
    ).filter(F.col("users") >= least)
    if full_norms:
        q = m.groupBy("item_id").agg(F.sum(F.col("score") * F.col("score")).alias("q"))
        pairs = pairs.drop("q1", "q2").join(q.toDF("item1", "q1"), "item1").join(q.toDF("item2", "q2"), "item2")
    return pairs.select("item1", "item2", "users", r6(F.col("dot") / F.sqrt(F.col("q1") * F.col("q2"))).alias("similarity"))
