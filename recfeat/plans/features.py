"""Registered feature queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from recfeat import views
from recfeat.functions import exprs as X
from recfeat.functions.exprs import r6
from recfeat.operators import features as O
from recfeat.plans.catalog import register
from recfeat.views import AS_OF, SQL_AS_OF, SQL_INTERACTIONS, SQL_SESSIONS


def rounded(df, places: int = 6):
    """Doubles rounded, for comparison across engines."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _weight(scheme: str, column: str = "action") -> str:
    weights, default = X.WEIGHTS[scheme]
    return "case " + column + " " + " ".join(f"when '{a}' then {w}::double" for a, w in weights.items()) + f" else {default}::double end"


def _n(action: str, on: str = "true") -> str:
    return f"count(*) filter (where action = '{action}' and {on})"


@register("D1_user_profile", SQL_SESSIONS + f""", p as (
  select user_id, max(struct_pack(n := n, platform := platform)).platform modal_platform from (select user_id, platform, count(*) n from sessions group by all) group by 1)
select user_id, count(*) total_interactions, count(distinct item_id) unique_items, count(distinct session_id) total_sessions, count(distinct ts::date) active_days,
  round(avg({_weight('profile')}), 6) avg_weight, round(stddev_samp({_weight('profile')}), 6) std_weight,
  {', '.join(f"{_n(a)} n_{a}" for a in ('view', 'click', 'purchase', 'like', 'share'))},
  epoch_us(min(ts)) first_us, epoch_us(max(ts)) last_us, any_value(modal_platform) modal_platform
from sessions join p using (user_id) group by user_id""")
def d1(spark, sf):
    return rounded(O.user_profile(views.interactions(spark, sf, sessions=True)).drop("first_day", "last_day"))


@register("D2_user_ratios", SQL_INTERACTIONS + f"""
select user_id, round({_n('purchase')} / ({_n('view')} + 1), 6) conversion_rate, round(count(*) / (count(distinct ts::date) + 1), 6) engagement_score,
  round(count(distinct item_id) / (count(*) + 1), 6) diversity, date_diff('day', min(ts)::date, max(ts)::date) lifetime_days
from interactions group by user_id""")
def d2(spark, sf):
    return rounded(O.user_ratios(O.user_profile(views.interactions(spark, sf, sessions=True))))


@register("D3_item_stats", SQL_INTERACTIONS + f""", r as (select *, row_number() over (partition by item_id order by ts desc, event_id desc) rn from interactions),
w as (select item_id, count(*) total_interactions, count(distinct user_id) unique_users, avg({_weight('profile')}) avg_weight, {_n('view')} as views, {_n('purchase')} purchases,
  count(*) filter (where rn <= 1000) recent_interactions, avg({_weight('profile')}) filter (where rn <= 1000) recent_weight from r group by 1)
select item_id, total_interactions, unique_users, round(avg_weight, 6) avg_weight, views, purchases, recent_interactions, round(recent_weight, 6) recent_weight,
  round(0.3::double * total_interactions + 0.3::double * unique_users + 0.4::double * recent_interactions, 6) popularity, round(purchases / (views + 1), 6) conversion_rate from w""")
def d3(spark, sf):
    return rounded(O.item_stats(views.interactions(spark, sf)))


def _d4_sql() -> str:
    weight = _weight("offline")
    parts, outs = [], []
    for w, s in O.WINDOWS.items():
        on = f"ts >= {SQL_AS_OF} - interval {s} seconds"
        parts += [
            f"count(*) filter (where {on}) user_interactions_{w}", f"count(distinct item_id) filter (where {on}) user_items_{w}",
            f"count(distinct session_id) filter (where {on}) user_sessions_{w}", f"count(distinct ts::date) filter (where {on}) user_days_{w}",
            f"coalesce(sum({weight}) filter (where {on}), 0) user_engagement_{w}", f"avg({weight}) filter (where {on}) user_avg_engagement_{w}",
            f"stddev_samp({weight}) filter (where {on}) user_std_engagement_{w}", *[f"{_n(a, on)} user_{a}s_{w}" for a in ("purchase", "view", "click", "like", "share")],
            f"coalesce(list_sort(list(distinct hour(ts)::int) filter (where {on})), []) user_hours_{w}",
            f"coalesce(list_sort(list(distinct (dayofweek(ts) + 1)::int) filter (where {on})), []) user_weekdays_{w}",
            f"count(distinct platform) filter (where {on}) user_platforms_{w}",
        ]
        outs += [
            *[f"user_{c}_{w}" for c in ("interactions", "items", "sessions", "days", "purchases", "views", "clicks", "likes", "shares", "hours", "weekdays", "platforms")],
            *[f"round(user_{c}_{w}, 6) user_{c}_{w}" for c in ("engagement", "avg_engagement", "std_engagement")], f"p_{w} user_platform_{w}",
            f"round(user_purchases_{w} / (user_views_{w} + 1), 6) user_conversion_{w}", f"round(user_engagement_{w} / (user_sessions_{w} + 1), 6) user_engagement_per_session_{w}",
            f"round(user_items_{w} / (user_sessions_{w} + 1), 6) user_items_per_session_{w}", f"round(user_interactions_{w} / (user_days_{w} + 1), 6) user_intensity_{w}",
        ]
    counts = ", ".join(f"count(*) filter (where ts >= {SQL_AS_OF} - interval {s} seconds) n_{w}" for w, s in O.WINDOWS.items())
    tops = ", ".join(f"max({{'n': n_{w}, 'p': platform}}) filter (where n_{w} > 0).p p_{w}" for w in O.WINDOWS)
    span = f"ts >= {SQL_AS_OF} - interval 2592000 seconds and ts < {SQL_AS_OF}"
    return SQL_SESSIONS + f""", a as (select user_id, {', '.join(parts)} from sessions where {span} group by 1),
c as (select user_id, platform, {counts} from sessions where {span} group by 1, 2), t as (select user_id, {tops} from c group by 1)
select user_id, {', '.join(outs)}, round(user_avg_engagement_7d / (user_avg_engagement_30d + 0.001::double), 6) user_trend_engagement,
  round(user_interactions_1d / (user_interactions_7d / 7 + 0.001::double), 6) user_trend_activity from a join t using (user_id)"""


@register("D4_user_windows", _d4_sql())
def d4(spark, sf):
    return rounded(O.user_windows(views.interactions(spark, sf, sessions=True), AS_OF))


def _d5_sql() -> str:
    parts, outs = [], []
    weight = "case action when 'purchase' then 10.0::double else 1.0::double end"
    for w, s in O.WINDOWS.items():
        on = f"filter (where ts >= {SQL_AS_OF} - interval {s} seconds)"
        parts += [
            f"count(*) {on} n_{w}", f"count(distinct user_id) {on} u_{w}", f"count(distinct platform) {on} f_{w}", f"coalesce(sum({weight}) {on}, 0) e_{w}", f"avg({weight}) {on} a_{w}",
            f"stddev_samp({weight}) {on} d_{w}", f"count(case when action = 'purchase' then 1 end) {on} p_{w}", f"count(case when action = 'view' then 1 end) {on} v_{w}",
        ]
        outs += [
            f"n_{w} item_n_{w}, u_{w} item_users_{w}, f_{w} item_platforms_{w}, round(e_{w}, 6) item_engagement_{w}, round(a_{w}, 6) item_avg_engagement_{w}, round(d_{w}, 6) item_std_engagement_{w}",
            f"p_{w} item_purchases_{w}, v_{w} item_views_{w}, round(p_{w} / (v_{w} + 1), 6) item_purchase_rate_{w}, round(ln(1 + n_{w}) * ln(1 + u_{w}), 6) item_popularity_{w}",
        ]
    return SQL_INTERACTIONS + f""", a as (select item_id, {', '.join(parts)} from interactions where ts >= {SQL_AS_OF} - interval 2592000 seconds and ts < {SQL_AS_OF} group by 1)
select item_id, {', '.join(outs)}, round(ln(1 + n_7d) * ln(1 + u_7d) / (ln(1 + n_30d) * ln(1 + u_30d) + 0.001::double), 6) item_trend_popularity,
  round(a_1d / (a_7d + 0.001::double), 6) item_trend_engagement from a"""


@register("D5_item_windows", _d5_sql())
def d5(spark, sf):
    return rounded(O.item_windows(views.interactions(spark, sf), AS_OF))


@register("D6_pair_features", SQL_INTERACTIONS + f""", a as (select user_id, item_id, count(*) n, sum({_weight('behaviour')}) engagement, {_n('view')} as views, {_n('purchase')} purchases,
  date_diff('day', min(ts)::date, max(ts)::date) span_days, string_agg(action, '>' order by ts, event_id) action_path, last(action order by ts, event_id) last_action from interactions group by 1, 2)
select user_id, item_id, n, round(engagement, 6) engagement, views, purchases, span_days, round(purchases / (views + 1), 6) conversion, round(engagement / (span_days + 1), 6) intensity, last_action, purchases > 0 has_purchase, action_path from a""")
def d6(spark, sf):
    return rounded(O.pair_features(views.interactions(spark, sf)))


@register("D7_user_item_matrix", SQL_INTERACTIONS + f""", a as (select user_id, item_id, sum({_weight('profile')}) score, count(*) n, exp(-(epoch_us({SQL_AS_OF}) - epoch_us(max(ts))) / 1e6 / 86400.0) f from interactions group by 1, 2)
select user_id, item_id, round(score, 6) score, n, round(f, 6) time_decay, round(score * f, 6) weighted_score from a""")
def d7(spark, sf):
    return rounded(O.user_item_matrix(views.interactions(spark, sf), AS_OF))


_D8 = {"1d": 86_400, "3d": 259_200, "7d": 604_800, "14d": 1_209_600, "30d": 2_592_000}


@register("D8_user_window_stats", SQL_SESSIONS + f""", w as (select * from (values {', '.join(f"('{w}', {s})" for w, s in _D8.items())}) t("window", seconds)),
a as (select user_id, "window", {', '.join(f"{_n(a)} n_{a}" for a in ('impression', 'click', 'view', 'add_cart', 'purchase', 'favorite', 'share'))}, count(distinct item_id) items, count(distinct category_id) categories,
  count(distinct item_id) filter (where action = 'purchase') bought, count(distinct ts::date) active_days, count(distinct session_id) sessions,
  coalesce(sum(price) filter (where action = 'purchase'), 0) order_sum, coalesce(avg(price) filter (where action = 'purchase'), 0) order_avg, coalesce(max(price) filter (where action = 'purchase'), 0) order_max
  from sessions join w on (epoch_us({SQL_AS_OF}) - epoch_us(ts)) / 1e6 <= seconds where ts < {SQL_AS_OF} group by 1, 2)
select * exclude (bought, order_sum, order_avg, order_max), round(order_sum, 6) order_sum, round(order_avg, 6) order_avg, round(order_max, 6) order_max, greatest(0, n_purchase - bought) repeat_purchases,
  round(case when n_view = 0 then 0 else n_click / n_view end, 6) click_rate, round(case when n_click = 0 then 0 else n_add_cart / n_click end, 6) cart_rate, round(case when n_click = 0 then 0 else n_purchase / n_click end, 6) purchase_rate from a""")
def d8(spark, sf):
    return rounded(O.user_window_stats(views.interactions(spark, sf, sessions=True), AS_OF, _D8))


@register("D9_top_categories", SQL_INTERACTIONS + """, c as (select user_id, category_id, count(*) n from interactions group by 1, 2), r as (select *, row_number() over (partition by user_id order by n desc, category_id) rn from c)
select user_id, string_agg(category_id::varchar, ',' order by rn) top_categories from r where rn <= 3 group by 1""")
def d9(spark, sf):
    return O.top_values(views.interactions(spark, sf), ["user_id"], "category_id", 3, "top_categories")


@register("D10_item_window_stats", SQL_INTERACTIONS + f""", u as (select item_id, user_id, {', '.join(f"{_n(a, 'ts >= s')} n_{a}" for a in ('impression', 'click', 'view', 'add_cart', 'purchase'))}, {_n('view', 'ts < s')} pv,
  coalesce(sum(price) filter (where ts >= s and action = 'purchase'), 0) revenue from interactions, (select {SQL_AS_OF} - interval 604800 seconds s) where ts >= {SQL_AS_OF} - interval 1209600 seconds and ts < {SQL_AS_OF} group by 1, 2),
a as (select item_id, {', '.join(f"sum(n_{a})::bigint n_{a}" for a in ('impression', 'click', 'view', 'add_cart', 'purchase'))}, sum(pv)::bigint prev_views, count(*) filter (where n_view > 0) viewers, count(*) filter (where n_purchase > 0) buyers, count(*) filter (where n_purchase > 1) repeat_buyers, round(sum(revenue), 6) revenue from u group by 1)
select *, round(case when n_impression = 0 then 0 else n_click / n_impression end, 6) ctr, round(case when n_click = 0 then 0 else n_view / n_click end, 6) view_rate, round(case when n_view = 0 then 0 else n_add_cart / n_view end, 6) cart_rate,
  round(case when n_view = 0 then 0 else n_purchase / n_view end, 6) purchase_rate, round(least(1.0::double, viewers / 1000.0::double), 6) popularity, round(case when prev_views = 0 then 0 else (n_view - prev_views) / prev_views end, 6) trend from a""")
def d10(spark, sf):
    return rounded(O.item_window_stats(views.interactions(spark, sf), AS_OF, 604_800))


_SESSION_CTE = SQL_SESSIONS + f""", s as (select user_id, session_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 duration, count(*) events, count(distinct item_id) items, sum({_weight('engagement')}) engagement,
  max((action = 'purchase')::int)::bigint converted from sessions group by 1, 2 having count(*) >= 2)"""


@register("D12_session_stats", _SESSION_CTE + """ select user_id, session_id, round(duration, 6) duration, events, items, round(engagement, 6) engagement, converted, round(events / greatest(duration / 60, 0.1::double), 6) actions_per_minute from s""")
def d12(spark, sf):
    return rounded(O.session_stats(views.interactions(spark, sf, sessions=True)))


@register("D13_session_summary", _SESSION_CTE + """ select count(*) sessions, round(avg(duration), 6) mean_duration, round(quantile_cont(duration, 0.5), 6) median_duration, round(avg(events), 6) events_per_session, round(avg(items), 6) items_per_session,
  round(avg(converted), 6) conversion, round(avg((engagement > 5)::int), 6) high_engagement, count(*) filter (where duration < 60) under_1m, count(*) filter (where duration >= 60 and duration < 300) under_5m,
  count(*) filter (where duration >= 300 and duration < 900) under_15m, count(*) filter (where duration >= 900) longer from s""")
def d13(spark, sf):
    return rounded(O.session_summary(O.session_stats(views.interactions(spark, sf, sessions=True))))


_DWELL = SQL_INTERACTIONS + """, g as (select *, (lead(epoch_us(ts)) over (partition by user_id order by ts, event_id) - epoch_us(ts)) / 1e6 d from interactions)"""
_D14 = (0.25, 0.5, 0.75, 0.9, 0.95)


@register("D14_dwell_distribution", _DWELL + """, o as (select *, round(d * 1e6)::hugeint us, row_number() over (order by d) - 1 i from g where d is not null), c as (select count(*) n from o),
p as (select """ + ", ".join(f"max(us) filter (where i = floor({p}::double * (n - 1)))::double + (max(us) filter (where i = ceil({p}::double * (n - 1))) - max(us) filter (where i = floor({p}::double * (n - 1))))::double * max({p}::double * (n - 1) - floor({p}::double * (n - 1))) q{round(p * 100)}" for p in _D14) + """ from o, c),
a as (select count(*) n, sum(us)::double / count(*) mean, sqrt(sum(us * us)::double / count(*) - (sum(us)::double / count(*)) * (sum(us)::double / count(*))) std, count(*) filter (where d < 5) bounce, count(*) filter (where d >= 5 and d < 30) brief,
  count(*) filter (where d >= 30 and d < 120) engaged, count(*) filter (where d >= 120) deep from o)
select n, """ + ", ".join(f"floor({x} / 100::double + 0.5::double) / 1e4::double {y}" for x, y in [("mean", "mean"), *[(f"q{round(p * 100)}", f"p{round(p * 100)}") for p in _D14], ("std", "std")]) + """,
  bounce, brief, engaged, deep, floor(1000 * (3 * brief + 7 * engaged + 10 * deep) / n + 0.5::double) / 1e4::double score from a, p""")
def d14(spark, sf):
    return O.dwell_distribution(O.gaps(views.interactions(spark, sf)))


@register("D15_usage_patterns", SQL_INTERACTIONS + """ select (isodow(ts) - 1)::int weekday, hour(ts)::int as hour, count(*) events, count(distinct user_id) users from interactions group by 1, 2""")
def d15(spark, sf):
    return O.hourly_usage(views.interactions(spark, sf))


@register("D18_user_cohorts", _DWELL + f""", u as (select user_id, count(*) n, count(distinct item_id) items, coalesce(sum(least(d, 1800.0::double)), 0) dwell, {_n('view')} v, {_n('like')} + {_n('favorite')} + {_n('share')} e, {_n('add_cart')} + {_n('purchase')} c from g group by 1 having count(*) >= 2),
x as (select user_id, e / n eng, c / greatest(v, 1) conv, dwell, dwell / greatest(items, 1) per_item, items / n div from u),
k as (select case when eng > 0.3 and conv > 0.2 and dwell > 300 then 'power' when per_item > 60 and eng < 0.1 then 'casual' when conv > 0.4 and per_item < 30 then 'quick' when div > 0.7 and eng > 0.1 then 'explorer' else 'passive' end cohort, * from x)
select cohort, count(*) users, round(avg(conv), 6) conversion, round(avg(div), 6) diversity, round(avg(dwell), 4) dwell, round(count(*) / sum(count(*)) over (), 6) share from k group by 1""")
def d18(spark, sf):
    return rounded(O.cohorts(views.interactions(spark, sf))).withColumn("dwell", F.round("dwell", 4))


@register("E1_last_n_per_item", SQL_INTERACTIONS + """ select event_id, item_id, user_id, action from (select *, row_number() over (partition by item_id order by ts desc, event_id desc) rn from interactions) where rn <= 20""")
def e1(spark, sf):
    return O.last_n(views.interactions(spark, sf), "item_id", 20).select("event_id", "item_id", "user_id", "action")


@register("E2_sequence_steps", SQL_SESSIONS + """ select event_id, user_id, lag(item_id) over u prev_item, lead(item_id) over u next_item, round((epoch_us(ts) - lag(epoch_us(ts)) over u) / 1e6, 6) since_last, row_number() over s session_position,
  round((epoch_us(ts) - first(epoch_us(ts)) over s) / 1e6, 6) since_session_start from sessions window u as (partition by user_id order by ts, event_id), s as (partition by user_id, session_id order by ts, event_id)""")
def e2(spark, sf):
    return rounded(O.sequence_steps(views.interactions(spark, sf, sessions=True)))


@register("E6_rolling_7d", SQL_INTERACTIONS + """ select event_id, count(event_id) over w n, round(avg(price) over w, 6) avg_price, len(list_distinct(coalesce(list(item_id) over w, []))) items, count(*) filter (where action = 'purchase') over w purchases
  from interactions window w as (partition by user_id order by epoch_us(ts) range between 604800000000 preceding and 1 preceding)""")
def e6(spark, sf):
    return rounded(O.rolling(views.interactions(spark, sf), 604_800))


@register("E9_action_shares", SQL_INTERACTIONS + """ select action, count(*) n, round(count(*) / sum(count(*)) over (), 6) share from interactions group by 1""")
def e9(spark, sf):
    from pyspark.sql.window import Window as W

    out = views.interactions(spark, sf).groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", r6(F.col("n") / F.sum("n").over(W.partitionBy())))


@register("E10_category_rank", SQL_INTERACTIONS + f""" select category_id, item_id, {_n('view')} as views, rank() over (partition by category_id order by {_n('view')} desc) category_rank from interactions where ts >= {SQL_AS_OF} - interval 7 days group by 1, 2""")
def e10(spark, sf):
    from pyspark.sql.window import Window as W

    recent = views.interactions(spark, sf).filter(F.col("ts") >= O.since(AS_OF, 604_800))
    out = recent.groupBy("category_id", "item_id").agg(O.n_action("view").alias("views"))
    return out.withColumn("category_rank", F.rank().over(W.partitionBy("category_id").orderBy(F.desc("views"))).cast("long"))


@register("E12_sessionize", SQL_SESSIONS + """ select session_id, user_id, count(*) events, epoch_us(min(ts)) start_us, epoch_us(max(ts)) end_us from sessions group by 1, 2""")
def e12(spark, sf):
    return views.interactions(spark, sf, sessions=True).groupBy("session_id", "user_id").agg(F.count(F.lit(1)).alias("events"), F.min(F.unix_micros("ts")).alias("start_us"), F.max(F.unix_micros("ts")).alias("end_us"))


@register("E13_action_patterns", SQL_INTERACTIONS + """, l as (select event_id, user_id, action, lag(action) over w a1, lag(action, 2) over w a2 from interactions window w as (partition by user_id order by ts, event_id))
select event_id, user_id, a2 || '>' || a1 || '>' || action path from l where a2 = 'view' and a1 = 'click' and action in ('purchase', 'like')""")
def e13(spark, sf):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    steps = views.interactions(spark, sf).select("event_id", "user_id", "action", F.lag("action").over(w).alias("a1"), F.lag("action", 2).over(w).alias("a2"))
    hits = steps.filter((F.col("a2") == "view") & (F.col("a1") == "click") & F.col("action").isin("purchase", "like"))
    return hits.select("event_id", "user_id", F.concat_ws(">", "a2", "a1", "action").alias("path"))


@register("E14_running_rates", SQL_INTERACTIONS + """, a as (select event_id, item_id, count(*) filter (where action = 'view') over w as views, count(*) filter (where action = 'click') over w clicks, count(*) filter (where action = 'purchase') over w purchases
  from interactions window w as (partition by item_id order by ts, event_id rows unbounded preceding))
select *, round(case when views = 0 then 0 else clicks / views end, 6) ctr, round(case when clicks = 0 then 0 else purchases / clicks end, 6) cvr from a""")
def e14(spark, sf):
    return rounded(O.running_rates(views.interactions(spark, sf)))


def _sim_sql(full: bool) -> str:
    norms = "sqrt(any_value(n1.q) * any_value(n2.q))" if full else "sqrt(sum(a.score * a.score) * sum(b.score * b.score))"
    joins = " join q n1 on n1.item_id = a.item_id join q n2 on n2.item_id = b.item_id" if full else ""
    return SQL_INTERACTIONS + f""", m as (select user_id, item_id, sum({_weight('profile')}) score from interactions group by 1, 2), q as (select item_id, sum(score * score) q from m group by 1)
select a.item_id item1, b.item_id item2, count(*) users, round(sum(a.score * b.score) / {norms}, 6) similarity from m a join m b on a.user_id = b.user_id and a.item_id < b.item_id{joins} group by 1, 2 having count(*) >= 5"""


@register("J1_item_similarity", _sim_sql(False))
def j1(spark, sf):
    return O.item_similarity(O.user_item_matrix(views.interactions(spark, sf), AS_OF))


@register("J2_item_cosine", _sim_sql(True))
def j2(spark, sf):
    return O.item_similarity(O.user_item_matrix(views.interactions(spark, sf), AS_OF), full_norms=True)
