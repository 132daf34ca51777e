"""Registered window queries: the batch twins of the streaming operators, and streams run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from recfeat import views
from recfeat.functions import exprs as X
from recfeat.functions.exprs import r6, seconds_between
from recfeat.operators import features as O
from recfeat.plans.catalog import register
from recfeat.plans.features import _n, _weight, rounded
from recfeat.plans.metrics import _BUCKET
from recfeat.streaming import sinks, windows
from recfeat.views import AS_OF, SQL_AS_OF, SQL_INTERACTIONS

_SEC = "epoch_us({}) // 1000000"


def _tumble(minutes: int) -> str:
    return SQL_INTERACTIONS + f", t as (select *, epoch_us(time_bucket(interval {minutes} minutes, ts)) // 1000000 start_s from interactions)"


def _hop(size: int, slide: int) -> str:
    return SQL_INTERACTIONS + f""", t as (select *, (epoch_us(ts) // 1000000 // {slide * 60} - k) * {slide * 60} start_s from interactions, range({size // slide}) r(k))"""


@register("I2_user_tumbling", _tumble(5) + f""" select start_s, start_s + 300 end_s, user_id, count(*) events, count(distinct item_id) items, count(distinct category_id) categories, {_n('view')} as views, {_n('click')} clicks, {_n('purchase')} purchases,
  round(avg(price), 6) avg_price, min(price) min_price, max(price) max_price from t group by 1, 2, 3""")
def i2(spark, sf):
    return rounded(windows.user_tumbling(views.interactions(spark, sf)))


@register("I3_user_hopping", _hop(30, 5) + f""" select start_s, start_s + 1800 end_s, user_id, count(*) events, round(sum(case when action = 'favorite' then 0 else {_weight('stream')} end), 6) engagement, count(distinct category_id) categories, round({_n('purchase')} / count(*), 6) purchase_rate,
  round(avg(price), 6) avg_price, string_agg(distinct category_id::varchar, ',' order by category_id::varchar) category_list from t group by 1, 2, 3""")
def i3(spark, sf):
    return rounded(windows.user_hopping(views.interactions(spark, sf)))


@register("I4_item_tumbling", _tumble(10) + f""" select start_s, start_s + 600 end_s, item_id, {_n('view')} as views, {_n('click')} clicks, {_n('purchase')} purchases, count(distinct user_id) users,
  round(case when {_n('view')} = 0 then 0 else {_n('click')} / {_n('view')} end, 6) ctr, round(case when {_n('click')} = 0 then 0 else {_n('purchase')} / {_n('click')} end, 6) cvr from t group by 1, 2, 3""")
def i4(spark, sf):
    return rounded(windows.item_tumbling(views.interactions(spark, sf)))


# A session window also closes at exactly the gap, so a gap of 30 minutes separates.
_SESS = SQL_INTERACTIONS + """, g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over w < 1800000000 then 0 else 1 end fresh from interactions window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) k from g)"""


@register("I5_session_windows", _SESS + """ select epoch_us(min(ts)) start_us, user_id, count(*) events, count(distinct item_id) items, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) duration, string_agg(action, '>' order by ts, event_id) actions, bool_or(action = 'purchase') has_purchase from s group by user_id, k""")
def i5(spark, sf):
    return rounded(windows.sessions(views.interactions(spark, sf)))


@register("I6_behaviour_sliding", _hop(10, 2) + f""" select start_s, start_s + 600 end_s, user_id, count(*) events, count(distinct item_id) items, {', '.join(f"{_n(a)} n_{a}" for a in ('view', 'click', 'add_cart', 'purchase'))}, round(sum({_weight('stream')}), 6) weight, epoch_us(max(ts)) last_us from t group by 1, 2, 3""")
def i6(spark, sf):
    return rounded(windows.behaviour(views.interactions(spark, sf)))


@register("I11_item_sliding", _hop(20, 5) + f""" select start_s, start_s + 1200 end_s, item_id, {_n('impression')} exposures, {_n('click')} clicks, {_n('purchase')} purchases, round({_n('click')} / greatest({_n('impression')}, 1), 6) ctr, round({_n('purchase')} / greatest({_n('click')}, 1), 6) cvr,
  round(ln(1 + {_n('click')} + {_n('purchase')}), 6) popularity from t group by 1, 2, 3""")
def i11(spark, sf):
    return rounded(windows.item_sliding(views.interactions(spark, sf)))


@register("I12_decayed_popularity", SQL_INTERACTIONS + f""", a as (select item_id, epoch_us({SQL_AS_OF}) / 1e6 - epoch_us(ts) / 1e6 age, {_weight('profile')} w from interactions)
select item_id, round(sum(w * exp(-age / 86400)) filter (where age <= 604800), 6) popularity_7d, round(sum(w * exp(-age / 604800)), 6) popularity_all from a group by 1 having sum(w) filter (where age <= 604800) is not null""")
def i12(spark, sf):
    age = seconds_between(F.lit(AS_OF).cast("timestamp"), F.col("ts"))
    a = views.interactions(spark, sf).select("item_id", age.alias("age"), X.action_weight(F.col("action"), "profile").alias("w"))
    out = a.groupBy("item_id").agg(F.sum(F.when(F.col("age") <= 604_800, F.col("w") * F.exp(-F.col("age") / 86_400))).alias("popularity_7d"), F.sum(F.col("w") * F.exp(-F.col("age") / 604_800)).alias("popularity_all"))
    return rounded(out.filter("popularity_7d is not null"))


@register("I14_capped_interest", SQL_INTERACTIONS + f" select user_id, category_id, round(least(10, sum({_weight('profile')} * 0.1::double)), 6) interest from interactions group by 1, 2")
def i14(spark, sf):
    w = X.action_weight(F.col("action"), "profile") * 0.1
    return views.interactions(spark, sf).groupBy("user_id", "category_id").agg(r6(F.least(F.lit(10.0), F.sum(w))).alias("interest"))


@register("I15_active_hours", SQL_INTERACTIONS + """, h as (select user_id, hour(ts) h, count(*) n from interactions group by 1, 2) select user_id, string_agg(h || ':' || n, ',' order by h) as hours from h group by 1""")
def i15(spark, sf):
    by = views.interactions(spark, sf).groupBy("user_id", F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("h", "n"))), lambda x: F.concat_ws(":", x["h"].cast("string"), x["n"].cast("string")))
    return by.groupBy("user_id").agg(F.array_join(listed, ",").alias("hours"))


@register("I16_ab_hourly", SQL_INTERACTIONS + f""" select epoch_us(date_trunc('hour', ts)) // 1000000 start_s, epoch_us(date_trunc('hour', ts)) // 1000000 + 3600 end_s, {_BUCKET} grp, count(*) events, round(case when {_n('view')} = 0 then 0 else {_n('click')} / {_n('view')} end, 6) ctr,
  round(case when {_n('click')} = 0 then 0 else {_n('purchase')} / {_n('click')} end, 6) cvr, round(avg(price), 6) avg_value from interactions group by 1, 2, 3""")
def i16(spark, sf):
    return rounded(windows.ab_hourly(views.interactions(spark, sf)))


@register("A9_long_features", _tumble(5) + f""" select 'user_5m' feature_type, user_id::varchar feature_key, '{{"views":' || {_n('view')} || ',"clicks":' || {_n('click')} || '}}' feature_value, start_s + 300 update_time from t group by user_id, start_s""")
def a9(spark, sf):
    w = windows.user_tumbling(views.interactions(spark, sf)).select("user_id", "views", "clicks", "end_s")
    return sinks.long_features(w, "user_5m", "user_id", "end_s")


@register("A11_serving_keys", _tumble(10) + f""", l as (select item_id, max(start_s) + 600 e from t group by 1)
select 'item:' || t.item_id feature_key, (count(*) filter (where action = 'view'))::varchar as views, (count(*) filter (where action = 'click'))::varchar clicks, e + 3600 expires_at from t join l on t.item_id = l.item_id and start_s + 600 = e group by t.item_id, e""")
def a11(spark, sf):
    w = windows.item_tumbling(views.interactions(spark, sf)).groupBy("item_id").agg(F.max_by(F.struct("views", "clicks", "end_s"), "end_s").alias("x")).select("item_id", "x.*")
    out = sinks.serving_map(w, "item", "item_id", "end_s", 3600)
    return out.select("feature_key", F.element_at("features", "views").alias("views"), F.element_at("features", "clicks").alias("clicks"), "expires_at")


@register("I8_closed_windows", SQL_INTERACTIONS + """, e as (select *, epoch_us(ts) us from interactions),
u as (select user_id, us // 300000000 w, count(*) act, avg(price) avgp from e group by 1, 2), i as (select item_id, us // 600000000 w, count(*) pop from e group by 1, 2),
x as (select event_id, e.user_id, e.item_id, price, coalesce(act, 0) act, coalesce(avgp, 0) avgp, coalesce(pop, 0) pop from e
  left join u on u.user_id = e.user_id and u.w = us // 300000000 - 1 left join i on i.item_id = e.item_id and i.w = us // 600000000 - 1)
select event_id, user_id, item_id, (act * pop)::double activity_popularity_match, round(abs(avgp - price) / greatest(avgp, 1), 6) price_sensitivity,
  round(0.3::double * least(act / 100, 1) + 0.3::double * least(pop / 1000, 1) + 0.4::double * (1 - least(abs(avgp - price) / greatest(avgp, 1), 1)), 6) personalized_score from x""")
def i8(spark, sf):
    return rounded(windows.cross_scores(views.interactions(spark, sf)).drop("ts"))
