"""Registered queries: the further parts of operators whose main part stands in the other modules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recfeat import views
from recfeat.functions import exprs as X
from recfeat.functions.exprs import count_if, m1, r6, sd
from recfeat.operators import features as O
from recfeat.operators import recall as R
from recfeat.operators import store as S
from recfeat.operators import text as M
from recfeat.plans.catalog import register
from recfeat.plans.features import _n, _weight
from recfeat.plans.metrics import _RECS, _recs
from recfeat.plans.more import _WATCH, _watches
from recfeat.plans.profiles import _ITEM_TAGS, _SENT, _item_tags
from recfeat.views import AS_OF, SQL_AS_OF, SQL_INTERACTIONS, SQL_SESSIONS


def _since(days: float):
    return F.col("ts") >= O.since(AS_OF, int(days * 86_400))


def _sql_since(days: int) -> str:
    return f"ts >= {SQL_AS_OF} - interval {days} days"


@register("A12_fresh_snapshots", SQL_INTERACTIONS + f""", s as (select user_id, item_id, count(*)::double score, max(ts) made from interactions group by 1, 2),
f as (select user_id, item_id, score, strftime(made, '%Y-%m-%d') dt from s where made >= {SQL_AS_OF} - interval 24 hours)
select *, row_number() over (partition by user_id order by score desc, item_id) rank from f qualify row_number() over (partition by user_id order by score desc, item_id) <= 10000""")
def a12(spark, sf):
    """Candidates that are less than a day old are taken again, at most 10,000 a user."""
    s = views.interactions(spark, sf).groupBy("user_id", "item_id").agg(F.count(F.lit(1)).cast("double").alias("score"), F.max("ts").alias("ts"))
    return R.top_k(s.filter(_since(1)).select("user_id", "item_id", "score", F.date_format("ts", "yyyy-MM-dd").alias("dt")), 10_000, "score", "item_id", ["user_id"])


@register("A18_hot_users", SQL_INTERACTIONS + f""", v as (select user_id from interactions group by 1 having sum(price) filter (where action = 'purchase') > 2000), h as (select user_id from interactions where ts >= {SQL_AS_OF} - interval 25 hours)
select distinct user_id from (select * from v union all select * from h)""")
def a18(spark, sf):
    """Big spenders and users of the last hour of data, all of them."""
    it = views.interactions(spark, sf)
    spenders = it.groupBy("user_id").agg(F.sum(F.when(F.col("action") == "purchase", F.col("price"))).alias("paid")).filter("paid > 2000").select("user_id")
    return spenders.union(it.filter(_since(25 / 24)).select("user_id")).distinct()


@register("B17_search_intent", SQL_SESSIONS + """, a as (select session_id, count(distinct category_id) cats, count(*) n, count(*) filter (where action = 'view') looks, bool_or(platform = 'Mobile') mobile, min(ts) ts from sessions group by 1)
select session_id, case when cats = 1 and n > 1 then 'focused' when cats > 3 then 'exploring' else 'mixed' end intent, looks, mobile and dayofmonth(ts) <= 7 campaign from a""")
def b17(spark, sf):
    """The campaign runs for mobile users in the first week of a month."""
    a = views.interactions(spark, sf, sessions=True).groupBy("session_id").agg(
        F.countDistinct("category_id").alias("cats"), F.count(F.lit(1)).alias("n"), count_if(F.col("action") == "view").alias("looks"), F.bool_or(F.col("platform") == "Mobile").alias("mobile"), F.min("ts").alias("ts"),
    )
    intent = F.when((F.col("cats") == 1) & (F.col("n") > 1), "focused").when(F.col("cats") > 3, "exploring").otherwise("mixed")
    return a.select("session_id", intent.alias("intent"), "looks", (F.col("mobile") & (F.dayofmonth("ts") <= 7)).alias("campaign"))


@register("B20_item_levels", SQL_INTERACTIONS + f""", a as (select item_id, count(*) filter (where {_sql_since(3)}) n3, count(*) filter (where {_sql_since(7)}) n7, count(*) filter (where {_sql_since(30)}) n30 from interactions group by 1),
t as (select *, case when n3 = 0 then 0.0::double else greatest(-1, least(1, (n7 / (7.0::double / 3) - n3) / n3)) end t7, case when n7 = 0 then 0.0::double else greatest(-1, least(1, (n30 / (30.0::double / 7) - n7) / n7)) end t30 from a)
select item_id, case when n7 >= 7000 then 'viral' when n7 >= 700 then 'hot' when n7 >= 70 then 'warm' else 'cold' end popularity, case when t30 > 0.2 then 'decline' when t30 < -0.2 then 'growth' else 'mature' end maturity, round(least(1, abs(t7 - t30)), 6) seasonality from t""")
def b20(spark, sf):
    a = views.interactions(spark, sf).groupBy("item_id").agg(*[count_if(_since(d)).alias(f"n{d}") for d in (3, 7, 30)])
    a = a.withColumns({"t7": X.trend(F.col("n7"), F.col("n3"), 7 / 3), "t30": X.trend(F.col("n30"), F.col("n7"), 30 / 7)})
    popularity = F.when(F.col("n7") >= 7000, "viral").when(F.col("n7") >= 700, "hot").when(F.col("n7") >= 70, "warm").otherwise("cold")
    maturity = F.when(F.col("t30") > 0.2, "decline").when(F.col("t30") < -0.2, "growth").otherwise("mature")
    return a.select("item_id", popularity.alias("popularity"), maturity.alias("maturity"), r6(F.least(F.lit(1.0), F.abs(F.col("t7") - F.col("t30")))).alias("seasonality"))


_D9_DAYS = (1, 3, 7, 14, 30)


@register("D9_window_preferences", SQL_INTERACTIONS + f""", w(days) as (values {", ".join(f"({d})" for d in _D9_DAYS)}), x as (select days, user_id, brand_id, price from interactions, w where ts >= {SQL_AS_OF} - to_days(days)),
c as (select days, user_id, brand_id, count(*) n from x group by 1, 2, 3), r as (select *, row_number() over (partition by days, user_id order by n desc, brand_id) rn from c),
t as (select days, user_id, string_agg(brand_id::varchar, ',' order by rn) top_brands from r where rn <= 3 group by 1, 2)
select x.days, x.user_id, any_value(top_brands) top_brands, min(price) least_price, max(price) most_price from x join t on t.days = x.days and t.user_id = x.user_id group by 1, 2""")
def d9(spark, sf):
    """Counted once a user, brand and shortest window, then summed into the longer ones."""
    age = F.ceil(X.seconds_between(F.lit(AS_OF).cast("timestamp"), F.col("ts")) / 86_400)
    shortest = F.when(age <= 0, _D9_DAYS[0])
    for d in _D9_DAYS:
        shortest = shortest.when(age <= d, d)
    it = views.interactions(spark, sf).withColumn("days", shortest).filter("days is not null")
    one = it.groupBy("days", "user_id", "brand_id").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("lo"), F.max("price").alias("hi"))
    windows = F.filter(F.array(*[F.lit(d) for d in _D9_DAYS]), lambda d: d >= F.col("days"))
    c = one.withColumn("days", F.explode(windows)).groupBy("days", "user_id", "brand_id").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rank = F.row_number().over(W.partitionBy("days", "user_id").orderBy(F.desc("n"), F.asc("brand_id")))
    top = F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "brand_id"))))
    return c.withColumn("rank", rank).groupBy("days", "user_id").agg(
        F.array_join(F.transform(top, lambda x: x["brand_id"].cast("string")), ",").alias("top_brands"), F.min("lo").alias("least_price"), F.max("hi").alias("most_price"),
    )


@register("D10_item_velocity", SQL_INTERACTIONS + f""", a as (select item_id, count(*) filter (where {_sql_since(7)} and action = 'view') views, count(*) filter (where not ({_sql_since(7)}) and {_sql_since(14)} and action = 'view') prev,
  count(*) filter (where not ({_sql_since(7)}) and {_sql_since(14)}) prev_n, avg(price) filter (where {_sql_since(7)}) mean_price from interactions group by 1)
select item_id, views, prev, round(case when prev = 0 then 0 else (views - prev) / prev end, 6) trend, round(case when prev_n = 0 then 0 else views / prev_n end, 6) velocity, round(mean_price, 6) mean_price from a""")
def d10(spark, sf):
    now, before = _since(7), ~_since(7) & _since(14)
    view = F.col("action") == "view"
    a = views.interactions(spark, sf).groupBy("item_id").agg(count_if(now & view).alias("views"), count_if(before & view).alias("prev"), count_if(before).alias("prev_n"), F.avg(F.when(now, F.col("price"))).alias("mean_price"))
    return a.select("item_id", "views", "prev", r6(sd(F.col("views") - F.col("prev"), F.col("prev"))).alias("trend"), r6(sd(F.col("views"), F.col("prev_n"))).alias("velocity"), r6("mean_price").alias("mean_price"))


_DWELL = SQL_SESSIONS + """, g as (select *, epoch_us(lead(ts) over (partition by session_id order by ts, event_id)) - epoch_us(ts) gap from sessions),
e as (select *, case when gap is not null then least(gap, 1800000000) / 1e6 end dwell from g),
s as (select session_id, any_value(user_id) user_id, count(*) n, coalesce(sum(dwell), 0) dwell, avg(dwell) mean_dwell, max((action = 'purchase')::int) bought, avg((action in ('click', 'add_cart', 'purchase'))::int) engaged,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 duration, least(1.0::double, avg(price) / 500) scroll from e group by 1 having count(*) >= 2)"""


def _dwell(spark, sf):
    """Sessions with dwell times: the time to the session's next event."""
    w = W.partitionBy("session_id").orderBy("ts", "event_id")
    dwell = F.least(F.unix_micros(F.lead("ts").over(w)) - F.unix_micros("ts"), F.lit(1_800_000_000)) / 1e6
    e = views.interactions(spark, sf, sessions=True).withColumn("dwell", F.when(F.lead("ts").over(w).isNotNull(), dwell))
    return e.groupBy("session_id").agg(
        F.first("user_id").alias("user_id"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dwell"), F.lit(0.0)).alias("dwell"), F.avg("dwell").alias("mean_dwell"), F.max((F.col("action") == "purchase").cast("int")).alias("bought"),
        F.avg(F.col("action").isin("click", "add_cart", "purchase").cast("int")).alias("engaged"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("duration"), F.least(F.lit(1.0), F.avg("price") / 500).alias("scroll"),
    ).filter("n >= 2")


@register("D12_session_dwell", _DWELL + " select session_id, user_id, n, round(dwell, 6) dwell, round(mean_dwell, 6) mean_dwell, round(scroll, 6) scroll from s")
def d12(spark, sf):
    """The depth of scrolling, which the events lack, is the mean price in parts of 500."""
    return _dwell(spark, sf).select("session_id", "user_id", "n", r6("dwell").alias("dwell"), r6("mean_dwell").alias("mean_dwell"), r6("scroll").alias("scroll"))


@register("D16_usage_grade", _DWELL + """, u as (select user_id, avg(duration) d, avg(n) n, avg(bought) c, avg(mean_dwell) w, avg(engaged) g from s group by 1)
select user_id, round(least(d / 300, 1) * 2 + least(n / 10, 1) * 2 + c * 3 + least(w / 60, 1) * 2 + g, 6) intensity, case when d > 600 and c > 0.3 and g > 0.6 then 'PREMIUM' when d > 300 and c > 0.15 and g > 0.4 then 'GOOD' when d > 120 and g > 0.2 then 'MODERATE' else 'LOW' end grade from u""")
def d16(spark, sf):
    u = _dwell(spark, sf).groupBy("user_id").agg(*[F.avg(c).alias(n) for c, n in (("duration", "d"), ("n", "n"), ("bought", "c"), ("mean_dwell", "w"), ("engaged", "g"))])
    one, d, c, g = F.lit(1.0), F.col("d"), F.col("c"), F.col("g")
    score = F.least(d / 300, one) * 2 + F.least(F.col("n") / 10, one) * 2 + c * 3 + F.least(F.col("w") / 60, one) * 2 + g
    grade = F.when((d > 600) & (c > 0.3) & (g > 0.6), "PREMIUM").when((d > 300) & (c > 0.15) & (g > 0.4), "GOOD").when((d > 120) & (g > 0.2), "MODERATE").otherwise("LOW")
    return u.select("user_id", r6(score).alias("intensity"), grade.alias("grade"))


@register("D23_session_level", SQL_SESSIONS + """, s as (select session_id, count(*) n, count(distinct item_id) items, max((action = 'purchase')::int) bought from sessions group by 1)
select count(*) sessions, round(avg(n), 6) events_per_session, round(avg(items), 6) items_per_session, round(avg(bought), 6) conversion, round(avg((n = 1)::int), 6) bounce from s""")
def d23(spark, sf):
    s = views.interactions(spark, sf, sessions=True).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"), F.max((F.col("action") == "purchase").cast("int")).alias("bought"))
    return s.agg(F.count(F.lit(1)).alias("sessions"), r6(F.avg("n")).alias("events_per_session"), r6(F.avg("items")).alias("items_per_session"), r6(F.avg("bought")).alias("conversion"), r6(F.avg((F.col("n") == 1).cast("int"))).alias("bounce"))


@register("D15_usage_peaks", SQL_INTERACTIONS + """, h as (select user_id, hour(ts) h, count(*) n from interactions group by 1, 2), d as (select user_id, isodow(ts) - 1 d, count(*) n from interactions group by 1, 2),
ph as (select user_id, h::int peak_hour, count(*) over (partition by user_id) active_hours from h qualify row_number() over (partition by user_id order by n desc, h) = 1),
pd as (select user_id, d::int peak_day, count(*) over (partition by user_id) active_days from d qualify row_number() over (partition by user_id order by n desc, d) = 1)
select user_id, peak_hour, active_hours, peak_day, active_days from ph join pd using (user_id)""")
def d15(spark, sf):
    it = views.interactions(spark, sf)

    def peak(of, name: str, active: str):
        n = it.groupBy("user_id", of.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("user_id").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias(name), F.count(F.lit(1)).alias(active))

    return peak(F.hour("ts"), "peak_hour", "active_hours").join(peak(F.weekday("ts"), "peak_day", "active_days"), "user_id")


@register("D28_minute_throughput", SQL_INTERACTIONS + """, m as (select epoch_us(ts) // 60000000 mi, count(*) n from interactions group by 1), e as (select max(mi) t from m)
select t::bigint * 60 at_s, coalesce(sum(n) filter (where mi = t), 0)::bigint as now_n, round(coalesce(sum(n) filter (where mi > t - 5), 0) / 5, 6) mean_5, coalesce(max(n) filter (where mi > t - 5), 0)::bigint peak_5, coalesce(sum(n) filter (where mi > t - 60), 0)::bigint last_hour
from m, e group by t""")
def d28(spark, sf):
    """Minutes without an event count as zero in the means."""
    m = views.interactions(spark, sf).groupBy(F.floor(F.unix_seconds("ts") / 60).alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    x = m.join(F.broadcast(m.agg(F.max("minute").alias("t"))), F.col("minute") > F.col("t") - 60)
    of = lambda f, k: F.coalesce(f(F.when(F.col("minute") > F.col("t") - k, F.col("n"))), F.lit(0))
    return x.groupBy("t").agg(of(F.sum, 1).alias("now_n"), r6(of(F.sum, 5) / 5).alias("mean_5"), of(F.max, 5).alias("peak_5"), of(F.sum, 60).alias("last_hour")).select((F.col("t") * 60).alias("at_s"), "now_n", "mean_5", "peak_5", "last_hour")


@register("E13_bursts", SQL_INTERACTIONS + """, w as (select event_id, user_id, count(distinct item_id) over (partition by user_id order by epoch_us(ts) range between 86400000000 preceding and current row) items from interactions)
select event_id, user_id, items from w where items > 3""")
def e13(spark, sf):
    """More than three distinct items within a day; the given events have no burst of over twenty a minute, the operator's own limits."""
    return O.bursts(views.interactions(spark, sf), seconds=86_400, more_than=3)


@register("I8_cross_scores", SQL_INTERACTIONS + f""", u as (select user_id, count(*) act, avg(price) avgp from interactions where {_sql_since(7)} group by 1), i as (select item_id, count(*) pop, avg(price) p from interactions where {_sql_since(7)} group by 1),
x as (select distinct user_id, item_id from interactions where {_sql_since(7)})
select user_id, item_id, round(0.3::double * least(act / 100, 1) + 0.3::double * least(pop / 1000, 1) + 0.4::double * (1 - least(abs(avgp - p) / greatest(avgp, 1), 1)), 6) score from x join u using (user_id) join i using (item_id)""")
def i8(spark, sf):
    it = views.interactions(spark, sf).filter(_since(7))
    u = it.groupBy("user_id").agg(F.count(F.lit(1)).alias("act"), F.avg("price").alias("avgp"))
    i = it.groupBy("item_id").agg(F.count(F.lit(1)).alias("pop"), F.avg("price").alias("p"))
    one = F.lit(1.0)
    score = 0.3 * F.least(F.col("act") / 100, one) + 0.3 * F.least(F.col("pop") / 1000, one) + 0.4 * (1 - F.least(F.abs(F.col("avgp") - F.col("p")) / F.greatest("avgp", one), one))
    return it.select("user_id", "item_id").distinct().join(u, "user_id").join(i, "item_id").select("user_id", "item_id", r6(score).alias("score"))


@register("J15_realtime_intent", SQL_INTERACTIONS + f""", p as (select user_id, item_id, count(*) n, max(ts) last, bool_or(action in ('add_cart', 'purchase')) high from interactions group by 1, 2), i as (select item_id, count(*) pop from interactions group by 1)
select user_id, item_id, round((0.3::double * ln(1 + pop) + 0.4::double * ln(1 + n) + 0.2::double * exp(-(epoch_us({SQL_AS_OF}) - epoch_us(last)) / 1e6 / 86400)) * case when high then 1.5 else 1 end::double, 6) score from p join i using (item_id)""")
def j15(spark, sf):
    it = views.interactions(spark, sf)
    p = it.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.bool_or(F.col("action").isin("add_cart", "purchase")).alias("high"))
    i = it.groupBy("item_id").agg(F.count(F.lit(1)).alias("pop"))
    days = X.seconds_between(F.lit(AS_OF).cast("timestamp"), F.col("last")) / 86_400
    score = (0.3 * F.log1p("pop") + 0.4 * F.log1p("n") + 0.2 * F.exp(-days)) * F.when(F.col("high"), 1.5).otherwise(1.0)
    return p.join(i, "item_id").select("user_id", "item_id", r6(score).alias("score"))


_DIM_WEIGHT = "case dimension when 'material' then 1 when 'finish' then 0.5 else 0.3 end::double"


@register("K6_semantic_vector", _ITEM_TAGS + f""", b as (select item_id, (('0x' || substr(md5(dimension || ':' || tag), 1, 8))::bigint) % 32 k, sum({_DIM_WEIGHT}) w from item_tags group by 1, 2), n as (select item_id, sqrt(sum(w * w)) n from b group by 1)
select item_id, k bucket, round(w / n, 6) weight from b join n using (item_id)""")
def k6(spark, sf):
    weight = F.when(F.col("dimension") == "material", 1.0).when(F.col("dimension") == "finish", 0.5).otherwise(0.3)
    b = _item_tags(spark, sf).groupBy("item_id", X.hash_bucket(F.concat_ws(":", "dimension", "tag"), 32).alias("bucket")).agg(F.sum(weight).alias("w"))
    norm = b.groupBy("item_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return b.join(norm, "item_id").select("item_id", "bucket", r6(F.col("w") / F.col("norm")).alias("weight"))


@register("L11_online_ratios", SQL_SESSIONS + f""", s as (select session_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 d from sessions group by 1), t as (select avg(d) d from s)
select round({_n('click')} / greatest({_n('view')}, 1), 6) ctr, round({_n('purchase')} / greatest({_n('click')}, 1), 6) conversion, round(any_value(t.d), 6) mean_session from sessions, t""")
def l11(spark, sf):
    it = views.interactions(spark, sf, sessions=True)
    s = it.groupBy("session_id").agg(((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("d"), *[O.n_action(a).alias(a) for a in ("click", "view", "purchase")])
    return s.agg(r6(m1(F.sum("click"), F.sum("view"))).alias("ctr"), r6(m1(F.sum("purchase"), F.sum("click"))).alias("conversion"), r6(F.avg("d")).alias("mean_session"))


_HALF = "(('0x' || substr(md5(user_id::varchar), 1, 8))::bigint) % 2"


@register("L16_improvement", SQL_INTERACTIONS + f""", g as (select {_HALF} grp, {_n('click')} / greatest({_n('view')}, 1) ctr, {_n('purchase')} / greatest({_n('click')}, 1) cvr, avg(price) spend from interactions group by 1),
l as (unpivot g on ctr, cvr, spend into name metric value v), p as (select metric, max(v) filter (where grp = 0) control, max(v) filter (where grp = 1) treatment from l group by 1)
select metric, round(control, 6) control, round(treatment, 6) treatment, round(case when control = 0 then 0 else 100 * (treatment - control) / control end, 6) improvement from p""")
def l16(spark, sf):
    it = views.interactions(spark, sf).withColumn("grp", X.hash_bucket(F.col("user_id"), 2))
    g = it.groupBy("grp").agg(m1(O.n_action("click"), O.n_action("view")).alias("ctr"), m1(O.n_action("purchase"), O.n_action("click")).alias("cvr"), F.avg("price").alias("spend"))
    long = g.unpivot("grp", ["ctr", "cvr", "spend"], "metric", "v")
    p = long.groupBy("metric").agg(F.max(F.when(F.col("grp") == 0, F.col("v"))).alias("control"), F.max(F.when(F.col("grp") == 1, F.col("v"))).alias("treatment"))
    return p.select("metric", r6("control").alias("control"), r6("treatment").alias("treatment"), r6(sd(100 * (F.col("treatment") - F.col("control")), F.col("control"))).alias("improvement"))


@register("M9_top_keywords", _SENT + f""", k as (select unnest(list_distinct(list_filter(w, lambda x: len(x) >= 4 and not list_contains([{", ".join(f"'{w}'" for w in M.STOP)}], x)))) word from s), c as (select word, count(*) n from k group by 1)
select word, n, row_number() over (order by n desc, word) rank from c qualify row_number() over (order by n desc, word) <= 20""")
def m9(spark, sf):
    k = views.table(spark, sf, "documents").select(F.explode(M.keywords(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = k.orderBy(F.desc("n"), "word").limit(20)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "word")).cast("long"))  # twenty rows


@register("N6_hybrid_features", SQL_INTERACTIONS + f""", l as (select user_id, max(ts) last_ts, count(*) n30, avg({_weight('offline')}) e30 from interactions where {_sql_since(30)} group by 1),
r as (select user_id, count(*) n5, sum({_weight('stream')}) e5 from interactions join l using (user_id) where epoch_us(ts) > epoch_us(last_ts) - 300000000 group by 1)
select user_id, round(case when n30 > 0 then n5 / (n30 / 8640) when n5 > 0 then 1 else 0 end::double, 6) activity_trend_ratio, round(case when e30 > 0 then e5 / e30 else 1 end::double, 6) engagement_acceleration,
  case when hour(last_ts) between 18 and 22 then 1.2 when hour(last_ts) between 2 and 6 then 0.8 else 1 end::double time_context_multiplier from l join r using (user_id)""")
def n6(spark, sf):
    """The five minutes up to a user's last event against thirty days: counts by the mean of five minutes, engagement
    by the mean weight of an event; the hour is that of the last event."""
    it = views.interactions(spark, sf).filter(_since(30))
    l = it.groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n30"), F.avg(X.action_weight(F.col("action"), "offline")).alias("e30"))
    recent = it.select("user_id", "ts", "action").join(l, "user_id").filter(F.unix_micros("ts") > F.unix_micros("last_ts") - 300_000_000)
    out = recent.groupBy("user_id").agg(F.count(F.lit(1)).alias("n5"), F.sum(X.action_weight(F.col("action"), "stream")).alias("e5"), *[F.first(c).alias(c) for c in ("last_ts", "n30", "e30")])
    return out.select("user_id", *S.hybrid_features(F.col("n5"), F.col("n30"), F.col("e5"), F.col("e30"), F.hour("last_ts")))


@register("O6_new_item_targets", SQL_INTERACTIONS + f""", f as (select user_id, 'category_fan' as why from interactions group by user_id, category_id having category_id = 3 and count(*) >= 5), s as (select user_id, 'big_spender' from interactions group by 1 having sum(price) filter (where action = 'purchase') > 2000),
a as (select user_id, 'active' from interactions where {_sql_since(7)} group by 1 order by count(*) desc, user_id limit 100), o as (select distinct user_id, 'owner' from interactions where action = 'purchase' and item_id = 13)
select user_id, string_agg(distinct why, ',' order by why) reasons from (select * from f union all select * from s union all select * from a union all select * from o) group by 1""")
def o6(spark, sf):
    """Fans of the category (3), big spenders, the hundred most active users of the week, owners of the item replaced (13)."""
    it = views.interactions(spark, sf)
    why = lambda df, name: df.select("user_id", F.lit(name).alias("why"))
    fans = it.filter("category_id = 3").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")
    spenders = it.filter("action = 'purchase'").groupBy("user_id").agg(F.sum("price").alias("paid")).filter("paid > 2000")
    active = it.filter(_since(7)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(100)
    owners = it.filter("action = 'purchase' and item_id = 13").select("user_id").distinct()
    out = why(fans, "category_fan").union(why(spenders, "big_spender")).union(why(active, "active")).union(why(owners, "owner"))
    return out.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("why")), ",").alias("reasons"))


@register("P7_daily_engagement", SQL_INTERACTIONS + """, d as (select user_id, ts::date d1, count(*) n from interactions group by 1, 2) select strftime(d1, '%Y-%m-%d') on_day, count(*) users, round(avg(n), 6) mean_events from d group by 1""")
def p7(spark, sf):
    d = views.interactions(spark, sf).groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("on_day")).agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("on_day").agg(F.count(F.lit(1)).alias("users"), r6(F.avg("n")).alias("mean_events"))


@register("P5_peaks_and_inactivity", SQL_INTERACTIONS + f""", h as (select 'hour' part, hour(ts)::int v, count(*) n from interactions group by 2 order by n desc, v limit 3), d as (select 'day' part, (isodow(ts) - 1)::int v, count(*) n from interactions group by 2 order by n desc, v limit 3),
l as (select user_id, (epoch_us({SQL_AS_OF}) - epoch_us(max(ts))) / 86400e6 age from interactions group by 1), i as (select 'inactive' part, k::int v, count(*) filter (where age > k) n from l, (values (7), (30), (90)) t(k) group by 2)
select * from h union all select * from d union all select * from i""")
def p5(spark, sf):
    it = views.interactions(spark, sf)

    def busiest(part: str, of):
        return it.groupBy(of.cast("int").alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").limit(3).select(F.lit(part).alias("part"), "v", "n")

    age = X.seconds_between(F.lit(AS_OF).cast("timestamp"), F.max("ts")) / 86_400
    last = it.groupBy("user_id").agg(age.alias("age")).agg(*[count_if(F.col("age") > k).alias(str(k)) for k in (7, 30, 90)])
    inactive = last.unpivot([], ["7", "30", "90"], "v", "n").select(F.lit("inactive").alias("part"), F.col("v").cast("int").alias("v"), "n")
    return busiest("hour", F.hour("ts")).unionByName(busiest("day", F.weekday("ts"))).unionByName(inactive)


@register("Q5_replay_and_skip", _WATCH + """, u as (select video_id, user_id, count(*) n from w group by 1, 2), r as (select video_id, avg((n > 1)::int) replays from u group by 1),
a as (select video_id, avg((watched >= 0.95::double * length)::int) completion, avg((watched < 0.1::double * length)::int) skips, avg(least(1.0::double, watched / length)) ratio, max(length) length from w group by 1)
select video_id, round((completion + least(1, replays * 10) + 1 - skips + ratio) / 4, 6) engagement, least(30, length * 0.1::double) preview_s from a join r using (video_id)""")
def q5(spark, sf):
    w = _watches(spark, sf)
    replays = w.groupBy("video_id", "user_id").agg(F.count(F.lit(1)).alias("n")).groupBy("video_id").agg(F.avg((F.col("n") > 1).cast("int")).alias("replays"))
    share = F.col("watched") / F.col("length")
    a = w.groupBy("video_id").agg(
        F.avg((F.col("watched") >= 0.95 * F.col("length")).cast("int")).alias("completion"), F.avg((F.col("watched") < 0.1 * F.col("length")).cast("int")).alias("skips"),
        F.avg(F.least(F.lit(1.0), share)).alias("ratio"), F.max("length").alias("length"),
    )
    score = (F.col("completion") + F.least(F.lit(1.0), F.col("replays") * 10) + 1 - F.col("skips") + F.col("ratio")) / 4
    return a.join(replays, "video_id").select("video_id", r6(score).alias("engagement"), F.least(F.lit(30.0), F.col("length") * 0.1).alias("preview_s"))


@register("L30_source_satisfaction", SQL_INTERACTIONS + f""", a as (select platform source, {_n('view')} v, {_n('click')} c, {_n('purchase')} p, {_n('add_cart')} k from interactions group by 1)
select source, round(10 * (0.4::double * least(1, c / greatest(v, 1)) + 0.6::double * least(1, (p + k) / greatest(c, 1))), 6) satisfaction from a""")
def l30(spark, sf):
    """Out of ten: .4 for clicks a view and .6 for carts and purchases a click, each at most one."""
    a = views.interactions(spark, sf).groupBy(F.col("platform").alias("source")).agg(*[O.n_action(x).alias(x) for x in ("view", "click", "purchase", "add_cart")])
    one = F.lit(1.0)
    score = 10 * (0.4 * F.least(one, m1(F.col("click"), F.col("view"))) + 0.6 * F.least(one, m1(F.col("purchase") + F.col("add_cart"), F.col("click"))))
    return a.select("source", r6(score).alias("satisfaction"))


@register("L32_list_novelty", _RECS + """, n as (select item_id, count(*) / sum(count(*)) over () share from interactions group by 1)
select user_id, count(*) n, round(avg(-log2(share)), 6) novelty from recs join n using (item_id) group by 1""")
def l32(spark, sf):
    """The mean surprise of a list's items: minus the binary logarithm of their part of all interactions."""
    recs, _ = _recs(spark, sf)
    n = views.interactions(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("m"))
    n = n.crossJoin(F.broadcast(n.agg(F.sum("m").alias("total")))).select("item_id", (-F.log2(F.col("m") / F.col("total"))).alias("surprise"))  # one row broadcast
    return recs.join(n, "item_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("surprise")).alias("novelty"))


@register("N7_trending_and_platform", SQL_INTERACTIONS + f""", i as (select item_id, count(*) filter (where {_sql_since(1)}) n1, count(*) filter (where {_sql_since(7)}) n7 from interactions group by 1),
pl as (select item_id, platform from interactions group by 1, 2 qualify row_number() over (partition by item_id order by count(*) desc, platform) = 1), p as (select distinct user_id, item_id, platform mine from interactions)
select user_id, item_id, round(case when n7 = 0 then 0 else n1 / (n7 / 7) end * ln(1 + n7), 6) trending, mine = platform platform_match from p join i using (item_id) join pl using (item_id)""")
def n7(spark, sf):
    it = views.interactions(spark, sf)
    i = it.groupBy("item_id").agg(count_if(_since(1)).alias("n1"), count_if(_since(7)).alias("n7"))
    pl = R.top_k(it.groupBy("item_id", "platform").agg(F.count(F.lit(1)).alias("n")), 1, "n", "platform", ["item_id"]).select("item_id", F.col("platform").alias("usual"))
    p = it.select("user_id", "item_id", F.col("platform").alias("mine")).distinct()
    trending = sd(F.col("n1"), F.col("n7") / 7) * F.log1p("n7")
    return p.join(i, "item_id").join(pl, "item_id").select("user_id", "item_id", r6(trending).alias("trending"), (F.col("mine") == F.col("usual")).alias("platform_match"))


_PERSONAS = {"gamer": 1, "creator": 4, "listener": 7}


@register("O5_new_user_candidates", SQL_INTERACTIONS + f""", u as (select user_id, min(hour(ts)) h, min_by(item_id, (ts, event_id)) filter (where action = 'click') first_click from interactions group by 1),
p as (select user_id, first_click, case when h >= 18 then 'gamer' when h >= 9 then 'creator' when h >= 1 then 'listener' end persona from u),
ranked as (select category_id, item_id, row_number() over (partition by category_id order by count(*) desc, item_id) rn from interactions group by 1, 2),
kinds(persona, category_id) as (values {", ".join(f"('{k}', {v})" for k, v in _PERSONAS.items())}),
c as (
  select user_id, item_id, 'persona' step, 1 as rank from p join kinds using (persona) join ranked using (category_id) where rn <= 3
  union all select user_id, item_id, 'first_click', 2 from p join ranked on category_id = first_click % 10 where rn <= 3
  union all select user_id, item_id, 'popular', 3 from p, ranked where rn = 1)
select user_id, item_id, arg_min(step, rank) step from c group by 1, 2""")
def o5(spark, sf):
    """A new user's candidates: items of the persona's category, then of the first click's, then one item a category."""
    it = views.interactions(spark, sf)
    first = F.min_by(F.when(F.col("action") == "click", F.col("item_id")), F.when(F.col("action") == "click", F.struct("ts", "event_id")))
    u = it.groupBy("user_id").agg(F.min(F.hour("ts")).alias("h"), first.alias("first_click"))
    persona = F.when(F.col("h") >= 18, "gamer").when(F.col("h") >= 9, "creator").when(F.col("h") >= 1, "listener")
    p = u.select("user_id", "first_click", F.try_element_at(F.create_map(*[F.lit(x) for kv in _PERSONAS.items() for x in kv]), persona).alias("own"))
    ranked = R.top_k(it.groupBy("category_id", "item_id").agg(F.count(F.lit(1)).alias("n")), 3, "n", "item_id", ["category_id"])
    parts = [
        p.join(ranked, p.own == ranked.category_id).select("user_id", "item_id", F.lit("persona").alias("step"), F.lit(1).alias("at")),
        p.join(ranked, p.first_click % 10 == ranked.category_id).select("user_id", "item_id", F.lit("first_click").alias("step"), F.lit(2).alias("at")),
        R.grid(p.select("user_id"), ranked.filter("rank = 1").select("item_id")).select("user_id", "item_id", F.lit("popular").alias("step"), F.lit(3).alias("at")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("user_id", "item_id").agg(F.min_by("step", "at").alias("step"))
