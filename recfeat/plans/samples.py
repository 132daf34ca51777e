"""Registered queries: joins with dimensions and windows, fine and coarse ranking, wide training samples."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recfeat import views
from recfeat.functions import exprs as X
from recfeat.functions.exprs import count_if, r6, sd
from recfeat.functions.sized import small, tasks
from recfeat.operators import features as O
from recfeat.operators import models as L
from recfeat.operators import ranking as K
from recfeat.operators import recall as R
from recfeat.operators import store as S
from recfeat.operators.running import Recent, exact, recent_sums
from recfeat.plans.catalog import register
from recfeat.plans.features import _n, _weight
from recfeat.plans.more import _EDGE, _H, _WATCH, _watches
from recfeat.plans.profiles import _UF, _user_features
from recfeat.streaming import windows
from recfeat.views import AS_OF, SQL_AS_OF, SQL_INTERACTIONS


@register("C5_user_item_grid", SQL_INTERACTIONS + """, t as (select item_id from interactions group by 1 order by count(*) desc, item_id limit 10)
select user_id, item_id from (select distinct user_id from interactions), t""")
def c5(spark, sf):
    it = views.interactions(spark, sf)
    top = it.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item_id").limit(10).select("item_id")
    return R.grid(it.select("user_id").distinct(), top)


@register("C8_window_range_join", SQL_INTERACTIONS + """, w as (
  select item_id, epoch_us(time_bucket(interval 10 minutes, ts)) // 1000000 start_s, count(*) window_n from interactions group by 1, 2 having count(*) filter (where action = 'click') > 0)
select event_id, i.item_id, window_n from interactions i left join w on i.item_id = w.item_id and epoch_us(ts) // 1000000 between start_s and start_s + 600""")
def c8(spark, sf):
    it = views.interactions(spark, sf)
    start = F.unix_seconds(F.window("ts", "10 minutes").start).alias("start_s")
    w = it.groupBy("item_id", start).agg(F.count(F.lit(1)).alias("window_n"), count_if(F.col("action") == "click").alias("clicks")).filter("clicks > 0")
    w = w.select("item_id", "start_s", (F.col("start_s") + 600).alias("end_s"), "window_n")
    out = R.range_join(it.select("event_id", "item_id", F.unix_seconds("ts").alias("at_s")), w, "item_id", "at_s", "start_s", "end_s", 3600)
    return out.select("event_id", "item_id", "window_n")


@register("C11_dimension_join", SQL_INTERACTIONS + " select event_id, item_id, p_brand brand, p_retailprice list_price from interactions left join part on p_partkey = item_id")
def c11(spark, sf):
    """The batch form of the stream-static join; ``tests`` run the same function over a stream."""
    items = views.items(spark, sf).select("item_id", "brand", F.col("price").alias("list_price"))
    return windows.with_dimension(views.interactions(spark, sf), items, "item_id").select("event_id", "item_id", "brand", "list_price")


@register("G3_labelled_pairs", SQL_INTERACTIONS + """, p as (select user_id, item_id, sum(price) paid from interactions where action = 'purchase' group by 1, 2),
n as (select distinct user_id, item_id from interactions where action = 'view' and (user_id, item_id) not in (select (user_id, item_id) from p))
select user_id, item_id, 1 as label, round(paid, 6) paid from p union all select user_id, item_id, 0, null from n""")
def g3(spark, sf):
    it = views.interactions(spark, sf)
    bought = it.filter("action = 'purchase'").groupBy("user_id", "item_id").agg(r6(F.sum("price")).alias("paid"))
    viewed = it.filter("action = 'view'").select("user_id", "item_id").distinct().join(bought, ["user_id", "item_id"], "left_anti")
    return bought.withColumn("label", F.lit(1)).unionByName(viewed.withColumn("label", F.lit(0)), allowMissingColumns=True)


@register("J5_graph_recall", SQL_INTERACTIONS + f", {_H}, {_EDGE}" + """, nb as (select *, row_number() over (partition by src order by weight desc, dst) <= 5 neighbour from f where w > 0),
p as (select item_id, count(*) / 1000 pop from interactions group by 1),
g as (select user_id, dst item_id, round(sum(weight * case when neighbour then 1.2 else 1 end::double + case when neighbour then 0.5 * pop else 0 end::double), 6) score
  from h join nb on h.item_id = nb.src join p on p.item_id = nb.dst group by 1, 2),
k as (select g.* from g where not exists (select 1 from h where h.user_id = g.user_id and h.item_id = g.item_id))
select *, row_number() over (partition by user_id order by score desc, item_id) rank from k qualify row_number() over (partition by user_id order by score desc, item_id) <= 10""")
def j5(spark, sf):
    it = views.interactions(spark, sf)
    history = it.filter(F.col("ts") >= O.since(AS_OF, 3 * 86_400)).select("user_id", "item_id").distinct()
    popularity = it.groupBy("item_id").agg((F.count(F.lit(1)) / 1000).alias("popularity"))
    return R.neighbour_recall(history, R.attention_edges(it, AS_OF), popularity, 10)


@register("J12_fine_score", SQL_INTERACTIONS + """, l as (select user_id, item_id, category_id, row_number() over (partition by user_id order by ts desc, event_id desc) rn from interactions), f as (select user_id, item_id, min(rn) pos from l where rn <= 50 group by 1, 2),
v as (select vec_id item_id, unnest(embedding)::double v, generate_subscripts(embedding, 1) d from embeddings),
m as (select user_id, d, avg(v) m from l join v using (item_id) where rn <= 50 group by 1, 2), mn as (select user_id, sqrt(sum(m * m)) n from m group by 1), vn as (select item_id, sqrt(sum(v * v)) n from v group by 1),
c as (select f.user_id, f.item_id, sum(m * v) dot from f join v using (item_id) join m on m.user_id = f.user_id and m.d = v.d group by 1, 2),
s as (select user_id, category_id, count(*) / 10 share from l where rn <= 10 group by 1, 2), p as (select item_id, count(*) / 1000 pop from interactions group by 1)
select f.user_id, f.item_id, round(0.5::double * coalesce(dot / (mn.n * vn.n), 0) + 0.2::double * -(1 - (pos - 1) / 50) + 0.2::double * coalesce(share, 0) + 0.1::double * pop, 6) score
from f left join c on c.user_id = f.user_id and c.item_id = f.item_id left join mn on mn.user_id = f.user_id left join vn on vn.item_id = f.item_id
left join s on s.user_id = f.user_id and s.category_id = f.item_id % 10 join p on p.item_id = f.item_id""")
def j12(spark, sf):
    it = views.interactions(spark, sf)
    late = O.last_n(it.repartition(tasks(it.count(), 100_000), "user_id"), "user_id", 50).withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    first = late.groupBy("user_id", "item_id").agg(F.min("rn").alias("pos"))
    share = late.filter("rn <= 10").groupBy("user_id", "category_id").agg((F.count(F.lit(1)) / 10).alias("share"))
    # Rows stay with their users: only items that occur are looked up, in broadcasts where they are few.
    pop = small(it.groupBy("item_id").agg((F.count(F.lit(1)) / 1000).alias("pop")), 100_000)
    vectors = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("v"))
    vectors = small(vectors.join(it.select("item_id").distinct(), "item_id", "left_semi"), 100_000)
    dims = late.join(vectors, "item_id").select("user_id", F.posexplode("v").alias("d", "x")).groupBy("user_id", "d").agg(F.avg("x").alias("x"))
    users = dims.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("u"))
    x = first.withColumn("category_id", F.col("item_id") % 10).join(share, ["user_id", "category_id"], "left").join(pop, "item_id").join(users, "user_id", "left").join(vectors, "item_id", "left")
    score = R.score_parts(F.col("pos") - 1, F.lit(50), F.coalesce("share", F.lit(0.0)), F.col("pop"), F.coalesce(X.cosine(F.col("u"), F.col("v")), F.lit(0.0)))
    return x.select("user_id", "item_id", r6(score).alias("score"))


_RECALL = SQL_INTERACTIONS + f""", c as (select user_id, item_id, category_id, round(sum({_weight('profile')}) / 100, 6) recall, round({_n('click')} / greatest({_n('view')}, 1), 6) ctr from interactions group by 1, 2, 3)"""


def _recalled(spark, sf):
    it = views.interactions(spark, sf)
    return it.groupBy("user_id", "item_id", "category_id").agg(
        F.round(F.sum(X.action_weight(F.col("action"), "profile")) / 100, 6).alias("recall"), r6(X.m1(count_if(F.col("action") == "click"), count_if(F.col("action") == "view"))).alias("ctr"),
    )


@register("J13_coarse_rank", _RECALL + """, s as (select user_id, item_id, category_id, round(0.3::double * recall + 0.7::double * ctr, 6) score from c),
q as (select *, row_number() over (partition by user_id, category_id order by score desc, item_id) n from s where score >= 0.001)
select user_id, item_id, score, row_number() over (partition by user_id order by score desc, item_id) rank from q where n <= 5 qualify row_number() over (partition by user_id order by score desc, item_id) <= 1000""")
def j13(spark, sf):
    return K.coarse_rank(_recalled(spark, sf), F.col("recall"), F.col("ctr"), per_category=5).select("user_id", "item_id", "score", "rank")


@register("J14_funnel", SQL_INTERACTIONS + f""", c as (select user_id, item_id, sum({_weight('profile')}) score, avg(price) p from interactions group by 1, 2), r as (select * from c qualify row_number() over (partition by user_id order by score desc, item_id) <= 10000),
k as (select *, 0.3::double * score + 0.7::double * p / 500 coarse from r), l as (select *, row_number() over (partition by user_id order by coarse desc, item_id) cr from k),
m as (select *, row_number() over (partition by user_id order by case when cr <= 1000 then coarse + score end desc nulls last, item_id) fr from l)
select user_id, item_id, case when cr <= 1000 and fr <= 20 then 'display' when cr <= 1000 and fr <= 100 then 'fine' when cr <= 1000 then 'coarse' else 'recall' end stage from m""")
def j14(spark, sf):
    return _funnel(spark, sf).select("user_id", "item_id", "stage")


def _funnel(spark, sf):
    c = views.interactions(spark, sf).groupBy("user_id", "item_id").agg(F.sum(X.action_weight(F.col("action"), "profile")).alias("score"), F.avg("price").alias("p"))
    return K.funnel(c, 0.3 * F.col("score") + 0.7 * F.col("p") / 500, F.col("coarse") + F.col("score"))


@register("J14_stage_counts", SQL_INTERACTIONS + """, c as (select user_id, count(distinct item_id) n from interactions group by 1)
select user_id, least(n, 10000) recall, least(n, 1000) coarse, least(n, 100) fine, least(n, 20) display from c""")
def j14_counts(spark, sf):
    at = F.col("stage")
    return _funnel(spark, sf).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("recall"), count_if(at != "recall").alias("coarse"), count_if(at.isin("fine", "display")).alias("fine"), count_if(at == "display").alias("display"),
    )


_LENGTH = "case when length <= 180 then 'medium' when length <= 600 then 'long' else 'extended' end"


@register("J21_video_preference", _WATCH + f""", v as (
  select video_id, any_value({_LENGTH}) kind, avg((watched >= 0.95::double * length)::int) quality, list_distinct([video_id % 4, video_id // 4 % 4]) genres, ['PS5', 'PS4'][(video_id % 2 + 1)::int] made_for from w group by 1),
k as (select user_id, {_LENGTH} kind, count(*) n from w group by 1, 2 qualify row_number() over (partition by user_id order by n desc, kind) = 1),
g as (select user_id, unnest(genres) genre, count(*) n from w join v using (video_id) group by 1, 2 qualify row_number() over (partition by user_id order by n desc, genre) <= 2),
u as (select user_id, list(genre) liked from g group by 1), s as (select distinct user_id, video_id from w)
select user_id, video_id, round(least(1.0::double, case when k.kind = v.kind then 0.3 else 0 end::double + 0.4::double * len(list_intersect(liked, genres)) / len(liked)
  + case when user_id % 2 = 0 then 0.2::double * quality else 0 end + case when made_for = ['PS5', 'PS4', 'Mobile'][(user_id % 3 + 1)::int] then 0.1 else 0 end::double), 6) score
from s join v using (video_id) join k using (user_id) join u using (user_id)""")
def j21(spark, sf):
    w = _watches(spark, sf).withColumn("kind", F.when(F.col("length") <= 180, "medium").when(F.col("length") <= 600, "long").otherwise("extended"))
    genres = F.array_distinct(F.array(F.col("video_id") % 4, F.floor(F.col("video_id") / 4) % 4))
    made_for = F.when(F.col("video_id") % 2 == 0, "PS5").otherwise("PS4")
    v = w.groupBy("video_id").agg(F.first("kind").alias("video_kind"), F.avg((F.col("watched") >= 0.95 * F.col("length")).cast("int")).alias("quality"))
    v = v.withColumns({"genres": genres, "made_for": made_for})
    kinds = R.top_k(w.groupBy("user_id", "kind").agg(F.count(F.lit(1)).alias("n")), 1, "n", "kind", ["user_id"]).select("user_id", F.col("kind").alias("user_kind"))
    likes = w.join(v, "video_id").select("user_id", F.explode("genres").alias("genre")).groupBy("user_id", "genre").agg(F.count(F.lit(1)).alias("n"))
    likes = R.top_k(likes, 2, "n", "genre", ["user_id"]).groupBy("user_id").agg(F.collect_list("genre").alias("liked"))
    x = w.select("user_id", "video_id").distinct().join(v, "video_id").join(kinds, "user_id").join(likes, "user_id")
    platform = F.element_at(F.array(F.lit("PS5"), F.lit("PS4"), F.lit("Mobile")), (F.col("user_id") % 3 + 1).cast("int"))
    score = K.video_preference(F.col("user_kind") == F.col("video_kind"), F.col("liked"), F.col("genres"), F.col("user_id") % 2 == 0, F.col("quality"), F.col("made_for") == platform)
    return x.select("user_id", "video_id", r6(score).alias("score"))


@register("N5_fusion", _UF + f""", a as (select *, epoch_us({SQL_AS_OF}) / 1e6 - at_s age from u), b as (select *, 1 / (1 + exp(greatest(-700, least(700, age / 2 / 300 - age / 3600)))) share from a)
select user_id, round(events + (purchases - events) * share, 6) by_age, purchases::double latest, round((events * 0.9::double + purchases * 0.6::double) / 1.5::double, 6) by_confidence from b""")
def n5(spark, sf):
    """Event counts as the offline value, purchase counts of half their age as the live one."""
    u = _user_features(spark, sf).withColumn("age", F.lit(float(S.epoch(AS_OF))) - F.col("at"))
    fused = lambda how, a, b: S.fuse(F.col("events"), a, F.col("purchases"), b, how).cast("double")
    age = F.col("age")
    return u.select("user_id", r6(fused("weighted", age, age / 2)).alias("by_age"), fused("latest", age, age / 2).alias("latest"), r6(fused("confidence", F.lit(0.9), F.lit(0.6))).alias("by_confidence"))


@register("N9_combined_vector", SQL_INTERACTIONS + f""", u as (select user_id, count(*) filter (where ts >= {SQL_AS_OF} - interval 7 days) n7, count(*) filter (where ts >= {SQL_AS_OF} - interval 3 days) n3 from interactions group by 1),
i as (select item_id, any_value(category_id) category_id, count(*) filter (where ts >= {SQL_AS_OF} - interval 7 days) n7, count(*) filter (where ts >= {SQL_AS_OF} - interval 3 days) n3 from interactions group by 1),
ul as (select *, case when n7 >= 140 then 'super' when n7 >= 70 then 'high' when n7 >= 21 then 'normal' else 'low' end level, round(case when n3 = 0 then 0.0::double else greatest(-1, least(1, (n7 / (7.0::double / 3) - n3) / n3)) end, 6) trend from u),
il as (select *, case when n7 >= 7000 then 'super' when n7 >= 700 then 'high' when n7 >= 70 then 'normal' else 'low' end level, round(case when n3 = 0 then 0.0::double else greatest(-1, least(1, (n7 / (7.0::double / 3) - n3) / n3)) end, 6) trend from i),
p as (select user_id, item_id, max(ts) ts from interactions group by 1, 2)
select user_id, item_id, ul.n7 user_events_7d, il.n7 item_events_7d, ul.level = il.level level_match, round(ul.trend * il.trend, 6) + 0 trend_alignment, ('0x' || substr(md5(category_id::varchar), 1, 8))::bigint % 100 category_code,
  hour(p.ts)::int context_hour, isodow(p.ts) >= 6 context_is_weekend from p join ul using (user_id) join il using (item_id)""")
def n9(spark, sf):
    it = views.interactions(spark, sf)
    recent = [count_if(F.col("ts") >= O.since(AS_OF, d * 86_400)).alias(f"n{d}") for d in (7, 3)]

    def levels(df, cuts):
        level = F.when(F.col("n7") >= cuts[0], "super").when(F.col("n7") >= cuts[1], "high").when(F.col("n7") >= cuts[2], "normal").otherwise("low")
        return df.withColumns({"level": level, "trend": r6(X.trend(F.col("n7"), F.col("n3"), 7 / 3))})

    u = levels(it.groupBy("user_id").agg(*recent), (140, 70, 21)).alias("u")
    i = levels(it.groupBy("item_id").agg(F.first("category_id").alias("category_id"), *recent), (7000, 700, 70)).alias("i")
    p = it.groupBy("user_id", "item_id").agg(F.max("ts").alias("ts")).join(u, "user_id").join(i, "item_id")
    return p.select(
        "user_id", "item_id", F.col("u.n7").alias("user_events_7d"), F.col("i.n7").alias("item_events_7d"), (F.col("u.level") == F.col("i.level")).alias("level_match"),
        r6(F.col("u.trend") * F.col("i.trend")).alias("trend_alignment"), X.hash_bucket(F.col("category_id"), 100).alias("category_code"), F.hour("ts").alias("context_hour"), (F.weekday("ts") >= 5).alias("context_is_weekend"),
    )


_SPAN = {"1h": 3600, "6h": 21_600, "1d": 86_400, "7d": 604_800}
#: Counts of a sample by side: name, action (None: any), windows.
_COUNTED = {
    "user": [("clicks", "click", ("1h", "6h", "1d", "7d")), ("purchases", "purchase", ("1h", "6h", "1d", "7d")), ("events", None, ("1h", "7d"))],
    "item": [("views", "view", ("1h", "6h", "1d")), ("clicks", "click", ("1h", "6h", "1d")), ("purchases", "purchase", ("1h", "6h", "1d"))],
}


def _sql_samples() -> str:
    over = lambda side, w: f"over (partition by {side}_id order by us range between {_SPAN[w] * 1_000_000} preceding and 1 preceding)"
    counts = ", ".join(
        f"count(*) filter (where {'true' if action is None else f'''action = '{action}' '''}) {over(side, w)} {side}_{name}_{w}"
        for side, parts in _COUNTED.items() for name, action, spans in parts for w in spans
    )
    return SQL_INTERACTIONS + f""", e as (select *, epoch_us(ts) us from interactions),
w as (select event_id, user_id, item_id, category_id, brand_id, price, ts, (action in ('purchase', 'like'))::int label, {counts},
  {", ".join(f"coalesce(sum(round(price * 1e6)::bigint) {over('user', x)}::double / count(price) {over('user', x)} / 1e6::double, 0) user_avg_price_{x}" for x in ("1d", "7d"))},
  count(*) over (partition by user_id, category_id order by us range between 604800000000 preceding and 1 preceding) own_category_7d from e),
s as (select event_id, user_id, item_id, label, user_id % 7 user_age_group, user_id % 3 user_gender, user_id % 5 user_city_level, category_id item_category, brand_id item_brand, price item_price,
  {", ".join(f"{side}_{name}_{x}" for side, parts in _COUNTED.items() for name, _, spans in parts for x in spans)}, user_avg_price_1d,
  {", ".join(f"item_clicks_{x} / greatest(item_views_{x}, 1) item_ctr_{x}" for x in ("1h", "6h", "1d"))}, item_purchases_1d / greatest(item_clicks_1d, 1) item_cvr_1d,
  own_category_7d / greatest(user_events_7d, 1) category_affinity, case when user_avg_price_7d = 0 then 0.0::double else price / user_avg_price_7d end price_sensitivity,
  item_views_1d / (user_clicks_1d + 1) popularity_vs_activity, hour(ts)::int hour_of_day, (isodow(ts) - 1)::int day_of_week, isodow(ts) >= 6 is_weekend, ((month(ts) - 1) // 3)::int season from w)"""


def _samples(spark, sf):
    """Interactions with what was known just before each; user, item and category histories end before the event."""
    it = views.interactions(spark, sf).withColumn("us", F.unix_micros("ts"))

    of = {a: F.lit(1) if a is None else (F.col("action") == a).cast("int") for parts in _COUNTED.values() for _, a, _ in parts}
    paid, priced = exact(F.col("price")), F.col("price").isNotNull().cast("int")
    rows = it
    for side, parts in _COUNTED.items():
        recent = {f"{side}_{name}_{w}": Recent(_SPAN[w], of[action]) for name, action, spans in parts for w in spans}
        if side == "user":
            recent |= {f"_{kind}_{w}": Recent(_SPAN[w], x) for w in ("1d", "7d") for kind, x in (("paid", paid), ("priced", priced))}
        rows = recent_sums(rows, [f"{side}_id"], "us", recent)
    rows = recent_sums(rows, ["user_id", "category_id"], "us", {"own_category_7d": Recent(_SPAN["7d"], F.lit(1))})
    rows = rows.withColumns({f"user_avg_price_{w}": sd(F.col(f"_paid_{w}").cast("double"), F.col(f"_priced_{w}")) / 1_000_000 for w in ("1d", "7d")})
    counts = [f"{side}_{name}_{w}" for side, parts in _COUNTED.items() for name, _, spans in parts for w in spans]
    c = F.col
    return rows.select(
        "event_id", "user_id", "item_id", c("action").isin("purchase", "like").cast("int").alias("label"), (c("user_id") % 7).alias("user_age_group"), (c("user_id") % 3).alias("user_gender"),
        (c("user_id") % 5).alias("user_city_level"), c("category_id").alias("item_category"), c("brand_id").alias("item_brand"), c("price").alias("item_price"), *counts, "user_avg_price_1d",
        *[X.m1(c(f"item_clicks_{x}"), c(f"item_views_{x}")).alias(f"item_ctr_{x}") for x in ("1h", "6h", "1d")], X.m1(c("item_purchases_1d"), c("item_clicks_1d")).alias("item_cvr_1d"),
        X.m1(c("own_category_7d"), c("user_events_7d")).alias("category_affinity"), sd(c("price"), c("user_avg_price_7d")).alias("price_sensitivity"), X.p1(c("item_views_1d"), c("user_clicks_1d")).alias("popularity_vs_activity"),
        F.hour("ts").alias("hour_of_day"), F.weekday("ts").alias("day_of_week"), (F.weekday("ts") >= 5).alias("is_weekend"), F.floor((F.month("ts") - 1) / 3).cast("int").alias("season"),
    )


_REAL = ("user_avg_price_1d", "item_ctr_1h", "item_ctr_6h", "item_ctr_1d", "item_cvr_1d", "category_affinity", "price_sensitivity", "popularity_vs_activity")


@register("R6_training_samples", _sql_samples() + " select * replace (" + ", ".join(f"round({x}, 6) as {x}" for x in _REAL) + ") from s")
def r6_samples(spark, sf):
    return _samples(spark, sf).withColumns({x: r6(F.col(x)) for x in _REAL})


def _model_vector() -> list[str]:
    """The parts of the model's vector, as expressions over the columns of a sample."""
    logs = [
        ("user_clicks_1h", 5), ("user_clicks_6h", 8), ("user_clicks_1d", 10), ("user_clicks_7d", 15), ("user_purchases_1h", 3), ("user_purchases_6h", 5), ("user_purchases_1d", 8), ("user_purchases_7d", 12),
        ("user_avg_price_1d", 10), ("user_events_1h", 8), ("item_views_1h", 10), ("item_views_6h", 12), ("item_views_1d", 15), ("item_clicks_1h", 8), ("item_clicks_6h", 10), ("item_clicks_1d", 12),
        ("item_purchases_1h", 5), ("item_purchases_6h", 8), ("item_purchases_1d", 10),
    ]
    parts = ["user_age_group / 6", "user_gender / 2", "user_city_level / 4", "item_category / 20", "item_brand / 500", "ln(1 + item_price) / 10"]
    parts += [f"ln(1 + {c}) / {n}" for c, n in logs] + ["item_ctr_1h", "item_ctr_6h", "item_ctr_1d", "item_cvr_1d", "category_affinity", "least(price_sensitivity, 2) / 2", "least(popularity_vs_activity, 100) / 100"]
    parts += ["hour_of_day / 24", "day_of_week / 7", "cast(cast(is_weekend as int) as double)", "season / 4"]
    parts += [f"{f}(2 * pi() * {c} / {n})" for c, n in (("hour_of_day", 24), ("day_of_week", 7)) for f in ("sin", "cos")]
    parts += ["user_clicks_1h * item_ctr_1h", "user_purchases_1d * item_cvr_1d", "user_avg_price_1d * item_price / 1000000", "greatest(user_clicks_1d - user_clicks_1h * 24, 0) / 100", "greatest(item_views_1d - item_views_1h * 24, 0) / 1000"]
    return parts


#: The vector is padded with zeros to this length.
DIMENSIONS = 50


@register("B13_model_vector", _sql_samples() + """, v as (select event_id, [""" + ", ".join(X.sql_half_up(p, 6) for p in _model_vector()) + ", 0.0::double" * (DIMENSIONS - len(_model_vector())) + """] vec from s) select event_id, vec from v""")
def b13(spark, sf):
    values = [X.half_up(F.expr(p).cast("double"), 6) for p in _model_vector()]
    return _samples(spark, sf).select("event_id", F.concat(F.array(*values), F.array_repeat(F.lit(0.0), DIMENSIONS - len(values))).alias("vec"))


@register("R7_incremental_biases", SQL_INTERACTIONS + f""", r as (select user_id, item_id, {_weight('profile')} rating from interactions), m as (select avg(rating) mean from r)
select item_id, round((sum(rating) - count(*) * any_value(mean)) / (count(*) + 5), 6) bias, count(*) n from r, m group by 1""")
def r7_biases(spark, sf):
    """The sums of the first batch and of a later one are merged; the twin reads all ratings at once."""
    it = views.interactions(spark, sf).select("user_id", "item_id", "ts", X.action_weight(F.col("action"), "profile").alias("rating"))
    cut = F.lit("2024-01-20").cast("timestamp")
    sums = L.merged_sums(L.rating_sums(it.filter(F.col("ts") < cut), "item_id"), L.rating_sums(it.filter(F.col("ts") >= cut), "item_id"), "item_id")
    return L.biases(sums, "item_id").join(sums.select("item_id", "n"), "item_id").select("item_id", r6("bias").alias("bias"), "n")


_FOLD = """with_a as (select user_id, sum(x * x) + 0.1::double a, sum(x * y) b, sum(x) c, sum(y * y) + 0.1::double d, sum(y) e, count(*) + 0.1::double f, sum(x * t) p, sum(y * t) q, sum(t) r from z group by 1),
det as (select *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) det from with_a)
select user_id, round((p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / det, 6) factor_0, round((a * (q * f - e * r) - p * (b * f - e * c) + c * (b * r - q * c)) / det, 6) factor_1,
  round((a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c)) / det, 6) bias, touched from det join n using (user_id)"""


@register("R7_folded_users", SQL_INTERACTIONS + f""", r as (select user_id, item_id, ts, {_weight('profile')} rating from interactions), m as (select item_id, avg(rating) bias from r group by 1),
n as (select user_id, bool_or(ts >= timestamp '2024-01-20') touched from r join embeddings on vec_id = item_id group by 1),
z as (select user_id, embedding[1]::double x, embedding[2]::double y, rating - bias t from r join m using (item_id) join embeddings on vec_id = item_id), """ + _FOLD)
def r7_folded(spark, sf):
    """Users' factors against fixed item factors (the given vectors' first two parts), from sums of an earlier batch and a later one."""
    ratings = views.interactions(spark, sf).select("user_id", "item_id", "ts", X.action_weight(F.col("action"), "profile").alias("rating"))
    bias = ratings.groupBy("item_id").agg(F.avg("rating").alias("bias"))
    items = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.slice("embedding", 1, 2).alias("factors")).join(bias, "item_id")
    cut = F.lit("2024-01-20").cast("timestamp")
    sums = L.added_sums(*[L.fold_in_sums(ratings.filter(batch), items, 2) for batch in (F.col("ts") < cut, F.col("ts") >= cut)])
    users = L.fold_in(sums, 2, 0.1).join(sums.select("user_id", "touched"), "user_id")
    return users.select("user_id", *[r6(F.get("factors", F.lit(i))).alias(f"factor_{i}") for i in range(2)], r6("bias").alias("bias"), "touched")
