"""Registered recall, ranking, join and export queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recfeat import views
from recfeat.functions import exprs as X
from recfeat.functions.exprs import r6, sd
from recfeat.functions.sized import small, tasks
from recfeat.operators import features as O
from recfeat.operators import recall as R
from recfeat.operators.products import frequent_pairs
from recfeat.operators.running import Recent, exact, recent_sums
from recfeat.plans.catalog import register
from recfeat.plans.features import _n, _weight, rounded
from recfeat.plans.metrics import _RECS, _recs
from recfeat.streaming import windows
from recfeat.views import AS_OF, SQL_AS_OF, SQL_INTERACTIONS

_G = _weight("graph")


@register("F1_top_prices", "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 50")
def f1(spark, sf):
    return views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(50)


@register("F2_top_k_per_user", _RECS + " select user_id, item_id, score, rank from s join recs using (user_id, item_id) where rank <= 5".replace("score, rank from s join recs", "s.score, rank from s join recs"))
def f2(spark, sf):
    recs, _ = _recs(spark, sf)
    return R.top_k(recs.select("user_id", "item_id", "score"), 5, "score", "item_id", ["user_id"])


_HOT = SQL_INTERACTIONS + f", h as (select item_id, round(sum({_G}) * 0.1::double + 0.5::double * ln(1 + {_n('click')}), 6) score from interactions group by 1)"


@register("F3_trending_items", _HOT + " select * from h order by score desc, item_id limit 20")
def f3(spark, sf):
    return R.hot_items(views.interactions(spark, sf), 20)


@register("F4_active_users", SQL_INTERACTIONS + f" select user_id, count(*) n from interactions where ts >= {SQL_AS_OF} - interval 3 days group by 1 order by n desc, user_id limit 20")
def f4(spark, sf):
    a = views.interactions(spark, sf).filter(F.col("ts") >= O.since(AS_OF, 259_200)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return R.top_k(a, 20, "n", "user_id")


@register("F5_category_quota", _RECS + """, q as (select user_id, item_id, score, item_id % 10 category_id, row_number() over (partition by user_id, item_id % 10 order by score desc, item_id) c from s)
select user_id, item_id, score, category_id, row_number() over (partition by user_id order by score desc, item_id) rank from q where c <= 2 qualify row_number() over (partition by user_id order by score desc, item_id) <= 10""")
def f5(spark, sf):
    it = views.interactions(spark, sf).filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp"))
    s = it.groupBy("user_id", "item_id", "category_id").agg(F.sum(X.action_weight(F.col("action"), "profile")).alias("score"))
    return R.quota(s.select("user_id", "item_id", "score", "category_id"), 2, 10, ["user_id"])


@register("F7_last_history", SQL_INTERACTIONS + """, r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from interactions)
select user_id, string_agg(item_id::varchar, ',' order by rn desc) history from r where rn <= 50 group by 1""")
def f7(spark, sf):
    last = O.last_n(views.interactions(spark, sf), "user_id", 50)
    return last.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "item_id"))), lambda x: x["item_id"].cast("string")), ",").alias("history"))


@register("G2_merged_channels", SQL_INTERACTIONS + f""", a as (select user_id, item_id, sum({_weight('profile')}) score from interactions group by 1, 2), b as (select user_id, item_id, max(price) score from interactions where action = 'purchase' group by 1, 2),
u as (select *, 'history' source from a union all select *, 'purchase' from b)
select user_id, item_id, max(score) score, string_agg(source, ',' order by source) sources, max(struct_pack(s := score, t := source)).t best_source from u group by 1, 2""")
def g2(spark, sf):
    it = views.interactions(spark, sf)
    a = it.groupBy("user_id", "item_id").agg(F.sum(X.action_weight(F.col("action"), "profile")).alias("score"))
    b = it.filter("action = 'purchase'").groupBy("user_id", "item_id").agg(F.max("price").alias("score"))
    return R.merge_channels(history=a, purchase=b)


@register("G4_history_overlap", _RECS + """, h as (select distinct user_id, item_id from interactions where action = 'purchase') select r.user_id, count(*) listed, count(h.item_id) known, count(*) - count(h.item_id) fresh from recs r left join h on r.user_id = h.user_id and r.item_id = h.item_id group by 1""")
def g4(spark, sf):
    recs, _ = _recs(spark, sf)
    h = views.interactions(spark, sf).filter("action = 'purchase'").select("user_id", "item_id").distinct().withColumn("k", F.lit(1))
    return recs.join(h, ["user_id", "item_id"], "left").groupBy("user_id").agg(F.count(F.lit(1)).alias("listed"), F.count("k").alias("known"), F.count(F.when(F.col("k").isNull(), 1)).alias("fresh"))


@register("G5_distinct_pairs", SQL_INTERACTIONS + " select distinct user_id, item_id from interactions")
def g5(spark, sf):
    return views.interactions(spark, sf).select("user_id", "item_id").distinct()


@register("J3_similar_vectors", """with n as (select vec_id, embedding::double[] e from embeddings), p as (select q.vec_id query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) similarity from n q, n v where q.vec_id % 100 = 0 and q.vec_id <> v.vec_id)
select *, row_number() over (partition by query_id order by similarity desc, vec_id) rank from p qualify row_number() over (partition by query_id order by similarity desc, vec_id) <= 10""")
def j3(spark, sf):
    v = views.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return R.similar_vectors(v.filter("vec_id % 100 = 0"), v, 10)


@register("J4_attention_edges", SQL_INTERACTIONS + f""", s as (select lag(item_id) over (partition by user_id order by ts, event_id) src, item_id dst, {_G} * exp(-0.1::double * (epoch_us({SQL_AS_OF}) - epoch_us(ts)) / 1e6 / 86400) w from interactions),
e as (select src, dst, sum(w) w from s where src is not null and src <> dst group by 1, 2), f as (select src, dst, w, w / sum(w) over (partition by src) x from e) select src, dst, round(x, 6) weight from f where w > 0""")
def j4(spark, sf):
    return R.attention_edges(views.interactions(spark, sf), AS_OF)


@register("J6_category_recall", SQL_INTERACTIONS + """, c as (select user_id, category_id, count(*) n from interactions group by 1, 2), uc as (select * from c qualify row_number() over (partition by user_id order by n desc, category_id) <= 3),
i as (select category_id, item_id, count(*) p from interactions group by 1, 2), ti as (select * from i qualify row_number() over (partition by category_id order by p desc, item_id) <= 10)
select user_id, item_id, p::double score from uc join ti using (category_id)""")
def j6(spark, sf):
    return R.category_recall(views.interactions(spark, sf))


@register("J8_new_items", SQL_INTERACTIONS + f""", a as (select item_id, count(*) n, (epoch_us({SQL_AS_OF}) - epoch_us(min(ts))) / 1e6 / 86400 age from interactions group by 1)
select item_id, n, round(n * (1 + greatest(0, 1 - age / 35)), 6) score from a where age <= 35 order by score desc, item_id limit 50""")
def j8(spark, sf):
    return R.new_items(views.interactions(spark, sf), AS_OF, 35, 50)


@register("J9_seasonal_items", SQL_INTERACTIONS + """ select item_id, round(count(*) * 1.5::double, 6) score from interactions where category_id in (2, 5) group by 1 order by score desc, item_id limit 50""")
def j9(spark, sf):
    return R.seasonal_items(views.interactions(spark, sf), 1, 50)


@register("J11_sequence_vectors", SQL_INTERACTIONS + """, r as (select user_id, item_id, row_number() over (partition by user_id order by ts desc, event_id desc) rn from interactions),
x as (select user_id, unnest(embedding)::double v, generate_subscripts(embedding, 1) d from r join embeddings on item_id = vec_id where rn <= 50), m as (select user_id, d, round(avg(v), 6) v from x group by 1, 2)
select user_id, d::bigint dim, v mean from m""")
def j11(spark, sf):
    it = views.interactions(spark, sf)
    last = O.last_n(it.repartition(tasks(it.count(), 100_000), "user_id"), "user_id", 50)
    v = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    v = small(v.join(it.select("item_id").distinct(), "item_id", "left_semi"), 100_000)  # rows stay with their users
    x = last.join(v, "item_id").select("user_id", F.posexplode("embedding").alias("d", "v"))
    return x.groupBy("user_id", (F.col("d") + 1).cast("long").alias("dim")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@register("J15_realtime_score", SQL_INTERACTIONS + f""", p as (select item_id, count(*) pop from interactions group by 1), u as (select user_id, item_id, count(*) n, max(ts) last from interactions group by 1, 2)
select user_id, item_id, round(0.3::double * ln(1 + pop) + 0.4::double * ln(1 + n) + 0.2::double * exp(-(epoch_us({SQL_AS_OF}) - epoch_us(last)) / 1e6 / 86400), 6) score from u join p using (item_id)""")
def j15(spark, sf):
    it = views.interactions(spark, sf)
    p = it.groupBy("item_id").agg(F.count(F.lit(1)).alias("pop"))
    u = it.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    age = X.seconds_between(F.lit(AS_OF).cast("timestamp"), F.col("last")) / 86_400
    return u.join(p, "item_id").select("user_id", "item_id", F.round(0.3 * F.log1p("pop") + 0.4 * F.log1p("n") + 0.2 * F.exp(-age), 6).alias("score"))


_LIST = _RECS + """, x as (select recs.*, s.score from recs join s using (user_id, item_id))"""


@register("A13_ranked_lists", _LIST + """ select user_id, count(*) n, string_agg(item_id || ':' || rank, ',' order by rank) items, string_agg((round(score * 1000000)::bigint)::varchar, ',' order by rank) micros from x group by 1""")
def a13(spark, sf):
    recs, _ = _recs(spark, sf)
    return R.ranked_list(recs)


@register("A15_ranked_page", _LIST + """ select user_id, count(*) filter (where rank between 6 and 10) page_rows, min(score) min_score, max(score) max_score, round(avg(score), 6) avg_score from x group by 1""")
def a15(spark, sf):
    recs, _ = _recs(spark, sf)
    return rounded(recs.groupBy("user_id").agg(F.count(F.when(F.col("rank").between(6, 10), 1)).alias("page_rows"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("avg_score")))


@register("A17_training_extract", SQL_INTERACTIONS + f" select event_id, user_id, item_id, action, hour(ts)::int as hour, round(price, 6) price from interactions where ts >= {SQL_AS_OF} - interval 14 days and action in ('view', 'click', 'purchase') and user_id is not null and item_id > 0")
def a17(spark, sf):
    it = views.interactions(spark, sf).filter((F.col("ts") >= O.since(AS_OF, 1_209_600)) & F.col("action").isin("view", "click", "purchase") & F.col("user_id").isNotNull() & (F.col("item_id") > 0))
    return it.select("event_id", "user_id", "item_id", "action", F.hour("ts").alias("hour"), F.round("price", 6).alias("price"))


@register("A20_quality_gates", SQL_INTERACTIONS + """ select 'interactions' as check, count(*)::double as value, 1000.0::double threshold, count(*) >= 1000 passed from interactions union all select 'users', count(distinct user_id)::double, 10.0::double, count(distinct user_id) >= 10 from interactions
union all select 'null_items', count(*) filter (where item_id is null)::double, 0.0::double, count(*) filter (where item_id is null) <= 0 from interactions""")
def a20(spark, sf):
    a = views.interactions(spark, sf).agg(F.count(F.lit(1)).cast("double").alias("interactions"), F.countDistinct("user_id").cast("double").alias("users"), F.count(F.when(F.col("item_id").isNull(), 1)).cast("double").alias("null_items"))
    long = a.unpivot([], ["interactions", "users", "null_items"], "check", "value")
    limit = F.when(F.col("check") == "interactions", 1000.0).when(F.col("check") == "users", 10.0).otherwise(0.0)
    return long.withColumn("threshold", limit).withColumn("passed", F.when(F.col("check") == "null_items", F.col("value") <= limit).otherwise(F.col("value") >= limit))


@register("C4_co_purchases", """select a.l_partkey part1, b.l_partkey part2, count(distinct a.l_orderkey) orders from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey group by 1, 2 having count(distinct a.l_orderkey) >= 2""")
def c4(spark, sf):
    _, pairs = frequent_pairs(views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("item_id")))
    return pairs.toDF("part1", "part2", "orders")


@register("C6_not_bought", SQL_INTERACTIONS + """ select distinct user_id, item_id from interactions where action = 'view' and (user_id, item_id) not in (select (user_id, item_id) from interactions where action = 'purchase' and item_id is not null)""")
def c6(spark, sf):
    it = views.interactions(spark, sf)
    bought = it.filter("action = 'purchase'").select("user_id", "item_id")
    return it.filter("action = 'view'").select("user_id", "item_id").distinct().join(bought, ["user_id", "item_id"], "left_anti")


@register("C7_buyers_events", SQL_INTERACTIONS + """ select event_id, user_id from interactions where user_id in (select user_id from interactions where action = 'purchase')""")
def c7(spark, sf):
    it = views.interactions(spark, sf)
    return it.join(it.filter("action = 'purchase'").select("user_id"), "user_id", "left_semi").select("event_id", "user_id")


@register("C9_as_of_window", SQL_INTERACTIONS + f""", w as (select user_id, epoch_us(time_bucket(interval 5 minutes, ts)) // 1000000 + 300 end_s, count(*) events from interactions group by 1, 2), e as (select event_id, user_id, epoch_us(ts) // 1000000 s from interactions)
select event_id, e.user_id, w.events window_events from e asof left join w on e.user_id = w.user_id and e.s >= w.end_s""")
def c9(spark, sf):
    it = views.interactions(spark, sf)
    w = windows.user_tumbling(it).select("user_id", "end_s", F.col("events").alias("window_events"))
    return R.as_of_join(it.select("event_id", "user_id", F.unix_seconds("ts").alias("s")), w, "user_id", "s", "end_s", "window_events").drop("s")


_C10 = {"1h": 3600, "6h": 21_600, "1d": 86_400, "7d": 604_800}


@register("C10_point_in_time", SQL_INTERACTIONS + """, s as (select event_id, user_id, epoch_us(ts) t from interactions where action = 'purchase'), h as (select user_id, item_id, action, epoch_us(ts) t, price from interactions)
select s.event_id, """ + ", ".join(
    f"""count(h.t) filter (where h.t >= s.t - {w}::bigint * 1000000) n_{n}, count(h.t) filter (where h.t >= s.t - {w}::bigint * 1000000 and action = 'click') clicks_{n},
  count(h.t) filter (where h.t >= s.t - {w}::bigint * 1000000 and action = 'purchase') purchases_{n}, count(distinct item_id) filter (where h.t >= s.t - {w}::bigint * 1000000) items_{n},
  round(coalesce(avg(price) filter (where h.t >= s.t - {w}::bigint * 1000000), 0), 6) avg_price_{n}""" for n, w in _C10.items()
) + """ from s left join h on s.user_id = h.user_id and h.t < s.t and h.t >= s.t - 604800000000 group by 1""")
def c10(spark, sf):
    """What was known of the user just before each purchase; a hot user's history is spread over tasks."""
    it = views.interactions(spark, sf).select("event_id", "user_id", "item_id", "action", "price", F.unix_micros("ts").alias("us"))
    priced, buys, clicks = F.col("price").isNotNull().cast("int"), *[(F.col("action") == a).cast("int") for a in ("purchase", "click")]
    kinds = {"n": F.lit(1), "clicks": clicks, "purchases": buys, "_paid": exact(F.col("price")), "_priced": priced}
    recent = {f"{k}_{w}": Recent(s, v) for w, s in _C10.items() for k, v in kinds.items()} | {f"items_{w}": Recent(s, distinct="item_id") for w, s in _C10.items()}
    out = recent_sums(it, ["user_id"], "us", recent).filter("action = 'purchase'")
    price = [r6(sd(F.col(f"_paid_{w}").cast("double"), F.col(f"_priced_{w}")) / 1_000_000).alias(f"avg_price_{w}") for w in _C10]
    return out.select("event_id", *[f"{k}_{w}" for k in ("n", "clicks", "purchases", "items") for w in _C10], *price)


_HEX = "('0x' || substr(md5({}), 1, 8))::bigint"


@register("R3_negative_samples", SQL_INTERACTIONS + f""", x as (select * from interactions where user_id is not null and item_id is not null), seen as (select distinct user_id, item_id from x),
items as (select item_id, row_number() over (order by {_HEX.format('item_id::varchar')} % 1024, md5(item_id::varchar), item_id) - 1 place from (select distinct item_id from x)),
ps as (select user_id, count(distinct item_id) n from x where action = 'purchase' group by 1), met as (select user_id, count(*) met from seen group by 1),
due as (select user_id, total - met unseen, least(n * 4, total - met) k from ps join met using (user_id), (select count(*) total from items)),
draws as (select user_id, i, i * unseen // k lo, (i + 1) * unseen // k hi from (select *, unnest(range(0, k)) i from due where k > 0)),
free as (select p.user_id, items.item_id, row_number() over (partition by p.user_id order by place) - 1 j from ps p, items where not exists (select 1 from seen s where s.user_id = p.user_id and s.item_id = items.item_id))
select d.user_id, item_id, 0 as label from draws d join free f on f.user_id = d.user_id and f.j = lo + {_HEX.format("d.user_id || ':' || i")} % (hi - lo)""")
def r3(spark, sf):
    """Four unseen items for each positive, or all unseen items where there are fewer.

    A user's unseen items, in an order that a hash of the item shuffles, are cut into as many runs of (nearly) equal
    length as items are due, and a hash draws one of each run; so no draw meets a seen item or an earlier draw.
    """
    it = views.interactions(spark, sf).filter("user_id is not null and item_id is not null")
    seen = it.select("user_id", "item_id").distinct()
    # The place of each item: its place in a bucket of the hash, after the items of the buckets before.
    items = it.select("item_id").distinct().withColumn("b", X.hash_bucket(F.col("item_id"), 1024))
    sizes = items.groupBy("b").agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.select("b", (F.sum("size").over(W.orderBy("b")) - F.col("size")).alias("start"))
    at = F.row_number().over(W.partitionBy("b").orderBy(F.md5(F.col("item_id").cast("string").cast("binary")), "item_id")) - 1
    items = items.withColumn("at", at).join(F.broadcast(starts), "b").select("item_id", (F.col("start") + F.col("at")).alias("place"))
    positives = it.filter("action = 'purchase'").select("user_id", "item_id").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    met = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("met"))
    due = positives.join(met, "user_id").crossJoin(F.broadcast(sizes.agg(F.sum("size").alias("all_items")))).withColumn("unseen", F.col("all_items") - F.col("met"))
    due = due.withColumn("k", F.least(F.col("n") * 4, F.col("unseen"))).filter("k > 0")
    draws = due.select("user_id", "unseen", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i"))
    draws = draws.withColumn("lo", F.expr("i * unseen div k")).withColumn("hi", F.expr("(i + 1) * unseen div k"))
    draws = draws.select("user_id", (F.col("lo") + X.hash_bucket(F.concat_ws(":", "user_id", "i"), F.col("hi") - F.col("lo"))).alias("key"), F.lit(0).alias("is_seen"))
    # Unseen place u stands at place u plus the number of seen places before it.
    own = seen.join(due.select("user_id"), "user_id", "left_semi").join(items, "item_id")
    own = own.select("user_id", (F.col("place") - F.row_number().over(W.partitionBy("user_id").orderBy("place")) + 1).alias("key"), F.lit(1).alias("is_seen"))
    before = F.sum("is_seen").over(W.partitionBy("user_id").orderBy("key", F.desc("is_seen")).rowsBetween(W.unboundedPreceding, 0))
    places = draws.unionByName(own).withColumn("place", F.col("key") + before).filter("is_seen = 0")
    return places.join(items, "place").select("user_id", "item_id", F.lit(0).alias("label"))
