"""Registered queries of the remaining families with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recfeat import views
from recfeat.functions import exprs as X
from recfeat.functions.exprs import count_if, r6, sd
from recfeat.operators import features as O
from recfeat.operators import ranking as K
from recfeat.operators import recall as R
from recfeat.operators import text as M
from recfeat.operators.quantiles import quantiles
from recfeat.plans.catalog import register
from recfeat.plans.features import _DWELL, _n, _weight, rounded
from recfeat.plans.metrics import _RATE_COLS, _RATES, _RECS, _recs
from recfeat.plans.profiles import _SENT, _USER_TAGS, _item_tags
from recfeat.views import AS_OF, SQL_AS_OF, SQL_INTERACTIONS, SQL_PURCHASES, SQL_SESSIONS


@register("A1_part_scan", "select p_partkey item_id, p_name title, p_brand brand, p_retailprice price from part where p_size > 10")
def a1(spark, sf):
    return views.items(spark, sf).filter("size > 10").select("item_id", "title", "brand", "price")


@register("A4_event_json", "select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events")
def a4(spark, sf):
    e = views.table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"].alias("k"))


@register("A5_dimension_lookup", SQL_INTERACTIONS + " select event_id, item_id, p_brand brand, p_retailprice list_price from interactions left join part on item_id = p_partkey")
def a5(spark, sf):
    items = views.items(spark, sf).select("item_id", "brand", F.col("price").alias("list_price"))
    return views.interactions(spark, sf).join(items, "item_id", "left").select("event_id", "item_id", "brand", "list_price")


@register("A12_recall_snapshot", _RECS + f" select user_id, item_id, rank, '2024-01-20' as dt from recs where rank <= 10")
def a12(spark, sf):
    recs, _ = _recs(spark, sf)
    return recs.filter("rank <= 10").select("user_id", "item_id", F.col("rank").cast("long").alias("rank"), F.lit("2024-01-20").alias("dt"))


@register("B1_valid_rows", SQL_INTERACTIONS + " select event_id from interactions where user_id is not null and item_id is not null and epoch_us(ts) > 0")
def b1(spark, sf):
    return views.interactions(spark, sf).filter(F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & (F.unix_micros("ts") > 0)).select("event_id")


@register("B4_dedup", SQL_INTERACTIONS + " select user_id, item_id, epoch_us(ts) us from interactions group by 1, 2, 3")
def b4(spark, sf):
    return views.interactions(spark, sf).dropDuplicates(["user_id", "item_id", "ts"]).select("user_id", "item_id", F.unix_micros("ts").alias("us"))


@register("B8_price_tier", "with r as (select p_type, min(p_retailprice) lo, max(p_retailprice) hi from part group by 1) select p_partkey item_id, round(case when hi = lo then 0 else least(1, greatest(0, (p_retailprice - lo) / (hi - lo))) end, 6) tier from part join r using (p_type)")
def b8(spark, sf):
    items = views.items(spark, sf)
    r = items.groupBy("category").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    return items.join(r, "category").select("item_id", r6(X.clip(sd(F.col("price") - F.col("lo"), F.col("hi") - F.col("lo")), 0.0, 1.0)).alias("tier"))


@register("B9_word_counts", "select p_partkey item_id, len(string_split(p_type, ' ')) words from part")
def b9(spark, sf):
    return views.items(spark, sf).select("item_id", F.size(F.split("category", " ")).cast("long").alias("words"))


@register("B11_season", "select o_orderkey order_id, ((month(o_orderdate) - 1) // 3)::int season, case when month(o_orderdate) in (11, 12) then 1.0::double when month(o_orderdate) in (6, 7) then 0.5::double else 0.0::double end holiday from orders")
def b11(spark, sf):
    m = F.month("o_orderdate")
    return views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.floor((m - 1) / 3).cast("int").alias("season"), F.when(m.isin(11, 12), 1.0).when(m.isin(6, 7), 0.5).otherwise(0.0).alias("holiday"))


@register("B14_hash_encoding", "select distinct p_brand brand, (('0x' || substr(md5(p_brand), 1, 8))::bigint) % 1000 code from part")
def b14(spark, sf):
    return views.items(spark, sf).select("brand").distinct().select("brand", X.hash_bucket(F.col("brand"), 1000).alias("code"))


@register("B19_user_types", SQL_INTERACTIONS + f""", a as (select user_id, count(*) n, date_diff('day', min(ts)::date, date '2024-01-31') reg, date_diff('day', max(ts)::date, date '2024-01-31') idle, count(*) filter (where ts >= {SQL_AS_OF} - interval 30 days) m from interactions group by 1)
select user_id, case when reg < 7 and n < 5 then 'new' when idle > 30 then 'dormant' when m > 50 then 'power' else 'active' end kind from a""")
def b19(spark, sf):
    end = F.lit(AS_OF.date())
    a = views.interactions(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.datediff(end, F.min("ts")).alias("reg"), F.datediff(end, F.max("ts")).alias("idle"), count_if(F.col("ts") >= O.since(AS_OF, 2_592_000)).alias("m"))
    return a.select("user_id", F.when((F.col("reg") < 7) & (F.col("n") < 5), "new").when(F.col("idle") > 30, "dormant").when(F.col("m") > 50, "power").otherwise("active").alias("kind"))


@register("B20_activity_levels", SQL_INTERACTIONS + f""", a as (select user_id, {_n('click', f"ts >= {SQL_AS_OF} - interval 7 days")} / 7 c, avg(price) filter (where action = 'purchase') aov, least(1, count(distinct item_id) / greatest({_n('click')}, 1)) x from interactions group by 1)
select user_id, case when c >= 20 then 'super' when c >= 10 then 'high' when c >= 3 then 'normal' else 'low' end activity, case when aov >= 1000 then 'premium' when aov >= 500 then 'high' when aov >= 100 then 'medium' else 'low' end power, round(x, 6) exploration from a""")
def b20(spark, sf):
    a = views.interactions(spark, sf).groupBy("user_id").agg(
        (O.n_action("click", F.col("ts") >= O.since(AS_OF, 604_800)) / 7).alias("c"), F.avg(F.when(F.col("action") == "purchase", F.col("price"))).alias("aov"), F.least(F.lit(1.0), F.countDistinct("item_id") / F.greatest(O.n_action("click"), F.lit(1))).alias("x"),
    )
    level = F.when(F.col("c") >= 20, "super").when(F.col("c") >= 10, "high").when(F.col("c") >= 3, "normal").otherwise("low")
    power = F.when(F.col("aov") >= 1000, "premium").when(F.col("aov") >= 500, "high").when(F.col("aov") >= 100, "medium").otherwise("low")
    return a.select("user_id", level.alias("activity"), power.alias("power"), r6("x").alias("exploration"))


@register("C1_feature_join", SQL_INTERACTIONS + ", u as (select user_id, count(*) un from interactions group by 1), i as (select item_id, count(*) inn from interactions group by 1) select event_id, un user_total, inn item_total from interactions join u using (user_id) join i using (item_id)")
def c1(spark, sf):
    it = views.interactions(spark, sf)
    u = it.groupBy("user_id").agg(F.count(F.lit(1)).alias("user_total"))
    i = it.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_total"))
    return it.join(u, "user_id").join(i, "item_id").select("event_id", "user_total", "item_total")


@register("C3_full_outer_merge", SQL_INTERACTIONS + ", a as (select user_id, count(*) buys from interactions where action = 'purchase' and ts >= timestamp '2024-01-28' group by 1), b as (select user_id, count(*) clicks from interactions where action = 'click' and ts >= timestamp '2024-01-28' group by 1) select user_id, coalesce(buys, 0) buys, coalesce(clicks, 0) clicks from a full join b using (user_id)")
def c3(spark, sf):
    it = views.interactions(spark, sf).filter(F.col("ts") >= O.since(AS_OF, 3 * 86_400))
    a = it.filter("action = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("buys"))
    b = it.filter("action = 'click'").groupBy("user_id").agg(F.count(F.lit(1)).alias("clicks"))
    return a.join(b, "user_id", "full_outer").select("user_id", F.coalesce("buys", F.lit(0)).cast("long").alias("buys"), F.coalesce("clicks", F.lit(0)).cast("long").alias("clicks"))


@register("C13_preference_overlap", SQL_INTERACTIONS + ", u as (select user_id, list(distinct category_id) filter (where action = 'click') a, list(distinct category_id) filter (where action = 'purchase') b from interactions group by 1) select user_id, len(list_intersect(coalesce(a, []), coalesce(b, []))) shared from u")
def c13(spark, sf):
    of = lambda a: F.collect_set(F.when(F.col("action") == a, F.col("category_id")))
    return views.interactions(spark, sf).groupBy("user_id").agg(F.size(F.array_intersect(of("click"), of("purchase"))).cast("long").alias("shared"))


@register("D11_feature_vector", SQL_INTERACTIONS + f" select user_id, {', '.join(_n(a, f'ts >= {SQL_AS_OF} - interval {s} seconds') + f' user_{w}_{a}' for w, s in (('1d', 86400), ('7d', 604800)) for a in ('view', 'click', 'purchase'))} from interactions group by 1")
def d11(spark, sf):
    aggs = [O.n_action(a, F.col("ts") >= O.since(AS_OF, s)).alias(f"user_{w}_{a}") for w, s in (("1d", 86_400), ("7d", 604_800)) for a in ("view", "click", "purchase")]
    return views.interactions(spark, sf).groupBy("user_id").agg(*aggs)


@register("D23_level_metrics", SQL_INTERACTIONS + f", l as (select 'user' level, user_id::varchar id, {_RATES} from interactions group by user_id union all select 'item', item_id::varchar, {_RATES} from interactions group by item_id union all select 'system', 'all', {_RATES} from interactions) select level, id, events, users, round(click / greatest(impression, 1), 6) ctr from l")
def d23(spark, sf):
    it = views.interactions(spark, sf)
    level = F.when(F.grouping("user_id") == 0, "user").when(F.grouping("item_id") == 0, "item").otherwise("system")
    out = it.groupingSets([["user_id"], ["item_id"], []], "user_id", "item_id").agg(
        level.alias("level"), F.count(F.lit(1)).alias("events"), F.countDistinct(it.user_id).alias("users"), O.n_action("click").alias("c"), O.n_action("impression").alias("i"),
    )
    return out.select("level", F.coalesce(F.col("user_id").cast("string"), F.col("item_id").cast("string"), F.lit("all")).alias("id"), "events", "users", r6(F.col("c") / F.greatest("i", F.lit(1))).alias("ctr"))


@register("D26_key_summary", SQL_INTERACTIONS + ", k as (select 'user:' || user_id k from interactions union select 'item:' || item_id from interactions) select split_part(k, ':', 1) prefix, count(*) keys from k group by 1")
def d26(spark, sf):
    it = views.interactions(spark, sf)
    k = it.select(F.concat_ws(":", F.lit("user"), F.col("user_id").cast("string")).alias("k")).union(it.select(F.concat_ws(":", F.lit("item"), F.col("item_id").cast("string")))).distinct()
    return k.groupBy(F.split_part("k", F.lit(":"), F.lit(1)).alias("prefix")).agg(F.count(F.lit(1)).alias("keys"))


@register("D28_throughput", SQL_INTERACTIONS + """, m as (select epoch_us(date_trunc('hour', ts)) // 1000000 h, count(*) n from interactions group by 1), g as (select unnest(generate_series((select min(h) from m), (select max(h) from m), 3600)) h) select h hour_s, coalesce(n, 0) n from g left join m using (h)""")
def d28(spark, sf):
    m = views.interactions(spark, sf).groupBy((F.floor(F.unix_seconds("ts") / 3600) * 3600).alias("hour_s")).agg(F.count(F.lit(1)).alias("n"))
    grid = m.agg(F.explode(F.sequence(F.min("hour_s"), F.max("hour_s"), F.lit(3600).cast("long"))).alias("hour_s"))
    return grid.join(m, "hour_s", "left").select("hour_s", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@register("E8_above_p80", SQL_INTERACTIONS + ", c as (select item_id, count(*) n from interactions group by 1) select item_id, n from c where n >= (select quantile_cont(n, 0.8) from c)")
def e8(spark, sf):
    c = views.interactions(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    q = quantiles(c, F.col("n"), (0.8,)).select(F.get("q", F.lit(0)).alias("q"))
    return c.join(F.broadcast(q), F.col("n") >= F.col("q")).select("item_id", "n")  # one row broadcast


@register("H1_string_functions", "select p_partkey item_id, lower(p_type) low, len(string_split(p_type, ' ')) parts, contains(p_type, 'STEEL') steel, replace(p_type, ' ', '_') joined, regexp_extract(p_type, '([A-Z]+)$', 1) last_word from part")
def h1(spark, sf):
    t = F.col("category")
    return views.items(spark, sf).select("item_id", F.lower(t).alias("low"), F.size(F.split(t, " ")).cast("long").alias("parts"), t.contains("STEEL").alias("steel"), F.replace(t, F.lit(" "), F.lit("_")).alias("joined"), F.regexp_extract(t, "([A-Z]+)$", 1).alias("last_word"))


@register("H2_date_functions", "select o_orderkey order_id, (isodow(o_orderdate) - 1)::int monday0, date_diff('day', o_orderdate::date, date '1999-01-01')::int days_left, epoch_us(date_trunc('month', o_orderdate::timestamp)) // 1000000 month_s from orders")
def h2(spark, sf):
    d = F.col("o_orderdate")
    return views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.weekday(d).alias("monday0"), F.datediff(F.lit("1999-01-01").cast("date"), d).alias("days_left"), F.unix_seconds(F.date_trunc("month", d.cast("timestamp"))).alias("month_s"))


@register("H3_math_functions", "select p_partkey item_id, round(exp(-p_size / 10), 6) e, round(ln(1 + p_size), 6) l, round(sqrt(p_retailprice), 6) s, round(1 / (1 + exp(-(p_size - 25) / 5)), 6) sigmoid, round(asin(p_size / 51), 6) a from part")
def h3(spark, sf):
    p = views.items(spark, sf)
    z = F.col("size")
    return p.select("item_id", *[r6(c).alias(n) for n, c in (("e", F.exp(-z / 10)), ("l", F.log1p(z)), ("s", F.sqrt("price")), ("sigmoid", 1 / (1 + F.exp(-(z - 25) / 5))), ("a", F.asin(z / 51)))])


@register("H5_array_functions", SQL_INTERACTIONS + ", a as (select user_id, list(item_id order by ts, event_id) x from interactions group by 1) select user_id, len(x) n, x[-1] last_item, list_contains(x, 5) has_five, array_to_string(x[greatest(len(x) - 4, 1):], ',') last5 from a")
def h5(spark, sf):
    x = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "item_id"))), lambda s: s["item_id"])
    a = views.interactions(spark, sf).groupBy("user_id").agg(x.alias("x"))
    tail = F.slice("x", F.greatest(F.size("x") - 4, F.lit(1)), F.lit(5))
    return a.select("user_id", F.size("x").cast("long").alias("n"), F.element_at("x", -1).alias("last_item"), F.array_contains("x", 5).alias("has_five"), F.array_join(tail, ",").alias("last5"))


@register("H7_json_functions", SQL_INTERACTIONS + """ select event_id, '{"u":' || user_id || ',"a":"' || action || '"}' as doc from interactions""")
def h7(spark, sf):
    return views.interactions(spark, sf).select("event_id", F.to_json(F.struct(F.col("user_id").alias("u"), F.col("action").alias("a"))).alias("doc"))


@register("I8_cross_features", SQL_INTERACTIONS + """, u as (select user_id, count(*) act, avg(price) ap from interactions group by 1), i as (select item_id, count(*) pop from interactions group by 1)
select event_id, round(0.3::double * least(act / 100, 1) + 0.3::double * least(pop / 1000, 1) + 0.4::double * (1 - least(abs(ap - price) / greatest(ap, 1), 1)), 6) score from interactions join u using (user_id) join i using (item_id)""")
def i8(spark, sf):
    it = views.interactions(spark, sf)
    u = it.groupBy("user_id").agg(F.count(F.lit(1)).alias("act"), F.avg("price").alias("ap"))
    i = it.groupBy("item_id").agg(F.count(F.lit(1)).alias("pop"))
    one = F.lit(1.0)
    s = 0.3 * F.least(F.col("act") / 100, one) + 0.3 * F.least(F.col("pop") / 1000, one) + 0.4 * (1 - F.least(F.abs(F.col("ap") - F.col("price")) / F.greatest("ap", one), one))
    return it.join(u, "user_id").join(i, "item_id").select("event_id", r6(s).alias("score"))


@register("I13_embedding_ema", SQL_INTERACTIONS + """, o as (select user_id, item_id, count(*) over (partition by user_id) n, row_number() over (partition by user_id order by ts, event_id) i from interactions join embeddings on item_id = vec_id),
x as (select user_id, unnest(embedding)::double v, generate_subscripts(embedding, 1) dim, 0.1::double * pow(0.9::double, n - i) w from o join embeddings on item_id = vec_id) select user_id, dim::bigint dim, round(sum(w * v), 6) ema from x group by 1, 2""")
def i13(spark, sf):
    """The closed form of the running average: event i of n weighs .1 x .9 ** (n - i)."""
    v = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    w = W.partitionBy("user_id")
    o = views.interactions(spark, sf).join(v, "item_id").withColumns({"n": F.count(F.lit(1)).over(w), "i": F.row_number().over(w.orderBy("ts", "event_id"))})
    x = o.select("user_id", (0.1 * F.pow(F.lit(0.9), F.col("n") - F.col("i"))).alias("w"), F.posexplode("embedding").alias("d", "v"))
    return x.groupBy("user_id", (F.col("d") + 1).cast("long").alias("dim")).agg(r6(F.sum(F.col("w") * F.col("v").cast("double"))).alias("ema"))


_H = "h as (select distinct user_id, item_id from interactions where ts >= " + SQL_AS_OF + " - interval 3 days)"
_EDGE = f"""s as (select lag(item_id) over (partition by user_id order by ts, event_id) src, item_id dst, {_weight('graph')} * exp(-0.1::double * (epoch_us({SQL_AS_OF}) - epoch_us(ts)) / 1e6 / 86400) w from interactions),
e as (select src, dst, sum(w) w from s where src is not null and src <> dst group by 1, 2), f as (select src, dst, w, round(w / sum(w) over (partition by src), 6) weight from e)"""


@register("J18_click_rules", SQL_INTERACTIONS + """ select event_id, round(least(1.0::double, greatest(0.0::double, 0.05::double + case when user_id % 60 < 25 then 0.1 else 0 end::double + case when user_id % 60 > 50 then -0.05 else 0 end::double + case when category_id = user_id % 10 then 0.3 else 0 end::double + case when brand_id = user_id % 7 then 0.2 else 0 end::double
  + case when price between 200 and 1000 then 0.075 else 0 end::double + case when hour(ts) between 18 and 22 then 0.05 else 0 end::double + case when platform = 'Mobile' then -0.02 else 0 end::double)), 6) score from interactions""")
def j18(spark, sf):
    age = F.col("user_id") % 60
    rules = K.click_rules(age, F.col("category_id") == F.col("user_id") % 10, F.col("brand_id") == F.col("user_id") % 7, F.col("price"), F.lit(0), F.hour("ts"), F.col("platform") == "Mobile")
    return views.interactions(spark, sf).select("event_id", r6(K.click_score(rules)[0]).alias("score"))


@register("J19_interest_boost", SQL_INTERACTIONS + f", s as (select user_id, item_id, category_id, max(price) score from interactions group by 1, 2, 3), i as (select user_id, category_id, least(10, sum({_weight('profile')} * 0.1::double)) interest from interactions group by 1, 2) select user_id, item_id, round(score + 0.1::double * interest, 6) score from s join i using (user_id, category_id)")
def j19(spark, sf):
    it = views.interactions(spark, sf)
    recs = it.groupBy("user_id", "item_id", "category_id").agg(F.max("price").alias("score"))
    interest = it.groupBy("user_id", "category_id").agg(F.least(F.lit(10.0), F.sum(X.action_weight(F.col("action"), "profile") * 0.1)).alias("interest"))
    return K.interest_boost(recs, interest).select("user_id", "item_id", r6("score").alias("score"))


@register("K7_user_top_tags", _USER_TAGS + ", c as (select user_id, tag, count(*) n from interactions join item_tags using (item_id) group by 1, 2), r as (select *, row_number() over (partition by user_id order by n desc, tag) rn from c) select user_id, string_agg(tag, ',' order by rn) top_tags from r where rn <= 10 group by 1")
def k7(spark, sf):
    joined = views.interactions(spark, sf).join(_item_tags(spark, sf).select("item_id", "tag"), "item_id")
    return O.top_values(joined, ["user_id"], "tag", 10, "top_tags")


@register("K15_tag_timeline", _USER_TAGS + f" select event_id, user_id, tag from interactions join item_tags using (item_id) where ts >= {SQL_AS_OF} - interval 7 days")
def k15(spark, sf):
    recent = views.interactions(spark, sf).filter(F.col("ts") >= O.since(AS_OF, 604_800))
    return recent.join(_item_tags(spark, sf), "item_id").select("event_id", "user_id", "tag")


@register("L14_position_curve", SQL_SESSIONS + ", p as (select action, row_number() over (partition by user_id, session_id order by ts, event_id) pos from sessions) select pos, count(*) n, round(avg((action in ('click', 'purchase'))::int), 6) positive from p where pos <= 10 group by 1")
def l14(spark, sf):
    w = W.partitionBy("user_id", "session_id").orderBy("ts", "event_id")
    p = views.interactions(spark, sf, sessions=True).select("action", F.row_number().over(w).cast("long").alias("pos")).filter("pos <= 10")
    return rounded(p.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("action").isin("click", "purchase").cast("int")).alias("positive")))


@register("L24_novelty", _RECS + """, h as (select distinct user_id, item_id from interactions where ts < timestamp '2024-01-10'), hc as (select distinct user_id, item_id % 10 c from h), p as (select item_id, count(*) pop from interactions group by 1)
select r.user_id, round(1 - avg((h.item_id is not null)::int), 6) item_novelty, round(1 - avg((hc.c is not null)::int), 6) category_novelty, round(avg(pop), 6) mean_popularity from recs r left join h on h.user_id = r.user_id and h.item_id = r.item_id left join hc on hc.user_id = r.user_id and hc.c = r.item_id % 10 join p on p.item_id = r.item_id group by 1""")
def l24(spark, sf):
    recs, _ = _recs(spark, sf)
    it = views.interactions(spark, sf)
    h = it.filter(F.col("ts") < F.lit("2024-01-10").cast("timestamp")).select("user_id", "item_id").distinct()
    hc = h.select("user_id", (F.col("item_id") % 10).alias("c")).distinct().withColumn("hc", F.lit(1))
    p = it.groupBy("item_id").agg(F.count(F.lit(1)).alias("pop"))
    x = recs.withColumn("c", F.col("item_id") % 10).join(h.withColumn("h", F.lit(1)), ["user_id", "item_id"], "left").join(hc, ["user_id", "c"], "left").join(p, "item_id")
    known = lambda c: 1 - F.avg(F.col(c).isNotNull().cast("int"))
    return rounded(x.groupBy("user_id").agg(known("h").alias("item_novelty"), known("hc").alias("category_novelty"), F.avg("pop").alias("mean_popularity")))


@register("L27_anomaly_alerts", SQL_INTERACTIONS + f", a as (select {_RATES} from interactions), b as (select *, {_RATE_COLS} from a), m as (select 'ctr' metric, ctr as value, 0.01::double lo, 0.15::double hi from b union all select 'purchase_rate', purchase / greatest(view, 1), 0.005, 0.08 from b) select metric, round(value, 6) as value, case when value < 0.5::double * lo then 'HIGH' else 'MEDIUM' end severity from m where value < lo or value > hi")
def l27(spark, sf):
    a = views.interactions(spark, sf).agg(*[O.n_action(x).alias(x) for x in ("click", "impression", "purchase", "view")])
    m = a.select((F.round(F.col("click") / F.greatest("impression", F.lit(1)), 6)).alias("ctr"), (F.col("purchase") / F.greatest("view", F.lit(1))).alias("purchase_rate")).unpivot([], ["ctr", "purchase_rate"], "metric", "value")
    lo, hi = F.when(F.col("metric") == "ctr", 0.01).otherwise(0.005), F.when(F.col("metric") == "ctr", 0.15).otherwise(0.08)
    return m.filter((F.col("value") < lo) | (F.col("value") > hi)).select("metric", r6("value").alias("value"), F.when(F.col("value") < 0.5 * lo, "HIGH").otherwise("MEDIUM").alias("severity"))


@register("L28_health_score", SQL_INTERACTIONS + """, a as (select count(*) filter (where action = 'click') / count(*) filter (where action = 'view') ctr, count(*) filter (where action = 'purchase') / count(*) conv, sum(price) filter (where action = 'purchase') rev, count(distinct user_id) users from interactions)
select round(least(100, greatest(0, 100 - 30 * greatest(0, (0.02::double - ctr) / 0.02::double) - 25 * greatest(0, (0.01::double - conv) / 0.01::double) - 25 * greatest(0, (1000 - rev) / 1000) - 20 * greatest(0, (100 - users) / 100))), 6) health from a""")
def l28(spark, sf):
    a = views.interactions(spark, sf).agg(sd(O.n_action("click"), O.n_action("view")).alias("ctr"), (O.n_action("purchase") / F.count(F.lit(1))).alias("conv"), F.sum(F.when(F.col("action") == "purchase", F.col("price"))).alias("rev"), F.countDistinct("user_id").alias("users"))
    short = lambda c, goal: F.greatest(F.lit(0.0), (goal - F.col(c)) / goal)
    return a.select(r6(X.clip(100 - 30 * short("ctr", 0.02) - 25 * short("conv", 0.01) - 25 * short("rev", 1000.0) - 20 * short("users", 100.0), 0.0, 100.0)).alias("health"))


@register("L29_binary_metrics", """with s as (select toxic y, (n_chars % 97) / 97 p from documents join labels using (doc_id)) select round(avg(((p >= 0.5)::int = y)::int), 6) accuracy, round(sum((p >= 0.5 and y = 1)::int) / sum((p >= 0.5)::int), 6) "precision", round(sum((p >= 0.5 and y = 1)::int) / sum(y), 6) recall, round(avg(p), 6) mean_score, round(avg(y), 6) base_rate from s""")
def l29(spark, sf):
    s = views.table(spark, sf, "documents").join(views.table(spark, sf, "labels"), "doc_id").select(F.col("toxic").alias("y"), ((F.col("n_chars") % 97) / 97).alias("p"))
    said = F.col("p") >= 0.5
    hit = count_if(said & (F.col("y") == 1))
    return rounded(s.agg(F.avg((said.cast("int") == F.col("y")).cast("int")).alias("accuracy"), sd(hit, count_if(said)).alias("precision"), sd(hit, F.sum("y")).alias("recall"), F.avg("p").alias("mean_score"), F.avg("y").alias("base_rate")))


@register("N4_feature_set", SQL_INTERACTIONS + f" select user_id, {_n('view')} as view, {_n('purchase')} purchase from interactions group by 1")
def n4(spark, sf):
    long = views.interactions(spark, sf).groupBy("user_id", "action").agg(F.count(F.lit(1)).alias("n"))
    return long.groupBy("user_id").pivot("action", ["view", "purchase"]).agg(F.first("n")).na.fill(0)


@register("O4_personas", SQL_INTERACTIONS + f", a as (select user_id, {_n('purchase')} p, {_n('view')} v, count(distinct category_id) c from interactions group by 1) select user_id, case when p > 15 then 'buyer' when c >= 10 and v > 15 then 'explorer' when v > 15 then 'browser' else 'casual' end persona from a")
def o4(spark, sf):
    a = views.interactions(spark, sf).groupBy("user_id").agg(O.n_action("purchase").alias("p"), O.n_action("view").alias("v"), F.countDistinct("category_id").alias("c"))
    return a.select("user_id", F.when(F.col("p") > 15, "buyer").when((F.col("c") >= 10) & (F.col("v") > 15), "explorer").when(F.col("v") > 15, "browser").otherwise("casual").alias("persona"))


@register("O5_popular_diverse", SQL_INTERACTIONS + ", i as (select category_id, item_id, count(*) n from interactions group by 1, 2) select category_id, item_id, n from i qualify row_number() over (partition by category_id order by n desc, item_id) = 1")
def o5(spark, sf):
    i = views.interactions(spark, sf).groupBy("category_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    return R.top_k(i, 1, "n", "item_id", ["category_id"]).drop("rank")


@register("O7_new_item_boost", "select p_partkey item_id, round(least(1.0::double, 0.5::double + case when p_retailprice > 1500 then 0.2 else 0 end::double + case when contains(p_type, 'STEEL') then 0.1 else 0 end::double + case when contains(p_type, 'PROMO') then 0.3 else 0 end::double), 6) boost from part")
def o7(spark, sf):
    b = 0.5 + F.when(F.col("price") > 1500, 0.2).otherwise(0.0) + F.when(F.col("category").contains("STEEL"), 0.1).otherwise(0.0) + F.when(F.col("category").contains("PROMO"), 0.3).otherwise(0.0)
    return views.items(spark, sf).select("item_id", r6(F.least(F.lit(1.0), b)).alias("boost"))


_WATCH = "with w as (select event_id % 40 video_id, user_id, value watched, 60.0::double + (event_id % 40) * 15 length from events)"


def _watches(spark, sf):
    v = F.col("event_id") % 40
    return views.table(spark, sf, "events").select(v.alias("video_id"), "user_id", F.col("value").alias("watched"), (60.0 + v * 15).alias("length"))


@register("Q1_watch_patterns", _WATCH + """, u as (select video_id, user_id, count(*) n from w group by 1, 2), r as (select video_id, avg((n > 1)::int) replay_rate from u group by 1),
a as (select video_id, count(*) watches, avg(watched) mean_watched, quantile_cont(watched, 0.5) median_watched, avg((watched >= 0.95::double * length)::int) completion, avg(least(1.0::double, watched / length)) watch_ratio, max(length) length from w group by 1)
select video_id, watches, round(mean_watched, 6) mean_watched, round(median_watched, 6) median_watched, round(completion, 6) completion, round(watch_ratio, 6) watch_ratio, round(replay_rate, 6) replay_rate, length,
  round(least(1.0::double, 0.4::double * completion + 0.3::double * least(2 * replay_rate, 1) + 0.3::double * watch_ratio), 6) engagement, case when length <= 15 then 'micro' when length <= 60 then 'short' when length <= 180 then 'medium' when length <= 600 then 'long' else 'extended' end category from a join r using (video_id)""")
def q1(spark, sf):
    return rounded(K.watch_patterns(_watches(spark, sf)))


@register("Q2_retention_curve", _WATCH + """, c as (select video_id, b bucket, avg((watched >= b / 20 * length)::int) retention from w, range(20) t(b) group by 1, 2), d as (select *, lag(retention) over (partition by video_id order by bucket) p from c)
select video_id, bucket::int bucket, round(retention, 6) retention, round(coalesce(p - retention, 0), 6) as drop, coalesce(p - retention, 0) > 0.1 or coalesce(case when p = 0 then 0 else (p - retention) / p end > 0.2, false) major from d""")
def q2(spark, sf):
    return rounded(K.retention_curve(_watches(spark, sf)))


@register("R1_labels", SQL_INTERACTIONS + " select event_id, case when action in ('purchase', 'like') then 1 else 0 end label from interactions")
def r1(spark, sf):
    return views.interactions(spark, sf).select("event_id", F.when(F.col("action").isin("purchase", "like"), 1).otherwise(0).alias("label"))


@register("R2_time_split", SQL_INTERACTIONS + ", p as (select event_id, percent_rank() over (partition by user_id order by ts, event_id) r from interactions) select event_id, case when r <= 0.8 then 'train' when r <= 0.9 then 'valid' else 'test' end part from p")
def r2(spark, sf):
    r = F.percent_rank().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return views.interactions(spark, sf).select("event_id", r.alias("r")).select("event_id", F.when(F.col("r") <= 0.8, "train").when(F.col("r") <= 0.9, "valid").otherwise("test").alias("part"))


@register("R8_error_drift", SQL_INTERACTIONS + f", e as (select ts, abs(price - avg(price) over (partition by item_id)) e from interactions) select round(avg(e) filter (where ts >= {SQL_AS_OF} - interval 3 days), 6) recent, round(avg(e) filter (where ts < {SQL_AS_OF} - interval 3 days), 6) historical, round(avg(e) filter (where ts >= {SQL_AS_OF} - interval 3 days) / avg(e) filter (where ts < {SQL_AS_OF} - interval 3 days), 6) drift from e")
def r8(spark, sf):
    it = views.interactions(spark, sf)
    mean = it.groupBy("item_id").agg(F.avg("price").alias("mean"))
    e = it.join(mean, "item_id").select("ts", F.abs(F.col("price") - F.col("mean")).alias("e"))
    late = F.col("ts") >= O.since(AS_OF, 259_200)
    a = e.agg(F.avg(F.when(late, F.col("e"))).alias("recent"), F.avg(F.when(~late, F.col("e"))).alias("historical"))
    return rounded(a.withColumn("drift", F.col("recent") / F.col("historical")))


@register("D16_usage_intensity", SQL_SESSIONS + """, s as (select user_id, session_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 d, count(*) n, max((action = 'purchase')::int) c from sessions group by 1, 2 having count(*) >= 2)
select count(*) sessions, round(least(avg(d) / 300, 1) * 2 + least(avg(n) / 10, 1) * 2 + avg(c) * 3, 6) intensity from s""")
def d16(spark, sf):
    s = O.session_stats(views.interactions(spark, sf, sessions=True))
    one = F.lit(1.0)
    return s.agg(F.count(F.lit(1)).alias("sessions"), r6(F.least(F.avg("duration") / 300, one) * 2 + F.least(F.avg("events") / 10, one) * 2 + F.avg("converted") * 3).alias("intensity"))


@register("P3_outliers", "with q as (select quantile_cont(l_extendedprice, 0.25) a, quantile_cont(l_extendedprice, 0.75) b from lineitem) select count(*) n, count(*) filter (where l_extendedprice < a - 1.5 * (b - a) or l_extendedprice > b + 1.5 * (b - a)) outliers from lineitem, q")
def p3(spark, sf):
    li = views.table(spark, sf, "lineitem")
    q = quantiles(li, F.col("l_extendedprice"), (0.25, 0.75)).select(F.get("q", F.lit(0)).alias("a"), F.get("q", F.lit(1)).alias("b"))
    x, reach = F.col("l_extendedprice"), 1.5 * (F.col("b") - F.col("a"))
    return li.crossJoin(F.broadcast(q)).agg(F.count(F.lit(1)).alias("n"), count_if((x < F.col("a") - reach) | (x > F.col("b") + reach)).alias("outliers"))  # one row broadcast
