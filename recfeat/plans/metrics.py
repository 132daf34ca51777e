"""Registered metric queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recfeat import views
from recfeat.functions import exprs as X
from recfeat.functions.exprs import count_if, r6, sd
from recfeat.operators import features as O
from recfeat.operators import metrics as M
from recfeat.operators.quantiles import quantiles, with_quantiles
from recfeat.plans.catalog import register
from recfeat.plans.features import _DWELL, _n, _weight, rounded
from recfeat.views import AS_OF, SQL_AS_OF, SQL_INTERACTIONS, SQL_PURCHASES, SQL_SESSIONS

# Recommendations: each user's items by weight before the split; truth: items clicked or bought after it.
_SPLIT = "timestamp '2024-01-20 00:00:00'"
_RECS = SQL_INTERACTIONS + f""", s as (select user_id, item_id, sum({_weight('profile')}) score from interactions where ts < {_SPLIT} group by 1, 2),
recs as (select * from (select user_id, item_id, row_number() over (partition by user_id order by score desc, item_id) rank from s) where rank <= 20),
truth as (select distinct user_id, item_id from interactions where ts >= {_SPLIT} and action in ('click', 'purchase')),
hits as (select r.*, (t.item_id is not null)::int hit from recs r left join truth t using (user_id, item_id)),
run as (select *, sum(hit) over (partition by user_id order by rank) found from hits), nt as (select user_id, count(*) n_truth from truth group by 1),
per as (select user_id, k, count(*) listed, sum(hit) hits, sum(hit / log2(rank + 1)) dcg, sum(hit * found / rank) ap_sum, max(case when hit = 1 then 1.0::double / rank end) rr
  from run, (values (5), (10), (20)) t(k) where rank <= k group by 1, 2),
pu as (select user_id, k::bigint k, hits / least(listed, k) p, case when n_truth > 0 then hits / n_truth else 0 end r, case when coalesce(n_truth, 0) = 0 then 0 else dcg / list_sum(list_transform(range(1, least(n_truth, k) + 1), lambda i: 1 / log2(i + 1))) end ndcg,
  case when coalesce(n_truth, 0) = 0 then 0 else ap_sum / least(n_truth, k) end ap, coalesce(rr, 0) rr, (hits > 0)::bigint hit from per left join nt using (user_id)),
m as (select user_id, k, p "precision", r recall, case when p + r = 0 then 0 else 2 * p * r / (p + r) end f1, ndcg, ap, rr, hit from pu)
"""


def _recs(spark, sf):
    it = views.interactions(spark, sf)
    split = F.lit("2024-01-20").cast("timestamp")
    scored = it.filter(F.col("ts") < split).groupBy("user_id", "item_id").agg(F.sum(X.action_weight(F.col("action"), "profile")).alias("score"))
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("score"), F.asc("item_id")))
    recs = scored.withColumn("rank", rank).filter("rank <= 20")
    truth = it.filter((F.col("ts") >= split) & F.col("action").isin("click", "purchase")).select("user_id", "item_id").distinct()
    return recs, truth


@register("L1_ranking_per_user", _RECS + """ select user_id, k, round("precision", 6) "precision", round(recall, 6) recall, round(f1, 6) f1, round(ndcg, 6) ndcg, round(ap, 6) ap, round(rr, 6) rr, hit from m""")
def l1(spark, sf):
    return rounded(M.ranking_metrics(*_recs(spark, sf), [5, 10, 20]))


@register("L12_ranking_report", _RECS + """ select k, round(avg("precision"), 6) "precision", round(avg(recall), 6) recall, round(avg(f1), 6) f1, round(avg(ndcg), 6) ndcg, round(avg(ap), 6) map, round(avg(rr), 6) mrr, round(avg(hit), 6) hit_rate, count(*) users from m group by 1""")
def l12(spark, sf):
    return rounded(M.ranking_report(M.ranking_metrics(*_recs(spark, sf), [5, 10, 20])))


@register("L8_auc", """with s as (select toxic label, round((n_chars % 97) / 97.0::double, 3) score from documents join labels using (doc_id)),
r as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 rk from s)
select sum(label)::bigint positives, sum(1 - label)::bigint negatives, round((sum(rk) filter (where label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 6) auc from r""")
def l8(spark, sf):
    docs, labels = views.table(spark, sf, "documents"), views.table(spark, sf, "labels")
    scored = docs.join(labels, "doc_id").select(F.col("toxic").alias("label"), F.round((F.col("n_chars") % 97) / 97.0, 3).alias("score"))
    return rounded(M.auc(scored))


@register("L9_catalog_coverage", _RECS + """ select count(distinct item_id) recommended, (select count(distinct item_id) from interactions) catalog, round(count(distinct item_id) / (select count(distinct item_id) from interactions), 6) coverage from recs""")
def l9(spark, sf):
    recs, _ = _recs(spark, sf)
    catalog = views.interactions(spark, sf).agg(F.countDistinct("item_id").alias("catalog"))
    out = recs.agg(F.countDistinct("item_id").alias("recommended")).crossJoin(catalog)  # one row each
    return out.withColumn("coverage", r6(F.col("recommended") / F.col("catalog")))


@register("L10_intra_list_diversity", _RECS + """, t as (select user_id, item_id % 10 c, item_id % 7 b, rank from recs where rank <= 10)
select x.user_id, count(*) pairs, round(avg(1 - ((x.c = y.c)::int + (x.b = y.b)::int) / (4 - (x.c = y.c)::int - (x.b = y.b)::int)), 6) diversity from t x join t y on x.user_id = y.user_id and x.rank < y.rank group by 1""")
def l10(spark, sf):
    recs, _ = _recs(spark, sf)
    t = recs.filter("rank <= 10").select("user_id", "rank", (F.col("item_id") % 10).alias("c"), (F.col("item_id") % 7).alias("b"))
    x, y = t.toDF("user_id", "r1", "c1", "b1"), t.toDF("user_id", "r2", "c2", "b2")
    both = (F.col("c1") == F.col("c2")).cast("int") + (F.col("b1") == F.col("b2")).cast("int")
    pairs = x.join(y, "user_id").filter("r1 < r2").withColumn("d", 1 - both / (4 - both))
    return rounded(pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("pairs"), F.avg("d").alias("diversity")))


_RATES = "count(*) filter (where action = 'impression') impression, count(*) filter (where action = 'click') click, count(*) filter (where action = 'view') as view, count(*) filter (where action = 'add_cart') add_cart, count(*) filter (where action = 'purchase') purchase, count(*) events, count(distinct user_id) users"
_RATE_COLS = "round(click / greatest(impression, 1), 6) ctr, round(view / greatest(click, 1), 6) view_rate, round(add_cart / greatest(view, 1), 6) cart_rate, round(purchase / greatest(add_cart, 1), 6) purchase_rate, round(purchase / greatest(impression, 1), 6) end_to_end, round(events / greatest(users, 1), 6) actions_per_user"


@register("L13_online_engagement", SQL_INTERACTIONS + f", a as (select {_RATES} from interactions where ts >= {SQL_AS_OF} - interval 7 days) select *, {_RATE_COLS} from a")
def l13(spark, sf):
    return rounded(M.engagement_rates(views.interactions(spark, sf).filter(F.col("ts") >= O.since(AS_OF, 604_800))))


_BUCKET = "(('0x' || substr(md5(user_id::varchar), 1, 8))::bigint) % 2"


@register("L16_ab_groups", SQL_INTERACTIONS + f", a as (select {_BUCKET} grp, {_RATES} from interactions group by 1) select *, {_RATE_COLS} from a")
def l16(spark, sf):
    it = views.interactions(spark, sf).withColumn("grp", X.hash_bucket(F.col("user_id"), 2))
    return rounded(M.engagement_rates(it, ["grp"]))


@register("L17_wilson", SQL_INTERACTIONS + """, a as (select item_id, count(*) filter (where action = 'click') s, count(*) filter (where action in ('click', 'view')) n from interactions group by 1), p as (select *, case when n > 0 then s / n end p from a)
select item_id, s, n, round(case when n = 0 then 0 else greatest(0, ((p + 3.841458881296::double / (2 * n)) / (1 + 3.841458881296::double / n)) - 1.959964::double * sqrt(p * (1 - p) / n + 3.841458881296::double / (4 * n * n)) / (1 + 3.841458881296::double / n)) end, 6) low,
  round(case when n = 0 then 0 else least(1, ((p + 3.841458881296::double / (2 * n)) / (1 + 3.841458881296::double / n)) + 1.959964::double * sqrt(p * (1 - p) / n + 3.841458881296::double / (4 * n * n)) / (1 + 3.841458881296::double / n)) end, 6) high from p""")
def l17(spark, sf):
    a = views.interactions(spark, sf).groupBy("item_id").agg(O.n_action("click").alias("s"), count_if(F.col("action").isin("click", "view")).alias("n"))
    lo, hi = M.wilson(F.col("s"), F.col("n"))
    return a.select("item_id", "s", "n", r6(lo).alias("low"), r6(hi).alias("high"))


_CDF = "(1 - (t * (0.254829592::double + t * (-0.284496736::double + t * (1.421413741::double + t * (-1.453152027::double + t * 1.061405429::double))))) * exp(-abs(z) / sqrt(2.0::double) * abs(z) / sqrt(2.0::double)))"


@register("L18_z_test", SQL_INTERACTIONS + f""", g as (select {_BUCKET} grp, count(*) filter (where action = 'purchase')::double c, count(*)::double n from interactions group by 1),
a as (select max(c) filter (where grp = 0) c1, max(n) filter (where grp = 0) n1, max(c) filter (where grp = 1) c2, max(n) filter (where grp = 1) n2 from g),
b as (select *, c1 / n1 p1, c2 / n2 p2, sqrt((c1 + c2) / (n1 + n2) * (1 - (c1 + c2) / (n1 + n2)) * (1 / n1 + 1 / n2)) se from a), d as (select *, (p2 - p1) / se z from b), e as (select *, 1 / (1 + 0.3275911::double * abs(z) / sqrt(2.0::double)) t from d)
select round(z, 6) z, round(2 * (1 - 0.5::double * (1 + {_CDF})), 6) p_value, round((p2 - p1) / p1, 6) lift, round(p2 - p1 - 1.96::double * se, 6) ci_low, round(p2 - p1 + 1.96::double * se, 6) ci_high, round(2 * (asin(sqrt(p2)) - asin(sqrt(p1))), 6) effect from e""")
def l18(spark, sf):
    it = views.interactions(spark, sf).withColumn("grp", X.hash_bucket(F.col("user_id"), 2))
    of = lambda g, c: F.sum(F.when((F.col("grp") == g) & c, 1.0).otherwise(0.0))
    buy = F.col("action") == "purchase"
    a = it.agg(of(0, buy).alias("c1"), of(0, F.lit(True)).alias("n1"), of(1, buy).alias("c2"), of(1, F.lit(True)).alias("n2"))
    return rounded(a.select(*[v.alias(k) for k, v in M.z_test(*[F.col(c) for c in ("c1", "n1", "c2", "n2")]).items()]))


@register("L19_welch_test", SQL_INTERACTIONS + f""", g as (select {_BUCKET} grp, avg(price) m, var_pop(price) v, count(*)::double n from interactions where action = 'purchase' group by 1),
a as (select max(m) filter (where grp = 0) m1, max(v) filter (where grp = 0) v1, max(n) filter (where grp = 0) n1, max(m) filter (where grp = 1) m2, max(v) filter (where grp = 1) v2, max(n) filter (where grp = 1) n2 from g),
b as (select *, v1 / (n1 - 1) a, v2 / (n2 - 1) b from a), d as (select *, (m2 - m1) / sqrt(a + b) z from b), e as (select *, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)) df from d),
h as (select *, abs(z) / 2000 step, exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) c from e),
i as (select any_value(h) h, sum(case when k in (0, 2000) then 1 when k % 2 = 1 then 4 else 2 end * pow(1 + pow(k * step, 2) / df, -(df + 1) / 2)) * any_value(step) / 3 * any_value(c) half from h, range(2001) r(k)),
f as (select h.*, half from i)
select round(z, 5) t, round(df, 3) df, round(1 - 2 * half, 5) p_value, round((m2 - m1) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 5) cohens_d from f""")
def l19(spark, sf):
    it = views.interactions(spark, sf).filter("action = 'purchase'").withColumn("grp", X.hash_bucket(F.col("user_id"), 2))
    of = lambda f, g: f(F.when(F.col("grp") == g, F.col("price")))
    a = it.agg(*[f.alias(n) for g in (0, 1) for f, n in ((of(F.avg, g), f"m{g}"), (of(F.var_pop, g), f"v{g}"), (of(F.count, g).cast("double"), f"n{g}"))])
    w = M.welch(*[F.col(c) for c in ("m0", "v0", "n0", "m1", "v1", "n1")])
    return a.select(F.round(w["t"], 5).alias("t"), F.round(w["df"], 3).alias("df"), F.round(w["p_value"], 5).alias("p_value"), F.round(w["cohens_d"], 5).alias("cohens_d"))


@register("L22_funnel", SQL_INTERACTIONS + """, a as (select count(distinct user_id) filter (where action = 'impression') impression, count(distinct user_id) filter (where action = 'click') click, count(distinct user_id) filter (where action = 'view') as view,
  count(distinct user_id) filter (where action = 'add_cart') add_cart, count(distinct user_id) filter (where action = 'purchase') purchase from interactions),
s as (select unnest([struct_pack(d := 1 - click / impression, s := 'impression->click'), struct_pack(d := 1 - view / click, s := 'click->view'), struct_pack(d := 1 - add_cart / view, s := 'view->add_cart'), struct_pack(d := 1 - purchase / add_cart, s := 'add_cart->purchase')]) x from a)
select a.*, round(click / impression, 6) rate_click, round(view / click, 6) rate_view, round(add_cart / view, 6) rate_add_cart, round(purchase / add_cart, 6) rate_purchase, (select max(x).s from s) bottleneck, round((select max(x).d from s), 6) drop_off from a""")
def l22(spark, sf):
    return rounded(M.funnel(views.interactions(spark, sf)))


@register("L23_diversity", SQL_INTERACTIONS + """, c as (select item_id, count(*) n from interactions group by 1), x as (select n, n / sum(n) over () p, row_number() over (order by n, item_id) i from c)
select count(*) "values", round(1 - sum(p * p), 6) simpson, round(-sum(p * ln(p)), 6) shannon, round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) gini from x""")
def l23(spark, sf):
    counts = views.interactions(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return rounded(M.diversity(counts))


@register("L25_arm_statistics", SQL_INTERACTIONS + """, a as (select platform arm, count(*) tries, count(*) filter (where action = 'click') clicks from interactions group by 1)
select arm, tries, clicks, round(clicks / tries, 6) ctr, round(clicks / tries + sqrt(2 * ln(sum(tries) over ()) / tries), 6) ucb from a""")
def l25(spark, sf):
    a = views.interactions(spark, sf).groupBy(F.col("platform").alias("arm")).agg(F.count(F.lit(1)).alias("tries"), O.n_action("click").alias("clicks"))
    total = F.sum("tries").over(W.partitionBy())
    ctr = F.col("clicks") / F.col("tries")
    return a.select("arm", "tries", "clicks", r6(ctr).alias("ctr"), r6(ctr + F.sqrt(2 * F.log(total) / F.col("tries"))).alias("ucb"))


@register("L26_request_performance", """with r as (select value latency, event_type = 'error' failed, ts from events)
select count(*) requests, round(avg(latency), 6) mean, round(quantile_cont(latency, 0.5), 6) p50, round(quantile_cont(latency, 0.95), 6) p95, round(quantile_cont(latency, 0.99), 6) p99, max(latency) as max, round(stddev_pop(latency), 6) std,
  round(avg((not failed)::int), 6) success_rate, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) per_second,
  case when quantile_cont(latency, 0.95) < 100 then 'A' when quantile_cont(latency, 0.95) < 300 then 'B' when quantile_cont(latency, 0.95) < 500 then 'C' else 'D' end grade from r""")
def l26(spark, sf):
    r = views.table(spark, sf, "events").select(F.col("value").alias("x"), (F.col("event_type") == "error").alias("failed"), F.col("ts").cast("timestamp").alias("ts"))
    a = r.agg(
        F.count(F.lit(1)).alias("requests"), F.avg("x").alias("mean"), F.max("x").alias("max"), F.stddev_pop("x").alias("std"),
        F.avg((~F.col("failed")).cast("int")).alias("success_rate"), ((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6).alias("span"),
    )
    a = with_quantiles(a, r, F.col("x"), (0.5, 0.95, 0.99), "p")
    p = [F.get("p", F.lit(i)) for i in range(3)]
    grade = F.when(p[1] < 100, "A").when(p[1] < 300, "B").when(p[1] < 500, "C").otherwise("D")
    return rounded(a.select("requests", "mean", p[0].alias("p50"), p[1].alias("p95"), p[2].alias("p99"), "max", "std", "success_rate", (F.col("requests") / F.col("span")).alias("per_second"), grade.alias("grade")))


@register("D17_deep_ratios", SQL_INTERACTIONS + """, a as (select count(*) n, count(*) filter (where action = 'view') v, count(*) filter (where action = 'click') c, count(*) filter (where action = 'add_cart') k, count(*) filter (where action = 'purchase') p from interactions)
select n, round(c / v, 6) click_to_view, round(k / c, 6) cart_to_click, round(p / k, 6) purchase_to_cart, round(0.15::double * k / v + 0.1::double * p / v, 6) satisfaction, case when 0.2::double * k / v + 0.1::double * p / v > 0.15 then 'EXCELLENT' when 0.2::double * k / v + 0.1::double * p / v > 0.08 then 'GOOD' when 0.2::double * k / v + 0.1::double * p / v > 0.04 then 'AVERAGE' else 'POOR' end quality from a""")
def d17(spark, sf):
    a = views.interactions(spark, sf).agg(F.count(F.lit(1)).alias("n"), *[O.n_action(x).alias(y) for x, y in (("view", "v"), ("click", "c"), ("add_cart", "k"), ("purchase", "p"), ("like", "l"), ("favorite", "f"), ("share", "s"))])
    c = F.col
    rate = {x: sd(c(x), c("v")) for x in "lfskp"}
    quality = 0.3 * rate["l"] + 0.25 * rate["f"] + 0.2 * rate["k"] + 0.15 * rate["s"] + 0.1 * rate["p"]
    satisfaction = 0.3 * rate["l"] + 0.25 * rate["f"] + 0.2 * rate["s"] + 0.15 * rate["k"] + 0.1 * rate["p"]
    grade = F.when(quality > 0.15, "EXCELLENT").when(quality > 0.08, "GOOD").when(quality > 0.04, "AVERAGE").otherwise("POOR")
    return a.select("n", r6(sd(c("c"), c("v"))).alias("click_to_view"), r6(sd(c("k"), c("c"))).alias("cart_to_click"), r6(sd(c("p"), c("k"))).alias("purchase_to_cart"), r6(satisfaction).alias("satisfaction"), grade.alias("quality"))


_CLV = SQL_PURCHASES + """, u as (select customer_id, count(distinct order_id) n, sum(amount) spent, greatest(1, date_diff('day', min(ts)::date, max(ts)::date)) as n_days from purchases group by 1),
c as (select customer_id, n / greatest(n_days / 30, 1) freq, spent / greatest(n, 1) aov, least(n_days / 30 * 2, 24) life from u), v as (select *, aov * freq * life clv from c)"""


@register("D20_lifetime_value", _CLV + """ select count(*) customers, round(avg(clv), 2) mean, round(quantile_cont(clv, 0.25), 2) p25, round(quantile_cont(clv, 0.5), 2) median, round(quantile_cont(clv, 0.75), 2) p75, round(quantile_cont(clv, 0.9), 2) p90 from v""")
def d20(spark, sf):
    u = views.purchases(spark, sf).groupBy("customer_id").agg(F.countDistinct("order_id").alias("n"), F.sum("amount").alias("spent"), F.greatest(F.lit(1), F.datediff(F.max("ts"), F.min("ts"))).alias("days"))
    clv = (F.col("spent") / F.greatest("n", F.lit(1))) * (F.col("n") / F.greatest(F.col("days") / 30, F.lit(1.0))) * F.least(F.col("days") / 30 * 2, F.lit(24.0))
    u = u.withColumn("clv", clv)
    q = with_quantiles(u.agg(F.count(F.lit(1)).alias("customers"), F.avg("clv").alias("mean")), u, F.col("clv"), (0.25, 0.5, 0.75, 0.9), "p")
    return rounded(q.select("customers", "mean", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("p25", "median", "p75", "p90"))]), 2)


@register("D21_revenue", SQL_PURCHASES + """, t as (select order_id, sum(amount) a from purchases group by 1), q as (select quantile_cont(a, 0.8) p80 from t)
select count(*) orders, round(sum(a), 2) revenue, round(avg(a), 2) aov, round(any_value(p80), 2) p80, round(sum(a) filter (where a >= p80) / sum(a), 6) high_value_share, round((sum(a) - 0.001::double * 1000000) / greatest(0.001::double * 1000000, 1) * 100, 2) roi from t, q""")
def d21(spark, sf):
    t = views.purchases(spark, sf).groupBy("order_id").agg(F.sum("amount").alias("a"))
    q = quantiles(t, F.col("a"), (0.8,)).select(F.get("q", F.lit(0)).alias("p80"))
    out = t.crossJoin(F.broadcast(q)).agg(  # one row broadcast
        F.count(F.lit(1)).alias("orders"), F.sum("a").alias("revenue"), F.avg("a").alias("aov"), F.max("p80").alias("p80"), (F.sum(F.when(F.col("a") >= F.col("p80"), F.col("a"))) / F.sum("a")).alias("high_value_share"),
    )
    cost = 0.001 * 1_000_000
    return out.select("orders", F.round("revenue", 2).alias("revenue"), F.round("aov", 2).alias("aov"), F.round("p80", 2).alias("p80"), r6("high_value_share").alias("high_value_share"), F.round((F.col("revenue") - cost) / max(cost, 1) * 100, 2).alias("roi"))


@register("D22_business_metrics", SQL_INTERACTIONS + """, b as (select user_id, count(distinct ts::date) n_days, sum(price) spent, count(*) n from interactions where action = 'purchase' group by 1)
select round((select sum(spent) from b) / count(*) filter (where action = 'impression'), 6) gmv_per_impression, round((select sum(spent) from b) / count(distinct user_id), 6) arpu, round((select sum(spent) from b) / (select count(*) from b), 6) arppu,
  round((select count(*) filter (where n_days >= 2) / count(*) from b), 6) repeat_rate, round((select sum(spent) / sum(n) from b), 6) aov from interactions""")
def d22(spark, sf):
    by = views.interactions(spark, sf).groupBy("user_id").agg(
        O.n_action("impression").alias("impressions"), F.countDistinct(F.when(F.col("action") == "purchase", F.to_date("ts"))).alias("days"), O.n_action("purchase").alias("n"), F.coalesce(F.sum(F.when(F.col("action") == "purchase", F.col("price"))), F.lit(0.0)).alias("spent"),
    )
    buyers = count_if(F.col("n") > 0)
    return rounded(by.agg(
        (F.sum("spent") / F.sum("impressions")).alias("gmv_per_impression"), (F.sum("spent") / F.count(F.lit(1))).alias("arpu"), (F.sum("spent") / buyers).alias("arppu"),
        (count_if(F.col("days") >= 2) / buyers).alias("repeat_rate"), (F.sum("spent") / F.sum("n")).alias("aov"),
    ))


@register("D24_category_trends", SQL_INTERACTIONS + """ select epoch_us(date_trunc('hour', ts)) // 1000000 hour_s, category_id, count(distinct user_id) users, count(distinct item_id) items, count(*) n, round(avg(price), 6) avg_price, round(stddev_samp(price), 6) std_price, round(quantile_cont(price, 0.5), 6) median_price from interactions group by 1, 2""")
def d24(spark, sf):
    out = views.interactions(spark, sf).groupBy(F.window("ts", "1 hour"), "category_id").agg(
        F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"), F.count(F.lit(1)).alias("n"), F.avg("price").alias("avg_price"), F.stddev_samp("price").alias("std_price"), F.percentile("price", F.lit(0.5)).alias("median_price"),
    )
    return rounded(out.select(F.unix_seconds("window.start").alias("hour_s"), "category_id", "users", "items", "n", "avg_price", "std_price", "median_price"))


@register("D25_feature_statistics", SQL_INTERACTIONS + f""", f as (select user_id, count(*) n, sum({_weight('profile')}) w from interactions group by 1)
select 'n' feature, count(n) count, round(avg(n), 6) mean, round(stddev_samp(n), 6) std, min(n)::double as min, max(n)::double as max from f union all select 'w', count(w), round(avg(w), 6), round(stddev_samp(w), 6), min(w), max(w) from f""")
def d25(spark, sf):
    f = views.interactions(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(X.action_weight(F.col("action"), "profile")).alias("w"))
    long = f.unpivot("user_id", ["n", "w"], "feature", "value")
    return rounded(long.groupBy("feature").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")))


@register("D27_category_ctr", SQL_INTERACTIONS + f" select category_id, {_n('view')} as views, {_n('click')} clicks, round({_n('click')} / greatest({_n('view')}, 1), 6) ctr from interactions group by 1")
def d27(spark, sf):
    a = views.interactions(spark, sf).groupBy("category_id").agg(O.n_action("view").alias("views"), O.n_action("click").alias("clicks"))
    return a.withColumn("ctr", r6(X.m1(F.col("clicks"), F.col("views"))))


@register("P1_profile", """with l as (select 'value' "column", value x from events union all select 'n_chars', n_chars::double from documents),
s as (select "column", count(x) n, count(*) filter (where x is null) nulls, avg(x) mean, stddev_samp(x) std, min(x) as min, quantile_cont(x, 0.25) q25, quantile_cont(x, 0.5) median, quantile_cont(x, 0.75) q75, max(x) as max, skewness(x) skewness, kurtosis(x) kurtosis from l group by 1),
o as (select l."column", count(*) filter (where x < q25 - 1.5 * (q75 - q25) or x > q75 + 1.5 * (q75 - q25)) outliers from l join s using ("column") group by 1)
select "column", n, nulls, round(mean, 4) mean, round(std, 4) std, round(min, 4) as min, round(q25, 4) q25, round(median, 4) median, round(q75, 4) q75, round(max, 4) as max, round(skewness, 4) skewness, round(kurtosis, 4) kurtosis, outliers from s join o using ("column")""")
def p1(spark, sf):
    a = views.table(spark, sf, "events").select(F.col("value"), F.lit(None).cast("double").alias("n_chars"))
    one = M.profile(a.select("value"), ["value"])
    two = M.profile(views.table(spark, sf, "documents").select("n_chars"), ["n_chars"])
    return rounded(one.unionByName(two), 4)


@register("P2_correlations", """with a as (select corr(l_quantity, l_extendedprice) qp, corr(l_quantity, l_discount) qd, corr(l_extendedprice, l_discount) pd from lineitem), l as (select unnest([struct_pack(p := 'l_quantity:l_extendedprice', r := qp), struct_pack(p := 'l_quantity:l_discount', r := qd), struct_pack(p := 'l_extendedprice:l_discount', r := pd)]) x from a)
select x.p pair, round(x.r, 6) r, case when abs(x.r) > 0.7 then 'strong' when abs(x.r) > 0.3 then 'moderate' else 'weak' end strength from l""")
def p2(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = views.table(spark, sf, "lineitem").agg(*[F.corr(a, b).alias(f"{a}:{b}") for a, b in pairs])
    long = one.select(F.expr("stack(3, " + ", ".join(f"'{a}:{b}', `{a}:{b}`" for a, b in pairs) + ") as (pair, r)"))
    return long.select("pair", r6("r").alias("r"), F.when(F.abs("r") > 0.7, "strong").when(F.abs("r") > 0.3, "moderate").otherwise("weak").alias("strength"))


@register("P7_histogram", """with b as (select min(value) lo, max(value) hi from events) select least(30, floor((value - lo) / (hi - lo) * 30)::bigint + 1)::bigint bin, count(*) n from events, b group by 1""")
def p7(spark, sf):
    e = views.table(spark, sf, "events")
    b = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    bin_ = F.least(F.lit(30), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 30) + 1).cast("long")
    return e.crossJoin(F.broadcast(b)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row broadcast


@register("P5_inactivity", SQL_INTERACTIONS + f""", u as (select user_id, date_diff('day', max(ts)::date, date '2024-01-31') d from interactions group by 1)
select case when d <= 7 then 'active' when d <= 30 then 'cooling' when d <= 90 then 'dormant' else 'lost' end segment, count(*) users from u group by 1""")
def p5(spark, sf):
    d = F.datediff(F.lit(AS_OF.date()), F.max("ts"))
    u = views.interactions(spark, sf).groupBy("user_id").agg(d.alias("d"))
    seg = F.when(F.col("d") <= 7, "active").when(F.col("d") <= 30, "cooling").when(F.col("d") <= 90, "dormant").otherwise("lost")
    return u.groupBy(seg.alias("segment")).agg(F.count(F.lit(1)).alias("users"))
