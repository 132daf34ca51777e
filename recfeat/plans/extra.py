"""Registered queries: channel mixes, item features, tag vectors, satisfaction, decisions and insights."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recfeat import views
from recfeat.functions import exprs as X
from recfeat.functions.exprs import count_if, r6, sd
from recfeat.functions.sized import small
from recfeat.operators import features as O
from recfeat.operators import ranking as K
from recfeat.operators import recall as R
from recfeat.operators import tags as T
from recfeat.operators import text as M
from recfeat.plans.catalog import register
from recfeat.plans.features import _DWELL, _n, _weight, rounded
from recfeat.plans.metrics import _BUCKET, _RECS, _recs
from recfeat.plans.profiles import _INTEREST, _ITEM_TAGS, _SENT, _USER_TAGS, _item_tags
from recfeat.plans.recall import _HOT
from recfeat.views import AS_OF, SQL_AS_OF, SQL_INTERACTIONS


@register("B10_enriched_events", SQL_INTERACTIONS + f""" select event_id, '{{"user":' || user_id || ',"hour":' || hour(ts) || ',"dow":' || (isodow(ts) - 1) || ',"weekend":' || (isodow(ts) >= 6)::varchar || '}}' payload, {_weight('stream')} weight from interactions""")
def b10(spark, sf):
    it = views.interactions(spark, sf)
    doc = F.to_json(F.struct(F.col("user_id").alias("user"), F.hour("ts").alias("hour"), F.weekday("ts").alias("dow"), (F.weekday("ts") >= 5).alias("weekend")))
    return it.select("event_id", doc.alias("payload"), X.action_weight(F.col("action"), "stream").alias("weight"))


@register("B15_lookup_encoding", "select o_orderkey order_id, case o_orderstatus when 'F' then 1.0 when 'O' then 0.5 else 0.2 end::double score from orders")
def b15(spark, sf):
    table = F.create_map(F.lit("F"), F.lit(1.0), F.lit("O"), F.lit(0.5))
    return views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.coalesce(F.try_element_at(table, F.col("o_orderstatus")), F.lit(0.2)).alias("score"))


@register("C2_left_enrichment", SQL_INTERACTIONS + f", r as (select item_id, count(*) recent from interactions where ts >= {SQL_AS_OF} - interval 2 days group by 1), a as (select item_id, count(*) total from interactions group by 1) select item_id, total, coalesce(recent, 0) recent from a left join r using (item_id)")
def c2(spark, sf):
    it = views.interactions(spark, sf)
    a = it.groupBy("item_id").agg(F.count(F.lit(1)).alias("total"))
    r = it.filter(F.col("ts") >= O.since(AS_OF, 172_800)).groupBy("item_id").agg(F.count(F.lit(1)).alias("recent"))
    return a.join(r, "item_id", "left").select("item_id", "total", F.coalesce("recent", F.lit(0)).cast("long").alias("recent"))


@register("C12_candidate_features", _RECS + ", u as (select user_id, count(*) un from interactions group by 1), i as (select item_id, count(*) inn from interactions group by 1), p as (select user_id, item_id, count(*) pn from interactions group by 1, 2) select r.user_id, r.item_id, un user_n, inn item_n, pn pair_n from recs r join u on r.user_id = u.user_id join i on r.item_id = i.item_id join p on r.user_id = p.user_id and r.item_id = p.item_id where rank <= 5")
def c12(spark, sf):
    recs, _ = _recs(spark, sf)
    it = views.interactions(spark, sf)
    n = lambda keys, name: it.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    out = recs.filter("rank <= 5").select("user_id", "item_id")
    return out.join(n(["user_id"], "user_n"), "user_id", "left").join(n(["item_id"], "item_n"), "item_id", "left").join(n(["user_id", "item_id"], "pair_n"), ["user_id", "item_id"], "left")


@register("E7_top_items_per_category", SQL_INTERACTIONS + ", c as (select category_id, item_id, count(*) n from interactions group by 1, 2) select *, row_number() over (partition by category_id order by n desc, item_id) rank from c qualify row_number() over (partition by category_id order by n desc, item_id) <= 3")
def e7(spark, sf):
    c = views.interactions(spark, sf).groupBy("category_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    return R.top_k(c, 3, "n", "item_id", ["category_id"])


@register("E11_drop_scan", SQL_INTERACTIONS + ", d as (select epoch_us(date_trunc('day', ts)) // 1000000 day_s, count(*) n from interactions group by 1), l as (select *, lag(n) over (order by day_s) p from d) select day_s, n, p - n as fall from l where n < p * 0.95::double")
def e11(spark, sf):
    d = views.interactions(spark, sf).groupBy(F.unix_seconds(F.date_trunc("day", "ts")).alias("day_s")).agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("n").over(W.orderBy("day_s"))  # one row a day
    return d.withColumn("p", before).filter(F.col("n") < F.col("p") * 0.95).select("day_s", "n", (F.col("p") - F.col("n")).alias("fall"))


@register("G1_channel_union", _HOT + ", n as (select user_id, item_id, count(*)::double score from interactions where action = 'click' group by 1, 2), t as (select * from h order by score desc, item_id limit 5), u as (select distinct user_id from interactions) select user_id, item_id, score, 'click' source from n union all select user_id, item_id, score, 'hot' from u, t")
def g1(spark, sf):
    it = views.interactions(spark, sf)
    clicks = it.filter("action = 'click'").groupBy("user_id", "item_id").agg(F.count(F.lit(1)).cast("double").alias("score")).withColumn("source", F.lit("click"))
    hot = it.select("user_id").distinct().crossJoin(F.broadcast(R.hot_items(it, 5))).select("user_id", "item_id", "score", F.lit("hot").alias("source"))  # five rows broadcast
    return clicks.unionByName(hot)


@register("H4_null_safe_ratios", SQL_INTERACTIONS + f" select item_id, round(case when {_n('favorite')} = 0 then 0 else {_n('click')} / {_n('favorite')} end, 6) safe, round({_n('click')} / greatest({_n('favorite')}, 1), 6) floored, round({_n('click')} / ({_n('favorite')} + 1), 6) smoothed, {_n('click')} / nullif({_n('favorite')}, 0) raw from interactions group by 1")
def h4(spark, sf):
    a = views.interactions(spark, sf).groupBy("item_id").agg(O.n_action("click").alias("c"), O.n_action("favorite").alias("f"))
    c, f = F.col("c"), F.col("f")
    return a.select("item_id", r6(sd(c, f)).alias("safe"), r6(X.m1(c, f)).alias("floored"), r6(X.p1(c, f)).alias("smoothed"), F.try_divide(c, f).alias("raw"))


@register("H9_hash_groups", f"select {_BUCKET} grp, count(distinct user_id) users from events group by 1")
def h9(spark, sf):
    return views.table(spark, sf, "events").groupBy(X.hash_bucket(F.col("user_id"), 2).alias("grp")).agg(F.countDistinct("user_id").alias("users"))


@register("K4_tag_pairs_capped", _ITEM_TAGS + ", p as (select a.item_id, a.tag || '+' || b.tag pair, row_number() over (partition by a.item_id order by a.tag, b.tag) rn from item_tags a join item_tags b on a.item_id = b.item_id and a.tag < b.tag) select item_id, pair from p where rn <= 10")
def k4(spark, sf):
    t = _item_tags(spark, sf)
    p = t.select("item_id", F.col("tag").alias("a")).join(t.select("item_id", F.col("tag").alias("b")), "item_id").filter("a < b")
    rn = F.row_number().over(W.partitionBy("item_id").orderBy("a", "b"))
    return p.withColumn("rn", rn).filter("rn <= 10").select("item_id", F.concat_ws("+", "a", "b").alias("pair"))


@register("K6_tag_vector", _ITEM_TAGS + ", b as (select item_id, (('0x' || substr(md5(tag), 1, 8))::bigint) % 16 k, count(*)::double w from item_tags group by 1, 2), n as (select item_id, sqrt(sum(w * w)) n from b group by 1) select item_id, k bucket, round(w / n, 6) weight from b join n using (item_id)")
def k6(spark, sf):
    b = _item_tags(spark, sf).groupBy("item_id", X.hash_bucket(F.col("tag"), 16).alias("bucket")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    n = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("item_id")))
    return b.select("item_id", "bucket", r6(F.col("w") / n).alias("weight"))


@register("K11_segments", _USER_TAGS + ", c as (select user_id, count(*) filter (where tag = 'steel') steel, count(*) filter (where tag = 'dear') dear, count(*) filter (where tag = 'brass') brass from interactions join item_tags using (item_id) group by 1) select user_id from c where steel >= 8 and (dear >= 10 or brass >= 8)")
def k11(spark, sf):
    tagged = views.interactions(spark, sf).join(_item_tags(spark, sf).select("item_id", "tag"), "item_id")
    c = tagged.groupBy("user_id").pivot("tag", ["steel", "dear", "brass"]).agg(F.count(F.lit(1))).na.fill(0)
    return c.filter((F.col("steel") >= 8) & ((F.col("dear") >= 10) | (F.col("brass") >= 8))).select("user_id")


@register("K21_root_interest", _INTEREST + ", x as (select user_id, coalesce(d.parent, r.tag) root, interest from r left join dict d using (tag)) select user_id, root, round(sum(interest), 3) interest from x group by 1, 2")
def k21(spark, sf):
    interest = T.decayed_interest(views.interactions(spark, sf), _item_tags(spark, sf), AS_OF)
    tree = T.closure(T.dictionary(spark)).groupBy("tag").agg(F.max_by("ancestor", "distance").alias("top"))
    x = interest.join(small(tree), "tag", "left").withColumn("root", F.coalesce("top", "tag"))
    return x.groupBy("user_id", "root").agg(F.round(F.sum("interest"), 3).alias("interest"))


@register("K22_related_tags", _INTEREST + ", s as (select r.user_id, b.tag, sum(r.interest) * 0.1::double score from r join dict a on r.tag = a.tag join dict b on a.dimension = b.dimension and a.tag <> b.tag group by 1, 2) select s.user_id, s.tag, round(s.score, 3) score from s where not exists (select 1 from r where r.user_id = s.user_id and r.tag = s.tag)")
def k22(spark, sf):
    interest = T.decayed_interest(views.interactions(spark, sf), _item_tags(spark, sf), AS_OF)
    d = T.dictionary(spark).select("tag", "dimension")
    near = d.join(d.select(F.col("tag").alias("other"), "dimension"), "dimension").filter("tag <> other").select("tag", "other")
    s = interest.join(small(near), "tag").groupBy("user_id", F.col("other").alias("tag")).agg(F.round(F.sum("interest") * 0.1, 3).alias("score"))
    return s.join(interest, ["user_id", "tag"], "left_anti")


@register("L15_list_diversity", _RECS + " select user_id, round(count(distinct item_id % 10) / count(*), 6) diversity from recs group by 1")
def l15(spark, sf):
    recs, _ = _recs(spark, sf)
    return recs.groupBy("user_id").agg(r6(F.countDistinct(F.col("item_id") % 10) / F.count(F.lit(1))).alias("diversity"))


@register("L20_decision", SQL_INTERACTIONS + f", g as (select {_BUCKET} grp, avg((action = 'purchase')::int) r, avg((action = 'click')::int) c from interactions group by 1), d as (select (max(r) filter (where grp = 1) > max(r) filter (where grp = 0))::int + (max(c) filter (where grp = 1) > max(c) filter (where grp = 0))::int k from g) select k::bigint better, case when k >= 2 then 'LAUNCH' when k = 1 then 'ITERATE' else 'ABANDON' end decision from d")
def l20(spark, sf):
    it = views.interactions(spark, sf).withColumn("grp", X.hash_bucket(F.col("user_id"), 2))
    rate = lambda a, g: F.avg(F.when(F.col("grp") == g, (F.col("action") == a).cast("int")))
    better = sum(((rate(a, 1) > rate(a, 0)).cast("long") for a in ("purchase", "click")), F.lit(0).cast("long"))
    out = it.agg(better.alias("better"))
    return out.withColumn("decision", F.when(F.col("better") >= 2, "LAUNCH").when(F.col("better") == 1, "ITERATE").otherwise("ABANDON"))


@register("L21_ctr_report", SQL_INTERACTIONS + f", a as (select category_id, {_n('click')} / greatest({_n('impression')}, 1) ctr from interactions group by 1) select category_id, round(ctr, 6) ctr, case when ctr > 0.1 then 'EXCELLENT' when ctr > 0.05 then 'GOOD' when ctr > 0.02 then 'AVERAGE' else 'POOR' end grade, round(ctr / 0.05::double - 1, 6) against_benchmark from a")
def l21(spark, sf):
    a = views.interactions(spark, sf).groupBy("category_id").agg(X.m1(O.n_action("click"), O.n_action("impression")).alias("ctr"))
    grade = F.when(F.col("ctr") > 0.1, "EXCELLENT").when(F.col("ctr") > 0.05, "GOOD").when(F.col("ctr") > 0.02, "AVERAGE").otherwise("POOR")
    return a.select("category_id", r6("ctr").alias("ctr"), grade.alias("grade"), r6(F.col("ctr") / 0.05 - 1).alias("against_benchmark"))


@register("M7_behavioural_satisfaction", _DWELL + " select user_id, round(10 * (0.4::double * least(avg(d) / 60, 1) + 0.6::double * avg(least(d / 600, 1))), 6) satisfaction from g where d is not null group by 1")
def m7(spark, sf):
    g = O.gaps(views.interactions(spark, sf)).filter("dwell is not null")
    one = F.lit(1.0)
    return g.groupBy("user_id").agg(r6(10 * (0.4 * F.least(F.avg("dwell") / 60, one) + 0.6 * F.avg(F.least(F.col("dwell") / 600, one)))).alias("satisfaction"))


@register("M14_insights", SQL_INTERACTIONS + f", m as (select {_n('click')} / greatest({_n('view')}, 1) ctr, {_n('purchase')} / greatest({_n('click')}, 1) cvr from interactions), l as (select 'ctr' metric, ctr v from m union all select 'cvr', cvr from m), r as (select * from (values ('ctr', 0.2, 'LOW_CLICKS'), ('ctr', 2.0, 'CLICKS_BELOW_TARGET'), ('cvr', 0.3, 'LOW_CONVERSION')) t(metric, lim, code)) select code insight_code, metric, round(v, 6) as value from l join r using (metric) where v < lim")
def m14(spark, sf):
    m = views.interactions(spark, sf).agg(X.m1(O.n_action("click"), O.n_action("view")).alias("ctr"), X.m1(O.n_action("purchase"), O.n_action("click")).alias("cvr"))
    rules = F.broadcast(spark.createDataFrame([("ctr", 0.2, "LOW_CLICKS"), ("ctr", 2.0, "CLICKS_BELOW_TARGET"), ("cvr", 0.3, "LOW_CONVERSION")], "metric string, lim double, insight_code string"))
    return m.unpivot([], ["ctr", "cvr"], "metric", "value").join(rules, "metric").filter("value < lim").select("insight_code", "metric", r6("value").alias("value"))


@register("P4_missing_values", "select 'lang' column_name, count(*) filter (where lang is null) missing, count(*) n from documents union all select 'source', count(*) filter (where source is null), count(*) from documents union all select 'text', count(*) filter (where text is null), count(*) from documents")
def p4(spark, sf):
    d = views.table(spark, sf, "documents")
    a = d.agg(*[count_if(F.col(c).isNull()).alias(c) for c in ("lang", "source", "text")], F.count(F.lit(1)).alias("n"))
    return a.unpivot(["n"], ["lang", "source", "text"], "column_name", "missing")


@register("R9_item_cf_top", SQL_INTERACTIONS + f""", m as (select user_id, item_id, sum({_weight('profile')}) score from interactions group by 1, 2), q as (select item_id, sum(score * score) q from m group by 1),
s as (select a.item_id i, b.item_id j, round(sum(a.score * b.score) / sqrt(any_value(n1.q) * any_value(n2.q)), 6) sim from m a join m b on a.user_id = b.user_id and a.item_id < b.item_id join q n1 on n1.item_id = a.item_id join q n2 on n2.item_id = b.item_id group by 1, 2 having count(*) >= 5),
e as (select i item, j other, sim from s union all select j, i, sim from s) select item, other, sim similarity, row_number() over (partition by item order by sim desc, other) rank from e qualify row_number() over (partition by item order by sim desc, other) <= 10""")
def r9(spark, sf):
    s = O.item_similarity(O.user_item_matrix(views.interactions(spark, sf), AS_OF), full_norms=True)
    e = s.select(F.col("item1").alias("item"), F.col("item2").alias("other"), "similarity").union(s.select("item2", "item1", "similarity"))
    return R.top_k(e, 10, "similarity", "other", ["item"])
