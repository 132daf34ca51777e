"""Registered queries: keyword tags, tag relations, boosted interests, feedback by rating and hour."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recfeat import views
from recfeat.functions import exprs as X
from recfeat.functions.exprs import count_if, r6, sd
from recfeat.operators import tags as T
from recfeat.operators import text as M
from recfeat.plans.catalog import register
from recfeat.plans.features import _n, _weight
from recfeat.plans.profiles import _INTEREST, _ITEM_TAGS, _SENT, _USER_TAGS, _item_tags
from recfeat.views import AS_OF, SQL_AS_OF, SQL_INTERACTIONS

# Fixed templates of keyword tags: tag, whether it belongs to the item's own kind.
TEMPLATES = [("anodized_steel", True), ("polished_brass", True), ("brushed_copper", True), ("economy", False), ("promo", False), ("standard", False)]
# Fixed dependencies: a tag and the tag that it needs.
REQUIRES = [("coated", "metal"), ("polished", "metal"), ("brushed", "metal"), ("plated", "metal")]

_CLOSURE = """, tree as (
  with recursive up(tag, ancestor) as (
    select tag, parent from dict where parent is not null union select up.tag, d.parent from up join dict d on d.tag = up.ancestor where d.parent is not null)
  select tag, ancestor from up)"""


@register("K2_keyword_tags", "with t(tag, own) as (values " + ", ".join(f"('{t}', {str(o).lower()})" for t, o in TEMPLATES) + """),
i as (select p_partkey item_id, lower(p_name || ' ' || p_type) words, p_retailprice price from part)
select item_id, tag, case when own then 0.8::double else 0.6::double end confidence, 'keyword' source from i join t on contains(words, replace(tag, '_', ' ')) or contains(words, tag)
union all select item_id, unnest(case when price > 1500 then ['premium', 'high_end'] when price > 500 then ['mid_range'] else ['budget'] end), 0.9::double, 'rule' from i
union all select item_id, 'professional', 0.95::double, 'rule' from i where contains(words, 'anodized')""")
def k2(spark, sf):
    return T.keyword_tags(views.items(spark, sf), spark.createDataFrame(TEMPLATES, "tag string, own boolean"))


@register("K10_implied_tags", _ITEM_TAGS + _CLOSURE + " select distinct item_id, ancestor tag from item_tags join tree using (tag) where (item_id, ancestor) not in (select (item_id, tag) from item_tags)")
def k10_implied(spark, sf):
    return T.implied_tags(_item_tags(spark, sf), T.closure(T.dictionary(spark)))


@register("K10_missing_dependencies", _ITEM_TAGS + _CLOSURE + ", needs(tag, needs) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in REQUIRES) + """),
held as (select item_id, tag from item_tags union select item_id, ancestor from item_tags join tree using (tag))
select item_id, tag, needs from item_tags join needs using (tag) where (item_id, needs) not in (select (item_id, tag) from held)""")
def k10_missing(spark, sf):
    return T.missing_dependencies(_item_tags(spark, sf), T.closure(T.dictionary(spark)), spark.createDataFrame(REQUIRES, "tag string, needs string"))


@register("K18_interest_with_parents", _INTEREST + """, up as (select user_id, tag, interest from r union all select user_id, d.parent, interest * 0.5::double from r join dict d using (tag) where d.parent is not null),
p as (select user_id, tag, round(sum(interest), 3) interest from up group by 1, 2),
rel as (select a.tag, b.tag other from dict a join dict b on a.parent = b.parent and a.tag <> b.tag union select parent, tag from dict where parent is not null),
more as (select user_id, other tag, sum(0.02::double * interest) more from r join rel using (tag) group by 1, 2)
select user_id, tag, round(p.interest + coalesce(more, 0), 3) interest from p left join more using (user_id, tag)""")
def k18(spark, sf):
    interest = T.decayed_interest(views.interactions(spark, sf), _item_tags(spark, sf), AS_OF)
    tags = T.dictionary(spark)
    return T.with_related(interest, T.with_ancestors(interest, T.closure(tags)), T.related(tags))


@register("K20_top_interests", _INTEREST + f""", c as (
  select user_id, tag, max(ts) >= {SQL_AS_OF} - interval 2 days recent, max({_weight('tag')}) / 10 engagement, count(distinct category_id) categories, {_n('purchase')} purchases
  from interactions join item_tags using (item_id) group by 1, 2),
b as (select user_id, tag, round(interest * (case when recent then 1.5 else 1 end::double * case when engagement > 0.8 then 1.3 else 1 end::double * case when categories > 1 then 1.2 else 1 end::double
    * (1 + least(0.1::double * purchases, 0.5::double))), 6) score from r join c using (user_id, tag))
select user_id, tag, score, row_number() over (partition by user_id order by score desc, tag) rank from b where score >= 0.01 qualify row_number() over (partition by user_id order by score desc, tag) <= 20""")
def k20(spark, sf):
    it, tags = views.interactions(spark, sf), _item_tags(spark, sf)
    context = it.join(tags.select("item_id", "tag"), "item_id").groupBy("user_id", "tag").agg(
        (F.max("ts") >= F.lit(AS_OF).cast("timestamp") - F.expr("interval 2 days")).alias("recent"), (F.max(X.action_weight(F.col("action"), "tag")) / 10).alias("engagement"),
        F.countDistinct("category_id").alias("categories"), count_if(F.col("action") == "purchase").alias("purchases"),
    )
    return T.top_interests(T.decayed_interest(it, tags, AS_OF), context)


_RATED = "case when rating >= 4.5 then 'very_positive' when rating >= 3.5 then 'positive' when rating >= 2.5 then 'neutral' when rating >= 1.5 then 'negative' else 'very_negative' end"


@register("M3_rating_classes", _SENT + f""", l as (select doc_id, max(case when toxic = 1 then 1 when quality = 1 then 5 else 3 end) rating from labels group by 1),
c as (select doc_id, case when score > 0.5 then 'very_positive' when score > 0 then 'positive' when score = 0 then 'neutral' when score >= -0.5 then 'negative' else 'very_negative' end by_text, rating from s left join l using (doc_id))
select case when by_text = 'neutral' and rating is not null then {_RATED} else by_text end as class, rating::bigint rating, count(*) n from c group by 1, 2""")
def m3(spark, sf):
    rating = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 5).otherwise(3).cast("long")
    rated = views.table(spark, sf, "labels").groupBy("doc_id").agg(F.max(rating).alias("rating"))
    docs = views.table(spark, sf, "documents").select("doc_id", M.sentiment(F.col("text")).alias("score")).join(rated, "doc_id", "left")
    return docs.groupBy(M.upgraded_class(F.col("score"), F.col("rating")).alias("class"), "rating").agg(F.count(F.lit(1)).alias("n"))


@register("M5_explicit_feedback", SQL_INTERACTIONS + """, e as (
  select platform, case when action = 'purchase' then least(5, 1 + floor(price / 100)) end rating, case when action in ('add_cart', 'click') then true when action = 'impression' then false end liked from interactions)
select platform, count(rating) ratings, round(avg(rating), 6) mean_rating, round(stddev_pop(rating), 6) std_rating, """ + ", ".join(f"count(*) filter (where rating = {i}) rated_{i}" for i in range(1, 6)) + """,
  count(*) filter (where liked) likes, count(*) filter (where not liked) dislikes, round(count(*) filter (where liked) / greatest(count(liked), 1), 6) like_ratio, round(count(liked) / count(*), 6) engagement_ratio from e group by 1""")
def m5(spark, sf):
    rating = F.when(F.col("action") == "purchase", F.least(F.lit(5.0), 1.0 + F.floor(F.col("price") / 100)))
    liked = F.when(F.col("action").isin("add_cart", "click"), True).when(F.col("action") == "impression", False)
    return M.explicit_feedback(views.interactions(spark, sf).select("platform", rating.alias("rating"), liked.alias("liked")), "platform")


@register("M11_sentiment_trend", _SENT + """, b as (select epoch_us(ts) // 3600000000 h, avg(score) y from s join events on doc_id = event_id group by 1), i as (select row_number() over (order by h) - 1 x, y from b),
tr as (select count(*) n_hours, round(regr_slope(y, x), 6) slope from i)
select n_hours, slope, case when n_hours < 3 then 'INSUFFICIENT_DATA' when slope > 0.01 then 'IMPROVING' when slope < -0.01 then 'DECLINING' else 'STABLE' end direction from tr""")
def m11(spark, sf):
    """Comments are the documents; each is written at the time of the event of its number."""
    texts = views.table(spark, sf, "documents").select(F.col("doc_id").alias("event_id"), M.sentiment(F.col("text")).alias("score"))
    at = views.table(spark, sf, "events").select("event_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("h"))
    b = texts.join(at, "event_id").groupBy("h").agg(F.avg("score").alias("y"))
    b = b.withColumn("run", F.floor(F.col("h") / 4096))  # hours are numbered in runs, each after the hours of the runs before
    runs = b.groupBy(F.col("run").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    starts = runs.select("r", (F.sum("n").over(W.orderBy("r")) - F.col("n")).alias("start"))
    i = b.join(F.broadcast(starts), F.col("run") == F.col("r")).select((F.col("start") + F.row_number().over(W.partitionBy("run").orderBy("h")) - 1).alias("x"), "y")
    t = i.agg(F.count(F.lit(1)).alias("n_hours"), r6(F.regr_slope("y", "x")).alias("slope"))
    s = F.col("slope")
    return t.select("n_hours", "slope", F.when(F.col("n_hours") < 3, "INSUFFICIENT_DATA").when(s > 0.01, "IMPROVING").when(s < -0.01, "DECLINING").otherwise("STABLE").alias("direction"))


@register("M13_extremes", SQL_INTERACTIONS + f""", e as (select item_id, round(10 * {_n('purchase')} / greatest({_n('view')}, 1), 6) s from interactions group by 1),
b as (select item_id, s, 'best' kind from e order by s desc, item_id limit 5), w as (select item_id, s, 'worst' kind from e order by s, item_id limit 5)
select item_id, s satisfaction, kind, case when s >= 8 then 'very_high' when s >= 6 then 'high' when s >= 4 then 'medium' when s >= 2 then 'low' else 'very_low' end bucket from (select * from b union all select * from w)""")
def m13_extremes(spark, sf):
    e = views.interactions(spark, sf).groupBy("item_id").agg(r6(10 * X.m1(count_if(F.col("action") == "purchase"), count_if(F.col("action") == "view"))).alias("satisfaction"))
    s = F.col("satisfaction")
    best = e.orderBy(F.desc("satisfaction"), "item_id").limit(5).withColumn("kind", F.lit("best"))
    both = best.unionByName(e.orderBy("satisfaction", "item_id").limit(5).withColumn("kind", F.lit("worst")))
    return both.withColumn("bucket", F.when(s >= 8, "very_high").when(s >= 6, "high").when(s >= 4, "medium").when(s >= 2, "low").otherwise("very_low"))


@register("K3_cross_category", _ITEM_TAGS + """, d as (select item_id, list_sort(list(distinct dimension)) dims from item_tags group by 1)
select item_id, len(dims) dimensions, len(dims) > 1 crosses, list_contains(dims, 'material') and list_contains(dims, 'finish') material_and_finish from d""")
def k3_cross(spark, sf):
    dims = F.collect_set("dimension").alias("dims")
    d = _item_tags(spark, sf).groupBy("item_id").agg(dims)
    has = lambda x: F.array_contains("dims", x)
    return d.select("item_id", F.size("dims").cast("long").alias("dimensions"), (F.size("dims") > 1).alias("crosses"), (has("material") & has("finish")).alias("material_and_finish"))


@register("K7_preference_profile", _USER_TAGS + """, u as (select user_id, tag, dimension, count(*) n, sum(case when action in ('purchase', 'click', 'add_cart') then 1 else 0 end) pos from interactions join item_tags using (item_id) group by 1, 2, 3),
d as (select user_id, dimension, sum(n) n from u group by 1, 2), r as (select *, row_number() over (partition by user_id order by n desc, dimension) rn from d)
select user_id, sum(n)::bigint tag_events, sum(pos)::bigint positive, count(*) tags, round(count(*) / sum(n), 6) diversity, any_value(top) top_dimensions from u
join (select user_id, string_agg(dimension, ',' order by rn) top from r where rn <= 5 group by 1) using (user_id) group by 1""")
def k7_profile(spark, sf):
    joined = views.interactions(spark, sf).join(_item_tags(spark, sf), "item_id")
    u = joined.groupBy("user_id", "tag", "dimension").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("action").isin("purchase", "click", "add_cart")).alias("pos"))
    d = u.groupBy("user_id", "dimension").agg(F.sum("n").alias("n"))
    d = d.withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("n"), "dimension"))).filter("rn <= 5")
    top = d.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "dimension"))), lambda x: x["dimension"]), ",").alias("top_dimensions"))
    total = u.groupBy("user_id").agg(F.sum("n").alias("tag_events"), F.sum("pos").alias("positive"), F.count(F.lit(1)).alias("tags"), r6(sd(F.count(F.lit(1)), F.sum("n"))).alias("diversity"))
    return total.join(top, "user_id")
