"""Registered tag, text, store and rule queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recfeat import views
from recfeat.functions import exprs as X
from recfeat.operators import features as O
from recfeat.operators import store as S
from recfeat.operators import tags as T
from recfeat.operators import text as M
from recfeat.operators.quantiles import with_quantiles
from recfeat.plans.catalog import register
from recfeat.plans.features import _n, _weight, rounded
from recfeat.views import AS_OF, SQL_AS_OF, SQL_INTERACTIONS


def _lit(x) -> str:
    return "null" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::double"


_TAGS = ", dict as (select * from (values " + ", ".join("(" + ", ".join(map(_lit, row)) + ")" for row in T.DICTIONARY) + """) t(tag, dimension, parent, keyword, low, high)),
item_tags as (select distinct p_partkey item_id, tag, dimension from part join dict on contains(p_type, keyword) or (p_retailprice >= low and p_retailprice < high))"""
_ITEM_TAGS = "with x as (select 1)" + _TAGS
_USER_TAGS = SQL_INTERACTIONS + _TAGS


def _item_tags(spark, sf):
    return T.auto_tag(views.items(spark, sf), T.dictionary(spark))


@register("K1_auto_tags", _ITEM_TAGS + " select item_id, tag, dimension from item_tags")
def k1(spark, sf):
    return _item_tags(spark, sf)


@register("K3_tag_dimensions", _ITEM_TAGS + " select item_id, count(*) tags, count(distinct dimension) dimensions, string_agg(distinct dimension, ',' order by dimension) dimension_list from item_tags group by 1")
def k3(spark, sf):
    return _item_tags(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("tags"), F.countDistinct("dimension").alias("dimensions"), F.array_join(F.array_sort(F.collect_set("dimension")), ",").alias("dimension_list"))


@register("K9_tag_cooccurrence", _ITEM_TAGS + " select a.tag tag1, b.tag tag2, count(*) items from item_tags a join item_tags b on a.item_id = b.item_id and a.tag < b.tag group by 1, 2")
def k9(spark, sf):
    return T.cooccurrence(_item_tags(spark, sf))


@register("K10_tag_violations", _ITEM_TAGS + " select a.item_id, a.tag tag1, b.tag tag2 from item_tags a join item_tags b on a.item_id = b.item_id where (a.tag, b.tag) in (" + ", ".join(f"('{a}', '{b}')" for a, b in T.EXCLUSIVE) + ")")
def k10(spark, sf):
    return T.exclusivity(_item_tags(spark, sf), spark)


_K12 = {"1d": 86_400, "7d": 604_800, "30d": 2_592_000}
_COUNTS = _USER_TAGS + f""", c as (select user_id, tag, {', '.join(f"count(*) filter (where (epoch_us({SQL_AS_OF}) - epoch_us(ts)) / 1e6 <= {s}) n_{w}" for w, s in _K12.items())}, count(*) n, avg({_weight('tag')}) preference from interactions join item_tags using (item_id) group by 1, 2)"""


@register("K12_user_tag_windows", _COUNTS + " select user_id, tag, n_1d, n_7d, n_30d, n, round(preference, 6) preference from c")
def k12(spark, sf):
    return rounded(T.user_tag_counts(views.interactions(spark, sf), _item_tags(spark, sf), AS_OF, _K12))


@register("K14_tag_trends", _COUNTS + " select user_id, tag, case when (n_7d / 7) / (n_30d / 30) > 1.2::double then 'up' when (n_7d / 7) / (n_30d / 30) < 0.8::double then 'down' else 'steady' end trend from c where n_30d > 0")
def k14(spark, sf):
    return T.trending_tags(T.user_tag_counts(views.interactions(spark, sf), _item_tags(spark, sf), AS_OF, _K12))


_INTEREST = _USER_TAGS + f""", i as (select user_id, tag, round(least(10.0::double, sum(0.1::double * {_weight('tag')} * exp(-0.1::double * (epoch_us({SQL_AS_OF}) - epoch_us(ts)) / 1e6 / 86400))), 6) interest from interactions join item_tags using (item_id) where (epoch_us({SQL_AS_OF}) - epoch_us(ts)) / 1e6 / 86400 <= 90 group by 1, 2),
r as (select *, row_number() over (partition by user_id order by interest desc, tag) rank from i where interest >= 0.01)"""


@register("K17_decayed_interest", _INTEREST + " select user_id, tag, interest, rank from r where rank <= 100")
def k17(spark, sf):
    return T.decayed_interest(views.interactions(spark, sf), _item_tags(spark, sf), AS_OF)


_TOK = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda w: w <> '')"


def _in(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_SENT = f"""with t as (select doc_id, lang, source, {_TOK} w from documents), n as (select *, len(list_filter(w, lambda x: list_contains({_in(M.POSITIVE)}, x))) p, len(list_filter(w, lambda x: list_contains({_in(M.NEGATIVE)}, x))) m from t),
s as (select *, case when p + m = 0 then 0.0::double else (p - m) / (p + m) end score from n)"""


@register("M1_keywords", f"""with k as (select conv_id, turn, list_distinct(list_filter({_TOK}, lambda w: len(w) >= 4 and not list_contains({_in(M.STOP)}, w))) k from conversations) select conv_id, turn, len(k) n_keywords, array_to_string(list_sort(k), ',') words from k""")
def m1(spark, sf):
    t = views.table(spark, sf, "conversations").select("conv_id", "turn", M.keywords(F.col("text")).alias("k"))
    return t.select("conv_id", "turn", F.size("k").cast("long").alias("n_keywords"), F.array_join(F.array_sort("k"), ",").alias("words"))


@register("M2_sentiment", _SENT + " select doc_id, round(score, 6) score from s")
def m2(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", F.round(M.sentiment(F.col("text")), 6).alias("score"))


_CLASS = "case when score > 0.5 then 'very_positive' when score > 0 then 'positive' when score = 0 then 'neutral' when score >= -0.5 then 'negative' else 'very_negative' end"


@register("M4_sentiment_distribution", _SENT + f""", c as (select {_CLASS} as class, count(*) n from s group by 1)
select class, n, round(n / sum(n) over (), 6) share, round(sum(n * case class when 'very_positive' then 1 when 'positive' then 0.5 when 'neutral' then 0 when 'negative' then -0.5 else -1 end::double) over () / sum(n) over (), 6) overall from c""")
def m4(spark, sf):
    s = views.table(spark, sf, "documents").select(M.sentiment_class(M.sentiment(F.col("text"))).alias("class"))
    return rounded(M.class_distribution(s))


@register("M8_sentiment_by_source", _SENT + " select coalesce(source, 'unknown') source, count(*) n, round(avg(score), 6) score, count(*) filter (where score < 0) negative from s group by 1")
def m8(spark, sf):
    s = views.table(spark, sf, "documents").select(F.coalesce("source", F.lit("unknown")).alias("source"), M.sentiment(F.col("text")).alias("score"))
    return rounded(s.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"), F.count(F.when(F.col("score") < 0, 1)).alias("negative")))


@register("M9_comment_quality", """with c as (select length(coalesce(text, '')) n from conversations) select count(*) comments, round(avg(n), 6) mean_length, round(quantile_cont(n, 0.5), 6) median_length, round(avg((n > 100)::int), 6) detailed, round(var_pop(n), 4) variance from c""")
def m9(spark, sf):
    c = views.table(spark, sf, "conversations").select(F.length(F.coalesce("text", F.lit(""))).alias("n"))
    out = c.agg(F.count(F.lit(1)).alias("comments"), F.avg("n").alias("mean_length"), F.avg((F.col("n") > 100).cast("int")).alias("detailed"), F.round(F.var_pop("n"), 4).alias("variance"))
    return rounded(with_quantiles(out, c, F.col("n"), (0.5,)).withColumn("median_length", F.get("q", F.lit(0))).drop("q"))


@register("M10_topics", _SENT + """, tp as (select * from (values """ + ", ".join(f"('{a}', '{b}')" for a, b in M.TOPICS) + """) t(topic, word)), h as (select distinct doc_id, score, topic from s, tp where list_contains(w, word))
select topic, count(*) docs, round(avg(score), 6) score from h group by 1""")
def m10(spark, sf):
    """Only a topic's words become rows, so a text is scored once a word of the lexicon that it holds."""
    topics = F.broadcast(spark.createDataFrame(M.TOPICS, "topic string, word string"))
    words = F.array(*[F.lit(w) for w in sorted({w for _, w in M.TOPICS})])
    d = views.table(spark, sf, "documents").select("doc_id", M.sentiment(F.col("text")).alias("score"), F.explode(F.array_intersect(M.tokens(F.col("text")), words)).alias("word"))
    return rounded(d.join(topics, "word").select("doc_id", "score", "topic").distinct().groupBy("topic").agg(F.count(F.lit(1)).alias("docs"), F.avg("score").alias("score")))


def _user_features(spark, sf):
    it = views.interactions(spark, sf)
    return it.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), O.n_action("purchase").alias("purchases"), F.avg("price").alias("avg_price"), F.max(F.unix_seconds("ts")).alias("at"))


_UF = SQL_INTERACTIONS + f", u as (select user_id, count(*)::double events, {_n('purchase')}::double purchases, avg(price) avg_price, epoch_us(max(ts)) // 1000000 at_s from interactions group by 1), l as (select user_id entity_id, at_s, unnest(['events', 'purchases']) feature, unnest([events, purchases]) value from u)"


@register("N2_long_features", _UF + " select entity_id, at_s as at, feature, value, 'offline' source from l")
def n2(spark, sf):
    return S.to_long(_user_features(spark, sf), "user_id", "at", "offline", ["events", "purchases"])


@register("N3_latest_or_default", _UF + f", r as (select * from (values ('events', 86400, 0.0::double), ('purchases', 7200, -1.0::double)) t(feature, ttl, d)) select entity_id, feature, case when epoch_us({SQL_AS_OF}) // 1000000 - at_s > ttl then d else value end value, epoch_us({SQL_AS_OF}) // 1000000 - at_s > ttl stale from l join r using (feature)")
def n3(spark, sf):
    registry = spark.createDataFrame([("events", 86_400, 0.0), ("purchases", 7200, -1.0)], "feature string, ttl long, default double")
    return S.latest(S.to_long(_user_features(spark, sf), "user_id", "at", "offline"), registry, S.epoch(AS_OF))


@register("N8_freshness", _UF + f", a as (select epoch_us({SQL_AS_OF}) // 1000000 - at_s age from l) select 'offline' source, case when age < 300 then 'under_5m' when age < 3600 then 'under_1h' when age < 86400 then 'under_1d' else 'older' end age_class, count(*) n from a group by 2")
def n8(spark, sf):
    return S.freshness(S.to_long(_user_features(spark, sf), "user_id", "at", "offline", ["events", "purchases"]), S.epoch(AS_OF))


RULES = [
    {"rule_id": "no_cheap", "priority": 10, "condition": {"price": {"$lt": 50}}, "action": {"type": "exclude"}},
    {"rule_id": "no_own", "priority": 5, "condition": {"category_id": {"$in": [3]}, "brand_id": "$home_brand"}, "action": {"type": "exclude"}},
    {"rule_id": "push_dear", "priority": 8, "condition": {"price": {"$between": [300, 400]}}, "action": {"type": "boost", "factor": 1.5}},
    {"rule_id": "damp", "priority": 1, "condition": {"category_id": {"$not_in": [0, 1, 2, 3, 4]}}, "action": {"type": "boost", "factor": 0.8}},
]
_RULED = SQL_INTERACTIONS + """, x as (select event_id, price, (price < 50) e1, (category_id = 3 and brand_id = user_id % 7) e2, (price between 300 and 400) b1, (category_id not in (0, 1, 2, 3, 4)) b2 from interactions where action = 'view'),
y as (select *, case when e1 then 'no_cheap' when e2 then 'no_own' end excluded_by, b1 and not e1 f1, b2 and not e1 and not e2 f2 from x),
z as (select event_id, excluded_by, price * case when f1 then 1.5::double else 1 end * case when f2 then 0.8::double else 1 end score, concat_ws(',', case when f1 then 'push_dear' end, case when f2 then 'damp' end) applied from y)"""


def _ruled(spark, sf):
    recs = views.interactions(spark, sf).filter("action = 'view'").select("event_id", "price", "category_id", "brand_id", (F.col("user_id") % 7).alias("home_brand"), F.col("price").alias("score"))
    return S.apply_rules(recs, RULES)


@register("O2_business_rules", _RULED + " select event_id, round(score, 6) score, excluded_by, applied from z")
def o2(spark, sf):
    return _ruled(spark, sf).select("event_id", F.round("score", 6).alias("score"), "excluded_by", "applied")


@register("O3_rule_statistics", _RULED + " select excluded_by rule_id, count(*) n, 'blocked' kind from z where excluded_by is not null group by 1 union all select unnest(string_split(applied, ',')) rule_id, count(*) n, 'boosted' from z where applied <> '' group by 1")
def o3(spark, sf):
    return S.rule_statistics(_ruled(spark, sf))


@register("O6_target_users", SQL_INTERACTIONS + """ select user_id, 'fan' reason from interactions where category_id = 2 group by 1 having count(*) >= 10 union select user_id, 'spender' from interactions where action = 'purchase' group by 1 having sum(price) > 2000""")
def o6(spark, sf):
    it = views.interactions(spark, sf)
    fans = it.filter("category_id = 2").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10").select("user_id", F.lit("fan").alias("reason"))
    big = it.filter("action = 'purchase'").groupBy("user_id").agg(F.sum("price").alias("s")).filter("s > 2000").select("user_id", F.lit("spender").alias("reason"))
    return fans.union(big)


@register("O8_assignment", "select distinct user_id, (('0x' || substr(md5(user_id::varchar), 1, 8))::bigint) % 100 bucket, case when (('0x' || substr(md5(user_id::varchar), 1, 8))::bigint) % 100 < 20 then 'treatment' else 'control' end arm from events")
def o8(spark, sf):
    b = X.hash_bucket(F.col("user_id"), 100)
    return views.table(spark, sf, "events").select("user_id").distinct().select("user_id", b.alias("bucket"), F.when(b < 20, "treatment").otherwise("control").alias("arm"))


@register("B2_calendar", SQL_INTERACTIONS + """ select event_id, strftime(ts, '%Y-%m-%d') as day, hour(ts)::int as hour, (dayofweek(ts) + 1)::int day_of_week, dayofweek(ts) in (0, 6) weekend, case when hour(ts) between 6 and 11 then 'morning' when hour(ts) between 12 and 17 then 'afternoon' when hour(ts) between 18 and 22 then 'evening' else 'night' end day_part, platform = 'Mobile' mobile from interactions""")
def b2(spark, sf):
    it = views.interactions(spark, sf)
    return it.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour"), F.dayofweek("ts").alias("day_of_week"), F.dayofweek("ts").isin(1, 7).alias("weekend"), X.day_part(F.hour("ts")).alias("day_part"), (F.col("platform") == "Mobile").alias("mobile"))


@register("B3_action_weights", SQL_INTERACTIONS + " select action, " + ", ".join(f"{_weight(s)} {s}" for s in X.WEIGHTS) + " from interactions group by action")
def b3(spark, sf):
    return views.interactions(spark, sf).select("action").distinct().select("action", *[X.action_weight(F.col("action"), s).alias(s) for s in X.WEIGHTS])


@register("B7_price_bands", "select case when value < 20 then 'budget' when value < 40 then 'mid' when value < 60 then 'premium' else 'luxury' end band, count(*) n from events group by 1")
def b7(spark, sf):
    return views.table(spark, sf, "events").groupBy(X.price_band(F.col("value")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@register("B12_cyclic_time", SQL_INTERACTIONS + " select event_id, round(sin(hour(ts) * 2 * pi() / 24), 6) + 0 hour_sin, round(cos(hour(ts) * 2 * pi() / 24), 6) + 0 hour_cos, round(sin((isodow(ts) - 1) * 2 * pi() / 7), 6) + 0 day_sin, round(cos((isodow(ts) - 1) * 2 * pi() / 7), 6) + 0 day_cos from interactions")
def b12(spark, sf):
    hs, hc = X.cyclic(F.hour("ts"), 24)
    ds, dc = X.cyclic(F.weekday("ts"), 7)
    return views.interactions(spark, sf).select("event_id", *[(F.round(c, 6) + 0.0).alias(n) for c, n in ((hs, "hour_sin"), (hc, "hour_cos"), (ds, "day_sin"), (dc, "day_cos"))])


@register("B18_minimum_activity", SQL_INTERACTIONS + " select event_id, user_id, item_id from interactions where user_id in (select user_id from interactions group by 1 having count(*) >= 60) and item_id in (select item_id from interactions group by 1 having count(*) >= 90)")
def b18(spark, sf):
    it = views.interactions(spark, sf)
    enough = lambda c, n: it.groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= n).select(c)
    return it.join(enough("user_id", 60), "user_id", "left_semi").join(enough("item_id", 90), "item_id", "left_semi").select("event_id", "user_id", "item_id")


@register("B21_trend", SQL_INTERACTIONS + f", a as (select user_id, count(*) filter (where ts >= {SQL_AS_OF} - interval 30 days)::double l, count(*) filter (where ts >= {SQL_AS_OF} - interval 7 days)::double s from interactions group by 1) select user_id, round(case when s = 0 then 0 else least(1.0::double, greatest(-1.0::double, (l / (30.0::double / 7) - s) / s)) end, 6) trend from a")
def b21(spark, sf):
    n = lambda d: F.count(F.when(F.col("ts") >= O.since(AS_OF, d * 86_400), 1)).cast("double")
    a = views.interactions(spark, sf).groupBy("user_id").agg(n(30).alias("l"), n(7).alias("s"))
    return a.select("user_id", F.round(X.trend(F.col("l"), F.col("s"), 30.0 / 7), 6).alias("trend"))


@register("H8_string_aggregates", SQL_INTERACTIONS + " select user_id, string_agg(distinct action, ',' order by action) actions, bool_or(action = 'purchase') bought from interactions group by 1")
def h8(spark, sf):
    return views.interactions(spark, sf).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("action")), ",").alias("actions"), F.bool_or(F.col("action") == "purchase").alias("bought"))


@register("H10_vector_norms", "with n as (select vec_id, embedding::double[] e from embeddings) select vec_id, round(sqrt(list_dot_product(e, e)), 6) norm from n")
def h10(spark, sf):
    return views.table(spark, sf, "embeddings").select("vec_id", F.round(X.norm(F.col("embedding")), 6).alias("norm"))


@register("K16_decay_curves", "select distinct p_size as days, round(exp(-0.1::double * p_size), 6) exponential, round(greatest(0.0::double, 1 - 0.1::double * p_size), 6) linear, round(least(1.0::double, 1 / ln(1 + 0.1::double * p_size)), 6) logarithmic, round(pow(p_size, -0.1::double), 6) power from part where p_size > 0")
def k16(spark, sf):
    d = views.table(spark, sf, "part").filter("p_size > 0").select(F.col("p_size").alias("days")).distinct()
    return d.select("days", *[F.round(X.decay(F.col("days"), k, 0.1), 6).alias(k) for k in ("exponential", "linear", "logarithmic", "power")])


@register("R4_masked_sequences", SQL_INTERACTIONS + """, m as (select event_id, user_id, item_id, (('0x' || substr(md5(user_id || ':' || event_id), 1, 8))::bigint) % 1000 h from interactions)
select event_id, user_id, case when h < 120 then -1 when h < 135 then (h * 7 % 100)::int else item_id end input, h < 150 masked from m""")
def r4(spark, sf):
    h = X.hash_bucket(F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_id").cast("string")), 1000)
    return views.interactions(spark, sf).select("event_id", "user_id", F.when(h < 120, -1).when(h < 135, (h * 7 % 100).cast("int")).otherwise(F.col("item_id")).alias("input"), (h < 150).alias("masked"))


@register("S1_percentile_element", SQL_INTERACTIONS + " , s as (select item_id, list_sort(list(price)) x from interactions group by 1) select item_id, round(x[least(floor(len(x) * 0.9::double)::bigint, len(x) - 1) + 1], 6) p90 from s")
def s1(spark, sf):
    # Prices are counted, the whole unit that holds the place is found first, then the price inside it: no list of prices.
    c = views.interactions(spark, sf).groupBy("item_id", F.floor("price").alias("unit"), "price").agg(F.count("price").alias("n"))
    whole, upto = W.partitionBy("item_id"), W.partitionBy("item_id").orderBy("unit")
    units = c.groupBy("item_id", "unit").agg(F.sum("n").alias("n")).withColumns({"total": F.sum("n").over(whole), "end": F.sum("n").over(upto)})
    at = F.least(F.floor(F.col("total") * F.lit(0.9)), F.col("total") - 1)
    units = units.withColumn("at", at).filter((F.col("end") > F.col("at")) & (F.col("end") - F.col("n") <= F.greatest("at", F.lit(0))))
    units = units.select(F.col("item_id").alias("item"), F.col("unit").alias("u"), (F.col("at") - F.col("end") + F.col("n")).alias("at"))
    x = c.join(units, F.col("item_id").eqNullSafe(F.col("item")) & F.col("unit").eqNullSafe(F.col("u")))
    x = x.withColumn("end", F.sum("n").over(W.partitionBy("item_id", "unit").orderBy("price")))
    return x.filter((F.col("end") > F.col("at")) & (F.col("end") - F.col("n") <= F.greatest("at", F.lit(0)))).select("item_id", F.round("price", 6).alias("p90"))
