"""Registered customer, product, satisfaction, media and profiling queries with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recfeat import views
from recfeat.functions import exprs as X
from recfeat.functions.exprs import count_if, p1, r6
from recfeat.operators import features as O
from recfeat.operators import products as P
from recfeat.operators import tags as T
from recfeat.operators import text as M
from recfeat.operators.running import mean_exact
from recfeat.operators.quantiles import quantiles, with_quantiles
from recfeat.plans.catalog import register
from recfeat.plans.features import _n, _weight, rounded
from recfeat.plans.more import _WATCH, _watches
from recfeat.plans.profiles import _ITEM_TAGS, _SENT, _item_tags
from recfeat.views import AS_OF, SQL_AS_OF, SQL_INTERACTIONS, SQL_PURCHASES, SQL_SESSIONS

_KINDS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")

_CUSTOMERS = SQL_PURCHASES + ", " + SQL_SESSIONS.removeprefix("with ") + f""",
b as (select customer_id, brand, count(*) n from purchases group by 1, 2), l as (select customer_id, max(n) / sum(n) loyalty from b group by 1),
k as (select customer_id, split_part(category, ' ', 1) kind, sum(amount) a from purchases group by 1, 2),
c as (select customer_id, {", ".join(f"coalesce(sum(a) filter (where kind = '{x}'), 0) / greatest(sum(a), 1) pref_{x.lower()}" for x in _KINDS)} from k group by 1),
o as (select customer_id, count(distinct order_id) orders, sum(amount) spent, date_diff('day', min(ts)::date, max(ts)::date) tenure from purchases group by 1),
s as (select user_id, session_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6 mins, count(*) filter (where action = 'add_cart') carts, bool_or(action = 'purchase') bought, any_value(platform) device
  from sessions where ts >= {SQL_AS_OF} - interval 30 days and ts < {SQL_AS_OF} group by 1, 2),
d as (select user_id, max(struct_pack(n := n, device := device)).device device from (select user_id, device, count(*) n from s group by 1, 2) group by 1),
v as (select user_id, count(*) n, avg(mins) mins, avg((carts > 0 and not bought)::int) left_carts, avg(bought::int) converted, avg(carts) carts from s group by 1)"""


def _customers(spark, sf):
    """What purchases say of each customer, and the last thirty days' sessions of the user of that number."""
    p = views.purchases(spark, sf)
    loyalty = p.groupBy("customer_id", "brand").agg(F.count(F.lit(1)).alias("n")).groupBy("customer_id").agg((F.max("n") / F.sum("n")).alias("brand_loyalty"))
    kind = F.split("category", " ")[0]
    out = p.groupBy("customer_id").agg(
        F.countDistinct("order_id").alias("orders"), F.sum("amount").alias("lifetime_value"), F.datediff(F.max("ts"), F.min("ts")).cast("long").alias("tenure_days"),
        *[(F.coalesce(F.sum(F.when(kind == x, F.col("amount"))), F.lit(0.0)) / F.greatest(F.sum("amount"), F.lit(1.0))).alias(f"pref_{x.lower()}") for x in _KINDS],
    ).withColumns({"avg_order_value": F.col("lifetime_value") / F.col("orders"), "frequency": F.col("orders") / F.greatest(F.col("tenure_days") / 365, F.lit(1.0))})
    it = views.interactions(spark, sf, sessions=True).filter((F.col("ts") >= O.since(AS_OF, 30 * 86_400)) & (F.col("ts") < F.lit(AS_OF).cast("timestamp")))
    cart, buy = F.col("action") == "add_cart", F.col("action") == "purchase"
    s = it.groupBy("user_id", "session_id").agg(
        ((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 60e6).alias("minutes"), count_if(cart).alias("carts"), F.bool_or(buy).alias("bought"), F.first("platform").alias("device"),
    )
    device = s.groupBy("user_id", "device").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.max_by("device", F.struct("n", "device")).alias("preferred_device"))
    s = s.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("monthly_sessions"), F.avg("minutes").alias("avg_session_minutes"), F.avg(((F.col("carts") > 0) & ~F.col("bought")).cast("int")).alias("cart_abandonment"),
        F.avg(F.col("bought").cast("int")).alias("conversion"), F.avg("carts").alias("avg_cart_size"),
    ).join(device, "user_id").withColumnRenamed("user_id", "customer_id")
    return out.join(loyalty, "customer_id").join(s, "customer_id", "left")


@register("D19_customer_features", _CUSTOMERS + f""" select customer_id, orders, round(spent, 2) lifetime_value, tenure tenure_days, round(spent / orders, 2) avg_order_value, round(orders / greatest(tenure / 365, 1), 6) frequency,
  round(loyalty, 6) brand_loyalty, {", ".join(f"round(pref_{x.lower()}, 6) pref_{x.lower()}" for x in _KINDS)}, v.n monthly_sessions, round(mins, 6) avg_session_minutes, round(left_carts, 6) cart_abandonment,
  round(converted, 6) conversion, round(carts, 6) avg_cart_size, device preferred_device
from o join l using (customer_id) join c using (customer_id) left join v on v.user_id = customer_id left join d on d.user_id = customer_id""")
def d19(spark, sf):
    return rounded(_customers(spark, sf).withColumns({c: F.round(c, 2) for c in ("lifetime_value", "avg_order_value")}))


_PRODUCTS = SQL_PURCHASES + ", " + SQL_INTERACTIONS.removeprefix("with ") + """,
x as (select l_partkey item_id, count(*) n, sum(round(l_discount * 1e6)::bigint)::double / count(l_discount) / 1e6::double discount, avg((l_returnflag = 'R')::int) returns, avg(case l_returnflag when 'A' then 5 when 'N' then 4 else 1 end) rating,
  count(*) filter (where l_returnflag <> 'N') reviews from lineitem group by 1),
w as (select item_id, count(*) filter (where action = 'view') looks, count(*) filter (where action = 'add_cart') carts from interactions group by 1),
g as (select p_type, avg(p_retailprice) m from part group by 1), r as (select p_brand, avg(p_retailprice) / max(avg(p_retailprice)) over () premium from part group by 1),
f as (select p_partkey item_id, p_brand brand, p_type category, p_size size, p_retailprice price, coalesce(n, 0) sold, coalesce(discount, 0) discount, coalesce(returns, 0) return_rate,
  case when rating > 0 then least(rating / 5, 1) else 0.5 end::double review_quality, least(ln(1 + coalesce(reviews, 0)) / 10, 1) review_volume, ln(1 + coalesce(looks, 0) + coalesce(n, 0)) popularity,
  coalesce(n, 0) / greatest(coalesce(looks, 0), 1) conversion, coalesce(n, 0) / greatest(coalesce(carts, 0), 1) cart_conversion, len(string_split(p_name, ' ')) / 5 variety, m / greatest(price, 0.01::double) price_competitiveness, premium
  from part join g using (p_type) join r using (p_brand) left join x on x.item_id = p_partkey left join w on w.item_id = p_partkey)"""
_PRODUCT_COLUMNS = ("discount", "return_rate", "review_quality", "review_volume", "popularity", "conversion", "cart_conversion", "variety", "price_competitiveness")


def _products(spark, sf):
    """Ratings and reviews are read from the return flags of order lines, variety from the words of the name."""
    li, flag = views.table(spark, sf, "lineitem"), F.col("l_returnflag")
    x = li.groupBy(F.col("l_partkey").alias("item_id")).agg(
        F.count(F.lit(1)).alias("n"), mean_exact(F.col("l_discount")).alias("disc"), F.avg((flag == "R").cast("int")).alias("returns"), F.avg(F.when(flag == "A", 5).when(flag == "N", 4).otherwise(1)).alias("rating"), count_if(flag != "N").alias("reviews"),
    )
    w = views.interactions(spark, sf).groupBy("item_id").agg(count_if(F.col("action") == "view").alias("looks"), count_if(F.col("action") == "add_cart").alias("carts"))
    items = views.items(spark, sf)
    g = items.groupBy("category").agg(F.avg("price").alias("m"))
    r = items.groupBy("brand").agg(F.avg("price").alias("p"))
    r = r.crossJoin(F.broadcast(r.agg(F.max("p").alias("most")))).select("brand", (F.col("p") / F.col("most")).alias("premium"))  # one row broadcast
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = items.join(g, "category").join(r, "brand").join(x, "item_id", "left").join(w, "item_id", "left").withColumn("sold", zero("n"))
    c = F.col
    return out.select(
        "item_id", "brand", "category", "size", "price", "sold", "premium", F.coalesce("disc", F.lit(0.0)).alias("discount"), F.coalesce("returns", F.lit(0.0)).alias("return_rate"),
        F.when(c("rating") > 0, F.least(c("rating") / 5, F.lit(1.0))).otherwise(0.5).alias("review_quality"), F.least(F.log1p(zero("reviews")) / 10, F.lit(1.0)).alias("review_volume"),
        F.log1p(zero("looks") + c("sold")).alias("popularity"), X.m1(c("sold"), zero("looks")).alias("conversion"), X.m1(c("sold"), zero("carts")).alias("cart_conversion"),
        (F.size(F.split("title", " ")) / 5).alias("variety"), (c("m") / F.greatest("price", F.lit(0.01))).alias("price_competitiveness"),
    )


@register("B16_product_features", _PRODUCTS + " select item_id, " + ", ".join(f"round({c}, 6) {c}" for c in _PRODUCT_COLUMNS) + " from f")
def b16(spark, sf):
    return _products(spark, sf).select("item_id", *[r6(c).alias(c) for c in _PRODUCT_COLUMNS])


_RULES = """b as (select distinct order_id, item_id from purchases), cnt as (select item_id, count(*) n from b group by 1), tot as (select count(distinct order_id) t from b),
pr as (select x.item_id, y.item_id other, count(*) support from b x join b y on x.order_id = y.order_id and x.item_id <> y.item_id group by 1, 2 having count(*) >= 2),
rules as (select pr.item_id, other, support, support / cnt.n confidence, support / cnt.n / (o.n / t) lift from pr join cnt on cnt.item_id = pr.item_id join cnt o on o.item_id = other, tot)"""


@register("J17_association_rules", SQL_PURCHASES + ", " + _RULES + " select item_id, other, support, round(confidence, 6) confidence, round(lift, 6) lift from rules")
def j17_rules(spark, sf):
    return rounded(P.association_rules(views.purchases(spark, sf)))


@register("J17_hybrid_score", _CUSTOMERS + ", " + _PRODUCTS.split(",\nx as (", 1)[1].join(["x as (", ""]) + ", " + _RULES.replace("b as (", "bk as (").replace("from b ", "from bk ").replace("join b ", "join bk ").replace("from b)", "from bk)") + """,
own as (select distinct customer_id, item_id from purchases),
cand as (select customer_id, other item_id, max(least(1, confidence)) cross_sell from own join rules using (item_id) group by 1, 2),
sens as (select o_custkey customer_id, sum(round(l_discount * 1e6)::bigint)::double / count(l_discount) / 1e6::double d from lineitem join orders on l_orderkey = o_orderkey group by 1),
z as (select cand.customer_id, cand.item_id, cross_sell, case split_part(category, ' ', 1) """ + " ".join(f"when '{x}' then pref_{x.lower()}" for x in _KINDS) + """ else 0 end pref, loyalty, premium, review_quality, popularity, return_rate, price, size,
  category like 'PROMO%' promo, d >= 0.05::double sensitive, f.discount >= 0.05::double on_sale, spent / orders aov
  from cand join f using (item_id) join o using (customer_id) join l using (customer_id) join c using (customer_id) join sens using (customer_id)),
y as (select *, 0.6::double * pref + 0.4::double * case when sensitive and on_sale then 0.9 when not sensitive and price > 50 then 0.8 when aov > 0 and price / aov between 0.5 and 2 then 0.7 else 0.5 end::double cf,
  0.5::double * (0.6::double * loyalty + 0.4::double * premium) + 0.5::double * review_quality content, least(1.0::double, 0.5::double + case when on_sale then 0.2 else 0 end::double + case when promo then 0.15 else 0 end::double) business from z),
sc as (select customer_id, item_id, round(least(1.0::double, (0.35::double * cf + 0.25::double * content + 0.15::double * popularity / 10 + 0.15::double * cross_sell + 0.1::double * business)
  * case when size < 3 then 0.1 else 1 end::double * case when on_sale and sensitive then 1.3 else 1 end::double * case when return_rate > 0.2 then 0.8 else 1 end::double), 6) score from y)
select customer_id, item_id, score, row_number() over (partition by customer_id order by score desc, item_id) rank from sc qualify row_number() over (partition by customer_id order by score desc, item_id) <= 10""")
def j17(spark, sf):
    """Ten products a customer, of those that rules lead to from what the customer has bought; the confidence of the best rule is the cross-sell part."""
    purchases = views.purchases(spark, sf)
    own = purchases.select("customer_id", "item_id").distinct()
    cand = own.join(P.association_rules(purchases), "item_id").groupBy("customer_id", F.col("other").alias("item_id")).agg(F.max(F.least(F.lit(1.0), "confidence")).alias("cross_sell"))
    li, orders = views.table(spark, sf, "lineitem"), views.table(spark, sf, "orders")
    sensitive = li.join(orders, li.l_orderkey == orders.o_orderkey).groupBy(F.col("o_custkey").alias("customer_id")).agg((mean_exact(F.col("l_discount")) >= 0.05).alias("sensitive"))
    z = cand.join(_products(spark, sf), "item_id").join(_customers(spark, sf).drop("conversion"), "customer_id").join(sensitive, "customer_id")
    on_sale, c = F.col("discount") >= 0.05, F.col
    pref = F.lit(0.0)
    for x in _KINDS:
        pref = F.when(F.split("category", " ")[0] == x, c(f"pref_{x.lower()}")).otherwise(pref)
    match = P.price_match(c("sensitive"), on_sale, c("price"), c("avg_order_value"))
    business = F.least(F.lit(1.0), 0.5 + F.when(on_sale, 0.2).otherwise(0.0) + F.when(c("category").startswith("PROMO"), 0.15).otherwise(0.0))
    parts = {
        "collaborative": 0.6 * pref + 0.4 * match, "content": 0.5 * (0.6 * c("brand_loyalty") + 0.4 * c("premium")) + 0.5 * c("review_quality"), "popularity": c("popularity") / 10,
        "cross_sell": c("cross_sell"), "business": business,
    }
    score = P.hybrid_score(parts, c("size") < 3, on_sale & c("sensitive"), c("return_rate"))
    s = z.select("customer_id", "item_id", r6(score).alias("score"))
    rank = F.row_number().over(W.partitionBy("customer_id").orderBy(F.desc("score"), "item_id"))
    return s.withColumn("rank", rank.cast("long")).filter("rank <= 10")


_FUSED = r"""with w as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) w from documents),
h as (select doc_id, ('0x' || substr(md5(w), 1, 8))::bigint % 128 d, sum(case when ('0x' || substr(md5(w), 9, 1))::bigint % 2 = 0 then 1 else -1 end)::double v from w group by 1, 2),
n as (select doc_id, sqrt(sum(v * v)) norm from h group by 1), g as (select n.doc_id, d.d, coalesce(case when norm > 0 then v / norm end, 0) v from n cross join range(128) d(d) left join h on h.doc_id = n.doc_id and h.d = d.d),
t as (select doc_id, list(v order by d) tv from g group by 1),
u as (select vec_id, list_concat(list_transform(embedding::double[], lambda x: x * 0.4::double), list_transform(coalesce(tv, list_transform(range(128), lambda x: 0.0::double)), lambda x: x * 0.35::double)) f from embeddings left join t on doc_id = vec_id),
fused as (select vec_id, list_transform(f, lambda x: case when list_dot_product(f, f) > 0 then x / sqrt(list_dot_product(f, f)) else 0 end) f from u)"""


def _fused(spark, sf):
    """The given vectors, each with the hashed words of the document of its number."""
    texts = P.text_vectors(views.table(spark, sf, "documents"), "doc_id", "text")
    e = views.table(spark, sf, "embeddings").join(texts, F.col("vec_id") == F.col("doc_id"), "left")
    return e.select("vec_id", P.fused(F.col("embedding"), F.coalesce("text_vector", F.array_repeat(F.lit(0.0), 128))).alias("f"))


@register("J20_fused_vectors", _FUSED + " select vec_id, list_transform(f, lambda x: round(x, 6) + 0) vec from fused")
def j20(spark, sf):
    return _fused(spark, sf).select("vec_id", F.transform("f", lambda x: r6(x) + 0.0).alias("vec"))


@register("J20_fused_cosine", _FUSED + " select a.vec_id, b.vec_id other, round(list_dot_product(a.f, b.f), 6) + 0 cosine, round((list_dot_product(a.f, b.f) + 1) / 2, 6) engagement from fused a join fused b on b.vec_id = a.vec_id + 1")
def j20_cosine(spark, sf):
    f = _fused(spark, sf)
    pairs = f.join(f.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("f").alias("g")), "vec_id")
    dot = X.dot(F.col("f"), F.col("g"))
    return pairs.select("vec_id", "other", (r6(dot) + 0.0).alias("cosine"), r6((dot + 1) / 2).alias("engagement"))


@register("J16_cross_features", SQL_INTERACTIONS + f""", r as (select *, ts >= {SQL_AS_OF} - interval 7 days recent from interactions),
u as (select user_id, count(*) filter (where recent) n7, avg({_weight('offline')}) filter (where recent) e7, {_n('purchase', 'recent')} / ({_n('view', 'recent')} + 1) cv, coalesce(list(distinct hour(ts)) filter (where recent), []) seen from r group by 1),
pf as (select user_id, max(struct_pack(n := n, p := platform)).p usual from (select user_id, platform, count(*) n from r where recent group by 1, 2) group by 1),
i as (select item_id, count(*) filter (where recent) n7, count(distinct user_id) filter (where recent) u7, avg(case action when 'purchase' then 10.0::double else 1.0::double end) filter (where recent) e7 from r group by 1),
ip as (select *, ln(1 + n7) * ln(1 + u7) pop from i), q as (select quantile_cont(pop, 0.8) p80 from ip), p as (select user_id, item_id, count(*) n from r group by 1, 2)
select event_id, round(p.n * ln(1 + ip.u7), 6) affinity, case when ip.n7 > ip.e7 and ip.pop > p80 then 1.0 else 0.0 end::double popularity_match, case when platform = usual then 1.0 else 0.5 end::double platform_consistency,
  case when list_contains(seen, hour(ts)) then 1.0 else 0.3 end::double temporal_alignment, round(u.n7 * ip.pop, 6) activity_popularity, round(coalesce(u.cv, 0) * coalesce(u.e7, 0), 6) conversion_engagement
from r join u using (user_id) join ip using (item_id) join p using (user_id, item_id) left join pf using (user_id), q""")
def j16(spark, sf):
    it = views.interactions(spark, sf)
    recent = F.col("ts") >= O.since(AS_OF, 7 * 86_400)
    n = lambda a: count_if((F.col("action") == a) & recent)
    u = it.groupBy("user_id").agg(
        count_if(recent).alias("un7"), F.avg(F.when(recent, X.action_weight(F.col("action"), "offline"))).alias("ue7"), p1(n("purchase"), n("view")).alias("cv"), F.collect_set(F.when(recent, F.hour("ts"))).alias("hours"),
    )
    usual = it.filter(recent).groupBy("user_id", "platform").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.max_by("platform", F.struct("n", "platform")).alias("usual"))
    i = it.groupBy("item_id").agg(count_if(recent).alias("n7"), F.countDistinct(F.when(recent, F.col("user_id"))).alias("u7"), F.avg(F.when(recent, F.when(F.col("action") == "purchase", 10.0).otherwise(1.0))).alias("e7"))
    i = i.withColumn("pop", F.log1p("n7") * F.log1p("u7"))
    p80 = quantiles(i, F.col("pop"), (0.8,)).select(F.get("q", F.lit(0)).alias("p80"))  # one row broadcast
    p = it.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    x = it.join(u, "user_id").join(i, "item_id").join(p, ["user_id", "item_id"]).join(usual, "user_id", "left").crossJoin(F.broadcast(p80))
    flag = lambda c, no: F.when(c, 1.0).otherwise(no)
    zero = F.lit(0.0)
    return x.select(
        "event_id", r6(F.col("n") * F.log1p("u7")).alias("affinity"), flag((F.col("n7") > F.col("e7")) & (F.col("pop") > F.col("p80")), 0.0).alias("popularity_match"),
        flag(F.col("platform") == F.col("usual"), 0.5).alias("platform_consistency"), flag(F.array_contains("hours", F.hour("ts")), 0.3).alias("temporal_alignment"),
        r6(F.col("un7") * F.col("pop")).alias("activity_popularity"), r6(F.coalesce("cv", zero) * F.coalesce("ue7", zero)).alias("conversion_engagement"),
    )


_SATISFIED = _SENT.replace("with t as", SQL_SESSIONS + ", t as", 1) + """,
ex as (select doc_id % 100 item_id, avg(case when quality = 1 then 8.0 else 2.0 end::double) x from labels where quality is not null group by 1),
dw as (select *, (epoch_us(lead(ts) over (partition by session_id order by ts, event_id)) - epoch_us(ts)) / 1e6 dwell from sessions),
be as (select item_id, avg(greatest(0, least(10, 5 + case when dwell > 60 then 2.0 when dwell > 30 then 1.0 when dwell < 5 then -2.0 else 0.0 end::double + case when price / 500 > 0.7 then 1.5 when price / 500 > 0.3 then 0.5 else 0.0 end::double
  + case action when 'purchase' then 2.0 when 'add_cart' then 1.0 when 'share' then 1.5 else 0.0 end::double))) x from dw group by 1),
co as (select doc_id % 100 item_id, avg((score + 1) * 5) x from s group by 1),
sat as (select coalesce(ex.item_id, be.item_id, co.item_id) item_id, coalesce(ex.x, 5) explicit, coalesce(be.x, 5) behavioural, coalesce(co.x, 5) comment from ex full join be on ex.item_id = be.item_id full join co on co.item_id = coalesce(ex.item_id, be.item_id)),
sa as (select *, 0.4::double * explicit + 0.35::double * behavioural + 0.25::double * comment satisfaction from sat)"""


def _satisfied(spark, sf):
    """Explicit feedback and comments come from the labels and texts of documents, taken as comments on the item of the last two digits."""
    item = (F.col("doc_id") % 100).cast("int").alias("item_id")
    explicit = views.table(spark, sf, "labels").filter("quality is not null").select(item, F.when(F.col("quality") == 1, 8.0).otherwise(2.0).alias("score"))
    w = W.partitionBy("session_id").orderBy("ts", "event_id")
    it = views.interactions(spark, sf, sessions=True).withColumn("dwell", (F.unix_micros(F.lead("ts").over(w)) - F.unix_micros("ts")) / 1e6)
    behaviour = it.select("item_id", P.behaviour_score(F.col("dwell"), F.col("price") / 500, F.col("action")).alias("score"))
    comments = views.table(spark, sf, "documents").select(item, ((M.sentiment(F.col("text")) + 1) * 5).alias("score"))
    return P.item_satisfaction(explicit, behaviour, comments)


@register("M12_item_satisfaction", _SATISFIED + " select item_id::int item_id, round(explicit, 6) explicit, round(behavioural, 6) behavioural, round(comment, 6) as comment, round(satisfaction, 6) satisfaction from sa")
def m12(spark, sf):
    return rounded(_satisfied(spark, sf))


@register("M13_satisfaction_grades", _SATISFIED + """ select case when satisfaction >= 8 then 'A_EXCELLENT' when satisfaction >= 7 then 'B_GOOD' when satisfaction >= 6 then 'C_AVERAGE' when satisfaction >= 5 then 'D_BELOW_AVERAGE' else 'F_POOR' end grade,
  count(*) items, count(*) filter (where abs(explicit - behavioural) > 3) conflicting, round(avg((abs(explicit - behavioural) > 3)::int), 6) conflict_share from sa group by 1""")
def m13(spark, sf):
    conflict = F.abs(F.col("explicit") - F.col("behavioural")) > 3
    return _satisfied(spark, sf).groupBy(P.satisfaction_grade(F.col("satisfaction")).alias("grade")).agg(F.count(F.lit(1)).alias("items"), count_if(conflict).alias("conflicting"), r6(F.avg(conflict.cast("int"))).alias("conflict_share"))


@register("M13_by_source", _SATISFIED + " select platform source, count(*) events, round(avg(coalesce(satisfaction, 5)), 6) avg_satisfaction from sessions left join sa using (item_id) group by 1")
def m13_source(spark, sf):
    """Platforms stand in for recommendation sources."""
    it = views.interactions(spark, sf).select("item_id", F.col("platform").alias("source"))
    x = it.join(_satisfied(spark, sf), "item_id", "left")
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("events"), r6(F.avg(F.coalesce("satisfaction", F.lit(5.0)))).alias("avg_satisfaction"))


#: Starting weights of the channels, in equal parts.
_CHANNELS = {"PS5": 0.5, "PS4": 0.3, "Mobile": 0.2}


@register("L31_channel_weights", SQL_INTERACTIONS + f""", e as (select platform channel, {_n('click')} / greatest({_n('view')}, 1) x from interactions group by 1), a as (select channel, x / avg(x) over () eff from e),
b as (select channel, w old_weight, w * least(2.0::double, greatest(0.5::double, eff)) raw from a join (values {", ".join(f"('{c}', {w}::double)" for c, w in _CHANNELS.items())}) t(channel, w) using (channel)),
n as (select *, raw / sum(raw) over () new from b), m as (select *, max(abs(new - old_weight)) over () > 0.05::double changed from n)
select channel, old_weight, round(case when changed then new else old_weight end, 6) weight, changed from m""")
def l31(spark, sf):
    """Platforms stand in for recall channels; a channel's effectiveness is its click rate against the mean of the channels."""
    e = views.interactions(spark, sf).groupBy(F.col("platform").alias("channel")).agg(X.m1(O.n_action("click"), O.n_action("view")).alias("x"))
    e = e.withColumn("effectiveness", F.col("x") / F.avg("x").over(W.partitionBy()))  # one row a channel
    start = spark.createDataFrame(list(_CHANNELS.items()), "channel string, weight double")
    return rounded(P.rebalanced(e.join(F.broadcast(start), "channel").select("channel", "weight", "effectiveness")))


_VIDEO = _WATCH + """, v as (select video_id, any_value(length) length, any_value(length) / count(*) shot, avg((watched >= 0.95::double * length)::int) completion, avg((watched < 0.1::double * length)::int) skips, avg(watched) / any_value(length) ratio from w group by 1),
rp as (select video_id, avg((n > 1)::int) replays from (select video_id, user_id, count(*) n from w group by 1, 2) group by 1)"""


def _videos(spark, sf):
    """A video's shot length is its length over its number of watches, as the tables have no shots."""
    w = _watches(spark, sf)
    replays = w.groupBy("video_id", "user_id").agg(F.count(F.lit(1)).alias("n")).groupBy("video_id").agg(F.avg((F.col("n") > 1).cast("int")).alias("replays"))
    v = w.groupBy("video_id").agg(
        F.first("length").alias("length"), (F.first("length") / F.count(F.lit(1))).alias("shot"), F.avg((F.col("watched") >= 0.95 * F.col("length")).cast("int")).alias("completion"),
        F.avg((F.col("watched") < 0.1 * F.col("length")).cast("int")).alias("skips"), (F.avg("watched") / F.first("length")).alias("ratio"),
    )
    return v.join(replays, "video_id")


@register("Q4_content_type", _VIDEO + f""", k(kind, a, b, c, d) as (values {", ".join(str(x) for x in P.CONTENT)}),
s as (select video_id, kind, length, shot, case when length between a and b then 0.3 else 0 end::double + case when shot between c and d then 0.3 else 0 end::double score from v, k)
select video_id, arg_max(kind, (score, kind)) kind, round(max(score), 6) confidence, any_value(length) > 600 long_form, any_value(shot) < 1 rapid_cuts, case when any_value(shot) < 1 then 'experienced_gamers' else 'all_audiences' end audience_fit from s group by 1""")
def q4(spark, sf):
    best = F.array_max(F.transform(P.content_types(F.col("length"), F.col("shot")), lambda x: F.struct(x["score"].alias("score"), x["kind"].alias("kind"))))
    rapid = F.col("shot") < 1
    v = _videos(spark, sf).withColumn("best", best)
    return v.select("video_id", F.col("best.kind").alias("kind"), r6("best.score").alias("confidence"), (F.col("length") > 600).alias("long_form"), rapid.alias("rapid_cuts"), F.when(rapid, "experienced_gamers").otherwise("all_audiences").alias("audience_fit"))


@register("Q5_media_engagement", _VIDEO + r""", t as (select doc_id video_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
r as (select video_id, case when len(w) = 0 then 0.0::double else greatest(0, least(1, 1 - (list_sum(list_transform(w, lambda x: length(x))) / len(w) - 4) / 6)) end readable from t)
select video_id, round(0.4::double * completion + 0.2::double * replays * 10 + 0.2::double * (1 - skips) + 0.2::double * ratio, 6) engagement, case when length > 120 and readable < 0.5 then 0.3 else 0.8 end::double text_alignment,
  skips > 0.3 shorten_opening, completion < 0.5 too_long from v join rp using (video_id) left join r using (video_id)""")
def q5(spark, sf):
    """A video's description is the document of its number; its readability falls with the length of its words."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    letters = F.aggregate(words, F.lit(0), lambda s, x: s + F.length(x))
    readable = F.when(F.size(words) == 0, 0.0).otherwise(X.clip(1 - (letters / F.size(words) - 4) / 6, 0.0, 1.0))
    t = views.table(spark, sf, "documents").select(F.col("doc_id").alias("video_id"), readable.alias("readable"))
    v = _videos(spark, sf).join(t, "video_id", "left")
    score = 0.4 * F.col("completion") + 0.2 * F.col("replays") * 10 + 0.2 * (1 - F.col("skips")) + 0.2 * F.col("ratio")
    return v.select("video_id", r6(score).alias("engagement"), F.when((F.col("length") > 120) & (F.col("readable") < 0.5), 0.3).otherwise(0.8).alias("text_alignment"), (F.col("skips") > 0.3).alias("shorten_opening"), (F.col("completion") < 0.5).alias("too_long"))


#: Words of business value, each worth a tenth more; the value of a dimension's tags stands in for a dictionary's field.
_VALUE_WORDS = ("high_end", "premium", "professional", "flagship", "core", "standard", "differentiation")
_VALUES = {"material": "core standard material", "finish": "premium finish, differentiation", "price": "high_end flagship premium"}
_DIMENSION_WEIGHTS = {"material": 1.2, "finish": 1.1}


def _bonus_sql() -> str:
    hits = {d: sum(w in text for w in _VALUE_WORDS) for d, text in _VALUES.items()}
    return "case dimension " + " ".join(f"when '{d}' then {1 + n / 10:.1f}" for d, n in hits.items()) + " else 1.0 end::double"


@register("K5_tag_scores", _ITEM_TAGS + f" select item_id, round(avg(case dimension when 'material' then 1.2 when 'finish' then 1.1 else 1.0 end::double * {_bonus_sql()}), 6) score from item_tags group by 1")
def k5(spark, sf):
    value = T.dictionary(spark).select("dimension").distinct().withColumn("value", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _VALUES.items() for x in kv]), F.col("dimension")), F.lit("")))
    return T.tag_scores(_item_tags(spark, sf), value, _DIMENSION_WEIGHTS, _VALUE_WORDS).withColumn("score", r6("score"))


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register("P4_recommendations", """with l as (""" + " union all ".join(f"select '{c}' feature, {c}::double x from lineitem" for c in _NUMBERS) + """ union all select 'value', value from events union all select 'n_chars', n_chars::double from documents),
m as (select feature, avg(x) m, stddev_pop(x) s, quantile_cont(x, 0.25) a, quantile_cont(x, 0.75) b, count(*) filter (where x is null) missing from l group by 1),
p as (select feature, avg((x - m) ** 3) / any_value(s) ** 3 skewness, count(*) filter (where x < a - 1.5 * (b - a) or x > b + 1.5 * (b - a)) / count(x) outlier_share, any_value(missing) missing from l join m using (feature) group by 1),
g as (select column_name, n from (select count(*) filter (where lang is null) lang, count(*) filter (where source is null) source, count(*) filter (where text is null) as text from documents) unpivot (n for column_name in (lang, source, text)))
select feature, 'CONSIDER_LOG_TRANSFORM' code from p where abs(skewness) > 2 union all select feature, 'CONSIDER_OUTLIER_TREATMENT' from p where outlier_share > 0.05 union all select feature, 'CONSIDER_IMPUTATION' from p where missing > 0
union all select column_name, 'CONSIDER_IMPUTATION' from g where n > 0""")
def p4_recommendations(spark, sf):
    """Numbers by skewness, outliers and nulls, other columns by nulls."""
    tables = (("lineitem", _NUMBERS, ()), ("events", ("value",), ()), ("documents", ("n_chars",), ("lang", "source", "text")))
    counts, missing = [], []
    for name, numbers, others in tables:
        df = views.table(spark, sf, name)
        counts.append(P.value_counts(df, numbers))
        missing.append(P.missing_counts(df, (*numbers, *others)))
    profile = reduce(DataFrame.union, missing).join(F.broadcast(P.number_profile(reduce(DataFrame.union, counts))), "feature", "left")  # one row a column
    return P.data_recommendations(profile)


@register("P5_engagement_by_type", SQL_INTERACTIONS + f" select category_id, count(*) n, round(avg({_weight('engagement')}), 6) mean_engagement from interactions group by 1")
def p5_types(spark, sf):
    it = views.interactions(spark, sf)
    return it.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(X.action_weight(F.col("action"), "engagement"))).alias("mean_engagement"))


@register("P5_segments", SQL_INTERACTIONS + f""", u as (select user_id, sum(round({_weight('engagement')} * 1e6)::bigint)::double / count(*) / 1e6::double m from interactions group by 1), o as (select m, row_number() over (order by m) - 1 i from u), c as (select count(*) n from u),
q as (select {", ".join(f"max(m) filter (where i = floor({p}::double * (n - 1))) + (max(m) filter (where i = ceil({p}::double * (n - 1))) - max(m) filter (where i = floor({p}::double * (n - 1)))) * max({p}::double * (n - 1) - floor({p}::double * (n - 1))) {x}" for p, x in ((0.2, "lo"), (0.8, "hi")))} from o, c)
select count(*) filter (where m > hi) high, count(*) filter (where m < lo) low, count(*) - count(*) filter (where m > hi) - count(*) filter (where m < lo) medium from u, q""")
def p5_segments(spark, sf):
    u = views.interactions(spark, sf).groupBy("user_id").agg(mean_exact(X.action_weight(F.col("action"), "engagement")).alias("m"))
    both = with_quantiles(u.agg(F.count(F.lit(1)).alias("_n")), u, F.col("m"), (0.2, 0.8))
    x = P.segments(u.crossJoin(F.broadcast(both)), "m", F.get("q", F.lit(0)), F.get("q", F.lit(1)))  # one row broadcast
    return x.select("high", "low", (F.col("n") - F.col("high") - F.col("low")).alias("medium"))
