"""Registered re-ranking and channel queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from recfeat import views
from recfeat.functions import exprs as X
from recfeat.functions.exprs import r6
from recfeat.operators import features as O
from recfeat.operators import recall as R
from recfeat.operators import rerank as K
from recfeat.plans.catalog import register
from recfeat.plans.features import _n, _weight
from recfeat.plans.more import _EDGE, _H
from recfeat.plans.recall import _HOT
from recfeat.views import AS_OF, SQL_AS_OF, SQL_INTERACTIONS


def _scored(spark, sf):
    it = views.interactions(spark, sf)
    return it.groupBy("user_id", "item_id", "category_id", "brand_id").agg(F.sum(X.action_weight(F.col("action"), "profile")).alias("score"))


def _walk_sql(k: int, accept: str) -> str:
    """The walk as a recursive query, one row a user and step."""
    return SQL_INTERACTIONS.replace("with ", "with recursive ", 1) + f""",
s as (select user_id, item_id, category_id, brand_id, sum({_weight('profile')}) score from interactions group by 1, 2, 3, 4),
c as (select *, row_number() over (partition by user_id order by score desc, item_id) rn from s),
w(user_id, i, kept) as (
  select distinct user_id, 0::bigint, []::struct(item_id integer, score double, category_id integer, brand_id integer)[] from c
  union all
  select w.user_id, i + 1, case when len(kept) < {k} and ({accept})
    then list_append(kept, {{'item_id': c.item_id, 'score': c.score, 'category_id': c.category_id, 'brand_id': c.brand_id}}) else kept end
  from w join c on c.user_id = w.user_id and c.rn = w.i + 1 where i < {K.CANDIDATES}),
l as (select user_id, arg_max(kept, i) kept from w group by 1), x as (select user_id, unnest(kept) r, unnest(range(1, len(kept) + 1)) rank from l)
select user_id, r.item_id item_id, r.score score, r.category_id category_id, r.brand_id brand_id, rank from x"""


_SAME = "len(list_filter(kept, lambda x: x.{0} = c.{0}))"


@register("F5_greedy_two_quotas", _walk_sql(10, f"{_SAME.format('category_id')} < 2 and {_SAME.format('brand_id')} < 3"))
def f5(spark, sf):
    return K.greedy_quota(_scored(spark, sf), 2, 3, 10)


@register("F6_spread", _walk_sql(20, f"(len(kept) = 0 or kept[len(kept)].category_id <> c.category_id) and {_SAME.format('brand_id')} < 3"))
def f6(spark, sf):
    return K.spread(_scored(spark, sf), 20)


@register("F6_half_free", _walk_sql(20, f"len(kept) < 10 or {_SAME.format('category_id')} = 0"))
def f6_half(spark, sf):
    return K.half_free(_scored(spark, sf), 20)


#: Fixed channel shares, in order.
RECALL_SHARES = {"vector_similarity": 0.4, "graph_attention": 0.25, "category_cf": 0.15, "hot_items": 0.1, "new_items": 0.05, "seasonal_items": 0.05}
NEW_USER_SHARES = {"demographic": 0.3, "popularity": 0.4, "diversity": 0.2, "category": 0.1}


def _apportion_sql(shares: dict[str, float], k: int) -> str:
    """The tail of a query over ch(user_id, item_id, score, c): channels by number."""
    table = ", ".join(f"({i}, '{name}', {int(k * share + 1e-9)})" for i, (name, share) in enumerate(shares.items()))
    return f""", places(c, channel, budget) as (values {table}),
o as (select user_id, item_id, min(c) c, arg_min(score, (c, -score)) score from ch group by 1, 2),
p as (select *, row_number() over (partition by user_id, c order by score desc, item_id) n from o),
q as (select *, n > budget spilled from p join places using (c))
select user_id, item_id, score, channel, spilled, row_number() over (partition by user_id order by spilled, c, n) rank from q
qualify row_number() over (partition by user_id order by spilled, c, n) <= {k}"""


@register("J10_multi_channel", _HOT + f""",
m as (select user_id, item_id, sum({_weight('profile')}) score from interactions group by 1, 2), qq as (select item_id, sum(score * score) q from m group by 1),
sim as (select a.item_id i, b.item_id j, round(sum(a.score * b.score) / sqrt(any_value(n1.q) * any_value(n2.q)), 6) v from m a join m b on a.user_id = b.user_id and a.item_id < b.item_id
  join qq n1 on n1.item_id = a.item_id join qq n2 on n2.item_id = b.item_id group by 1, 2 having count(*) >= 5),
near as (select * from sim union all select j, i, v from sim),
{_H.replace('h as', 'mine as')}, {_EDGE}, nb as (select *, row_number() over (partition by src order by weight desc, dst) <= 5 neighbour from f where w > 0),
pop as (select item_id, count(*) / 1000 pop from interactions group by 1),
vec as (select user_id, j item_id, max(v) score from mine join near on mine.item_id = near.i group by 1, 2),
g as (select user_id, dst item_id, round(sum(weight * case when neighbour then 1.2 else 1 end::double + case when neighbour then 0.5 * pop else 0 end::double), 6) score
  from mine join nb on mine.item_id = nb.src join pop on pop.item_id = nb.dst group by 1, 2),
graph as (select g.* from g where not exists (select 1 from mine where mine.user_id = g.user_id and mine.item_id = g.item_id)),
uc as (select user_id, category_id, count(*) n from interactions group by 1, 2 qualify row_number() over (partition by user_id order by n desc, category_id) <= 3),
ti as (select category_id, item_id, count(*) p from interactions group by 1, 2 qualify row_number() over (partition by category_id order by p desc, item_id) <= 10),
hot as (select item_id, score from h order by score desc, item_id limit 20),
age as (select item_id, count(*) n, (epoch_us({SQL_AS_OF}) - epoch_us(min(ts))) / 1e6 / 86400 age from interactions group by 1),
fresh as (select item_id, round(n * (1 + greatest(0, 1 - age / 35)), 6) score from age where age <= 35 order by score desc, item_id limit 20),
season as (select item_id, round(count(*) * 1.5::double, 6) score from interactions where category_id in (2, 5) group by 1 order by score desc, item_id limit 20),
users as (select distinct user_id from interactions),
ch as (select *, 0 c from vec union all select *, 1 from (select * from graph qualify row_number() over (partition by user_id order by score desc, item_id) <= 20)
  union all select user_id, item_id, p::double, 2 from uc join ti using (category_id) union all select user_id, item_id, score, 3 from users, hot
  union all select user_id, item_id, score, 4 from users, fresh union all select user_id, item_id, score, 5 from users, season)""" + _apportion_sql(RECALL_SHARES, 20))
def j10(spark, sf):
    """Six channels: items like the recent ones, neighbours in the graph, the user's categories, hot, new and seasonal items.
    A user without recent events has two empty channels, whose places go to the others."""
    it = views.interactions(spark, sf)
    users, k = it.select("user_id").distinct(), 20
    mine = it.filter(F.col("ts") >= O.since(AS_OF, 3 * 86_400)).select("user_id", "item_id").distinct()
    sim = O.item_similarity(O.user_item_matrix(it, AS_OF), full_norms=True)
    near = sim.select("item1", "item2", "similarity").union(sim.select("item2", "item1", "similarity"))
    vector = mine.join(near, mine.item_id == near.item1).groupBy("user_id", F.col("item2").alias("item_id")).agg(F.max("similarity").alias("score"))
    popularity = it.groupBy("item_id").agg((F.count(F.lit(1)) / 1000).alias("popularity"))
    found = [
        vector, R.neighbour_recall(mine, R.attention_edges(it, AS_OF), popularity, k), R.category_recall(it),
        *[R.grid(users, x.select("item_id", "score")) for x in (R.hot_items(it, k), R.new_items(it, AS_OF, 35, k), R.seasonal_items(it, 1, k))],
    ]
    return K.apportioned({name: (share, df) for (name, share), df in zip(RECALL_SHARES.items(), found, strict=True)}, k)


@register("O5_new_user_mix", SQL_INTERACTIONS + """,
u as (select user_id, case when min(hour(ts)) >= 18 then 1 when min(hour(ts)) >= 9 then 4 when min(hour(ts)) >= 1 then 7 end liked from interactions group by 1),
n as (select category_id, item_id, count(*)::double score, row_number() over (partition by category_id order by count(*) desc, item_id) rn from interactions group by 1, 2),
top as (select item_id, score from n order by score desc, item_id limit 10),
ch as (select user_id, item_id, score, 0 c from u join n on liked = category_id where rn <= 10 union all select user_id, item_id, score, 1 from u, top
  union all select user_id, item_id, score, 2 from u, n where rn = 1 union all select user_id, item_id, score, 3 from u, n where rn = 2)""" + _apportion_sql(NEW_USER_SHARES, 10))
def o5_mix(spark, sf):
    """New users by four strategies: the persona's category, the most popular items, the best item of each category, the second ones."""
    it = views.interactions(spark, sf)
    hour = F.col("h")
    u = it.groupBy("user_id").agg(F.min(F.hour("ts")).alias("h")).select("user_id", F.when(hour >= 18, 1).when(hour >= 9, 4).when(hour >= 1, 7).alias("liked"))
    n = it.groupBy("category_id", "item_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    best = R.top_k(n, 10, "score", "item_id", ["category_id"])
    users = u.select("user_id")
    found = [
        u.join(best, u.liked == best.category_id).select("user_id", "item_id", "score"), R.grid(users, R.top_k(n.select("item_id", "score"), 10, "score", "item_id")),
        R.grid(users, best.filter("rank = 1").select("item_id", "score")), R.grid(users, best.filter("rank = 2").select("item_id", "score")),
    ]
    return K.apportioned({name: (share, df) for (name, share), df in zip(NEW_USER_SHARES.items(), found, strict=True)}, 10)


#: Words of a source that tell an interest, and the category for it.
SOURCES = {"PS5": 3, "PS4": 5}


@register("O5_first_strategy", SQL_INTERACTIONS + f""",
u as (select user_id, min(hour(ts)) h, arg_min(platform, (ts, event_id)) source, arg_min(item_id, (ts, event_id)) filter (where action = 'click') clicked from interactions group by 1),
s as (select user_id, case when h >= 18 then 'persona' when source in ({", ".join(f"'{x}'" for x in SOURCES)}) then 'source' when clicked is not null then 'first_click' else 'popular' end strategy,
  case when h >= 18 then 1 when source = 'PS5' then 3 when source = 'PS4' then 5 else clicked % 10 end wanted from u),
n as (select category_id, item_id, count(*) n, row_number() over (partition by category_id order by count(*) desc, item_id) rn from interactions group by 1, 2)
select user_id, strategy, item_id from s join n on case when strategy = 'popular' then rn = 1 else category_id = wanted and rn <= 3 end""")
def o5_first(spark, sf):
    """One strategy a new user, the first that applies: persona, words of the source, first click, else one item a category."""
    it = views.interactions(spark, sf)
    order = F.struct("ts", "event_id")
    click = F.col("action") == "click"
    u = it.groupBy("user_id").agg(F.min(F.hour("ts")).alias("h"), F.min_by("platform", order).alias("source"), F.min_by(F.when(click, F.col("item_id")), F.when(click, order)).alias("clicked"))
    from_source = F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv]), F.col("source"))
    late = F.col("h") >= 18
    strategy = F.when(late, "persona").when(from_source.isNotNull(), "source").when(F.col("clicked").isNotNull(), "first_click").otherwise("popular")
    u = u.select("user_id", strategy.alias("strategy"), F.when(late, 1).otherwise(F.coalesce(from_source, F.col("clicked") % 10)).alias("wanted"))
    n = R.top_k(it.groupBy("category_id", "item_id").agg(F.count(F.lit(1)).alias("n")), 3, "n", "item_id", ["category_id"])
    known, unknown = u.filter("strategy <> 'popular'"), u.filter("strategy = 'popular'").select("user_id", "strategy")
    out = known.join(n, known.wanted == n.category_id).select("user_id", "strategy", "item_id")
    return out.union(R.grid(unknown, n.filter("rank = 1").select("item_id")).select("user_id", "strategy", "item_id"))
