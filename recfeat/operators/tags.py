"""Tags: automatic tagging, tag statistics, user tag profiles with decay, hierarchy and relationship checks.

The dictionary is the library's own small relation; a deployment passes its tables with the same columns.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recfeat.functions.exprs import action_weight, decay, seconds_between
from recfeat.functions.sized import listed, small, tasks

# Fixed dictionary: tag, dimension, parent, keyword (of the item's category), least and most price.
DICTIONARY = [
    ("metal", "material", None, None, None, None), ("steel", "material", "metal", "STEEL", None, None), ("copper", "material", "metal", "COPPER", None, None),
    ("brass", "material", "metal", "BRASS", None, None), ("nickel", "material", "metal", "NICKEL", None, None), ("tin", "material", "metal", "TIN", None, None),
    ("coated", "finish", None, None, None, None), ("plated", "finish", "coated", "PLATED", None, None), ("anodized", "finish", "coated", "ANODIZED", None, None),
    ("polished", "finish", None, "POLISHED", None, None), ("brushed", "finish", None, "BRUSHED", None, None), ("cheap", "price", None, None, 0.0, 1200.0), ("dear", "price", None, None, 1200.0, 1e9),
]
EXCLUSIVE = [("cheap", "dear"), ("plated", "polished")]


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DICTIONARY, "tag string, dimension string, parent string, keyword string, low double, high double")


def auto_tag(items: DataFrame, tags: DataFrame, most: int = 10_000) -> DataFrame:
    """K1: distinct (item_id, tag) by keyword in the category or price range; at most ``most`` tags, more raise."""
    rule = F.col("category").contains(F.col("keyword")) | ((F.col("price") >= F.col("low")) & (F.col("price") < F.col("high")))
    return items.join(listed(tags, "tags", most), rule).select("item_id", "tag", "dimension").distinct()


def closure(tags: DataFrame) -> DataFrame:
    """(tag, ancestor, distance) over all levels.  The dictionary is small by nature; a tag that is its own ancestor
    is a mistake in it and raises."""
    step = tags.select("tag", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).filter("ancestor is not null")
    parents = tags.select(F.col("tag").alias("ancestor"), "parent").filter("parent is not null")
    out, at, depth = step, step, 1
    while not (at := at.join(parents, "ancestor").select("tag", F.col("parent").alias("ancestor"), F.lit(depth + 1).alias("distance"))).isEmpty():
        if not at.filter("tag = ancestor").isEmpty():
            raise ValueError("a tag is its own ancestor")
        out, depth = out.unionByName(at), depth + 1
    return out


def related(tags: DataFrame) -> DataFrame:
    """(tag, other): the siblings and the children of a tag."""
    own = tags.filter("parent is not null")
    siblings = own.select("tag", "parent").join(own.select(F.col("tag").alias("other"), "parent"), "parent").filter("tag <> other").select("tag", "other")
    return siblings.union(own.select(F.col("parent").alias("tag"), F.col("tag").alias("other"))).distinct()


def with_related(interest: DataFrame, propagated: DataFrame, relations: DataFrame, part: float = 0.02) -> DataFrame:
    """``propagated`` (user_id, tag, interest) plus ``part`` of each interest for its siblings and children that the
    user's profile holds already."""
    more = interest.join(small(relations), "tag").select("user_id", F.col("other").alias("tag"), (part * F.col("interest")).alias("more"))
    more = more.groupBy("user_id", "tag").agg(F.sum("more").alias("more"))
    return propagated.join(more, ["user_id", "tag"], "left").select("user_id", "tag", F.round(F.col("interest") + F.coalesce("more", F.lit(0.0)), 3).alias("interest"))


def implied_tags(item_tags: DataFrame, tree: DataFrame) -> DataFrame:
    """(item_id, tag) that follow from an item's tags by the hierarchy and that it lacks."""
    up = item_tags.join(small(tree), "tag").select("item_id", F.col("ancestor").alias("tag")).distinct()
    return up.join(item_tags.select("item_id", "tag"), ["item_id", "tag"], "left_anti")


def missing_dependencies(item_tags: DataFrame, tree: DataFrame, requires: DataFrame) -> DataFrame:
    """(item_id, tag, needs): tags that ask for another one, (tag, needs), which the item has neither itself nor by
    the hierarchy."""
    held = item_tags.select("item_id", "tag").union(item_tags.join(small(tree), "tag").select("item_id", "ancestor"))
    asked = item_tags.select("item_id", "tag").join(small(requires), "tag")
    return asked.join(held.toDF("item_id", "needs").distinct(), ["item_id", "needs"], "left_anti").select("item_id", "tag", "needs")


def keyword_tags(items: DataFrame, templates: DataFrame, most: int = 10_000) -> DataFrame:
    """K2: (item_id, tag, confidence, source): keywords of ``templates`` (tag, own) found in title or category, .8 for tags
    of the item's own kind and .6 for common ones, and rule tags by price (.9) and model (.95); at most ``most`` templates, more raise."""
    text = F.lower(F.concat_ws(" ", "title", "category"))
    found = items.join(listed(templates, "templates", most), text.contains(F.replace("tag", F.lit("_"), F.lit(" "))) | text.contains(F.col("tag")))
    found = found.select("item_id", "tag", F.when(F.col("own"), 0.8).otherwise(0.6).alias("confidence"), F.lit("keyword").alias("source"))
    price = F.when(F.col("price") > 1500, F.array(F.lit("premium"), F.lit("high_end"))).when(F.col("price") > 500, F.array(F.lit("mid_range"))).otherwise(F.array(F.lit("budget")))
    rules = items.select("item_id", F.explode(price).alias("tag"), F.lit(0.9).alias("confidence"), F.lit("rule").alias("source"))
    model = items.filter(text.contains("anodized")).select("item_id", F.lit("professional").alias("tag"), F.lit(0.95).alias("confidence"), F.lit("rule").alias("source"))
    return found.unionByName(rules).unionByName(model)


def top_interests(interest: DataFrame, context: DataFrame, k: int = 20, least: float = 0.01) -> DataFrame:
    """The ``k`` strongest interests of a user after the boosts of ``context`` (user_id, tag, recent, engagement,
    categories, purchases): 1.5 for a recent interaction, 1.3 for engagement above .8, 1.2 for several categories and
    .1 for each purchase up to .5."""
    boost = F.when(F.col("recent"), 1.5).otherwise(1.0) * F.when(F.col("engagement") > 0.8, 1.3).otherwise(1.0) * F.when(F.col("categories") > 1, 1.2).otherwise(1.0)
    boost = boost * (1 + F.least(0.1 * F.col("purchases"), F.lit(0.5)))
    out = interest.join(context, ["user_id", "tag"]).withColumn("score", F.round(F.col("interest") * boost, 6)).filter(F.col("score") >= least)
    w = W.partitionBy("user_id").orderBy(F.desc("score"), F.asc("tag"))
    return out.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("user_id", "tag", "score", "rank")


def cooccurrence(item_tags: DataFrame) -> DataFrame:
    """K9: items by ordered tag pair."""
    a, b = item_tags.select("item_id", F.col("tag").alias("tag1")), item_tags.select("item_id", F.col("tag").alias("tag2"))
    return a.join(b, "item_id").filter("tag1 < tag2").groupBy("tag1", "tag2").agg(F.count(F.lit(1)).alias("items"))


def similar_items(similar: DataFrame, members: DataFrame, users: int, items: int, side: int = 2500, run: int = 1000) -> DataFrame:
    """K8: (user_id, item_id, similarity) from the similarities with classes of items (user_id, class_id, n, similarity) and
    the classes' members (item_id, class_id, n), ``n`` of them in the class; ``users`` and ``items`` are counted.

    The rows are users times items, few classes or one may have them all, and their inputs are small: a class is therefore
    cut into blocks of about ``side`` users and items, a join key each, and as many tasks take them as the rows ask for.  With
    the rows the blocks grow, to some thousands, so that what is shuffled grows with users and items.  Ids travel in lists of about
    ``run``; the merge join meets a user with all its lists in turn and holds one user's rows of a block at a time.
    """
    side = max(side, isqrt(users * items // 4000))
    parts, dealt = tasks(users, side), tasks(users * items, side * side)
    block = lambda c: F.floor(c * run / side).cast("int")
    runs = F.ceil(F.col("n") / run)
    ids = members.withColumn("_r", F.pmod(F.xxhash64("item_id"), runs)).groupBy("class_id", "_r").agg(F.collect_list("item_id").alias("_ids"))
    # Both sides are dealt before they are copied for the other's blocks, as the copies are many times as large.
    ids = ids.repartition(tasks(items * parts, 2_500_000), "class_id", "_r").select("class_id", block(F.col("_r")).alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_p"), "_ids")
    who = similar.repartition(tasks(users * tasks(items, side), 1_000_000), "user_id").select("user_id", "similarity", "class_id", F.explode(F.sequence(F.lit(0), block(runs - 1))).alias("_b"), F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int").alias("_p"))
    keys = ["class_id", "_b", "_p"]
    return who.repartition(dealt, *keys).hint("merge").join(ids.repartition(dealt, *keys), keys).select("user_id", F.explode("_ids").alias("item_id"), "similarity")


def exclusivity(item_tags: DataFrame, spark: SparkSession) -> DataFrame:
    """Items that carry both tags of an exclusive pair."""
    pairs = F.broadcast(spark.createDataFrame(EXCLUSIVE, "tag1 string, tag2 string"))
    a, b = item_tags.select("item_id", F.col("tag").alias("tag1")), item_tags.select("item_id", F.col("tag").alias("tag2"))
    return a.join(pairs, "tag1").join(b, ["item_id", "tag2"]).select("item_id", "tag1", "tag2")


def user_tag_counts(interactions: DataFrame, item_tags: DataFrame, as_of, windows: dict[str, int]) -> DataFrame:
    """A user's tag interactions by window, and the weighted mean preference."""
    age = seconds_between(F.lit(as_of).cast("timestamp"), F.col("ts"))
    joined = interactions.join(item_tags.select("item_id", "tag"), "item_id")
    return joined.groupBy("user_id", "tag").agg(
        *[F.count(F.when(age <= s, 1)).alias(f"n_{w}") for w, s in windows.items()], F.count(F.lit(1)).alias("n"), F.avg(action_weight(F.col("action"), "tag")).alias("preference"),
    )


def trending_tags(counts: DataFrame) -> DataFrame:
    """Up if the last week's pace is 1.2 times the month's, down if below .8."""
    pace = (F.col("n_7d") / 7) / (F.col("n_30d") / 30)
    return counts.filter("n_30d > 0").select("user_id", "tag", F.when(pace > 1.2, "up").when(pace < 0.8, "down").otherwise("steady").alias("trend"))


def decayed_interest(interactions: DataFrame, item_tags: DataFrame, as_of, rate: float = 0.1, cap: float = 10.0, lifetime_days: int = 90, least: float = 0.01, k: int = 100) -> DataFrame:
    """Summed weights with exponential decay, capped, with half the strength passed on to each parent level
    by the caller's closure; old and weak tags go and each user keeps the ``k`` strongest."""
    days = seconds_between(F.lit(as_of).cast("timestamp"), F.col("ts")) / 86_400
    joined = interactions.join(item_tags.select("item_id", "tag"), "item_id").withColumn("days", days).filter(F.col("days") <= lifetime_days)
    out = joined.groupBy("user_id", "tag").agg(F.least(F.lit(cap), F.sum(0.1 * action_weight(F.col("action"), "tag") * decay(F.col("days"), "exponential", rate))).alias("interest")).filter(F.col("interest") >= least)
    out = out.withColumn("interest", F.round("interest", 6))
    w = W.partitionBy("user_id").orderBy(F.desc("interest"), F.asc("tag"))
    return out.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def with_ancestors(interest: DataFrame, tree: DataFrame) -> DataFrame:
    """Interest of a tag plus half of each level's below it."""
    up = interest.join(small(tree), "tag").select("user_id", F.col("ancestor").alias("tag"), (F.col("interest") * F.pow(F.lit(0.5), F.col("distance"))).alias("interest"))
    return interest.select("user_id", "tag", "interest").unionByName(up).groupBy("user_id", "tag").agg(F.round(F.sum("interest"), 3).alias("interest"))


def tag_scores(item_tags: DataFrame, values: DataFrame, weights: dict[str, float], words: tuple[str, ...]) -> DataFrame:
    """K5: the mean over an item's tags of the weight of the dimension (1 where none is given), raised by a tenth for each of
    ``words`` in the dimension's business ``value`` (dimension, value: one row a dimension)."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("dimension")), F.lit(1.0))
    bonus = 1 + sum((F.when(F.lower("value").contains(w), 0.1).otherwise(0.0) for w in words), F.lit(0.0))
    rows = item_tags.join(small(values), "dimension", "left").withColumn("value", F.coalesce("value", F.lit("")))
    return rows.groupBy("item_id").agg(F.avg(weight * bonus).alias("score"))
