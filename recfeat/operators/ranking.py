"""Scores and re-ranking beyond recall: pooled sequences, hybrid scores, rule-based click rates, the funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recfeat.functions.exprs import clip, sd
from recfeat.operators.quantiles import quantiles
from recfeat.operators.recall import quota, top_k

#: Rows kept after each stage of the funnel.
FUNNEL = {"recall": 10_000, "coarse": 1000, "fine": 100, "display": 20}


def click_rules(age: Column, category_match: Column, brand_match: Column, price: Column, views: Column, hour: Column, mobile: Column) -> list[tuple[str, Column]]:
    """The signed adjustments of the rule-based click rate."""
    return [
        ("young", F.when(age < 25, 0.1).otherwise(0.0)), ("older", F.when(age > 50, -0.05).otherwise(0.0)), ("category", F.when(category_match, 0.3).otherwise(0.0)), ("brand", F.when(brand_match, 0.2).otherwise(0.0)),
        ("price", F.when(price.between(200, 1000), 0.075).otherwise(0.0)), ("popular", F.when(views > 5000, 0.1).otherwise(0.0)), ("evening", F.when(hour.between(18, 22), 0.05).otherwise(0.0)), ("mobile", F.when(mobile, -0.02).otherwise(0.0)),
    ]


def click_score(rules: list[tuple[str, Column]], base: float = 0.05) -> tuple[Column, Column]:
    """The score within 0..1 and its explanation, name:adjustment for each rule that applies."""
    total = F.lit(base)
    for _, c in rules:
        total = total + c
    said = F.array(*[F.when(c != 0, F.concat_ws(":", F.lit(n), c.cast("string"))) for n, c in rules])
    return clip(total, 0.0, 1.0), F.array_join(F.array_compact(said), ",")


def funnel(candidates: DataFrame, coarse: Column, fine: Column, sizes: dict[str, int] | None = None) -> DataFrame:
    """All users at once through recall, coarse and fine ranking to the display list, with the stage each row reached."""
    n = sizes or FUNNEL
    rows = top_k(candidates, n["recall"], "score", "item_id", ["user_id"]).drop("rank").withColumn("coarse", coarse)
    w = W.partitionBy("user_id").orderBy(F.desc("coarse"), F.asc("item_id"))
    rows = rows.withColumn("coarse_rank", F.row_number().over(w)).withColumn("fine", F.when(F.col("coarse_rank") <= n["coarse"], fine))
    w = W.partitionBy("user_id").orderBy(F.col("fine").desc_nulls_last(), F.asc("item_id"))
    rows = rows.withColumn("fine_rank", F.when(F.col("fine").isNotNull(), F.row_number().over(w)))
    stage = F.when(F.col("fine_rank") <= n["display"], "display").when(F.col("fine_rank") <= n["fine"], "fine").when(F.col("coarse_rank") <= n["coarse"], "coarse").otherwise("recall")
    return rows.withColumn("stage", stage)


def interest_boost(recs: DataFrame, interest: DataFrame, weight: float = 0.1) -> DataFrame:
    """Score + weight x the user's interest in the item's category."""
    out = recs.join(interest, ["user_id", "category_id"], "left")
    return out.withColumn("score", F.col("score") + weight * F.coalesce("interest", F.lit(0.0))).drop("interest")


def retention_curve(watches: DataFrame, buckets: int = 20) -> DataFrame:
    """Q2: the share of watches still running at each twentieth of the video, and drops of more than a tenth."""
    long = watches.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    out = long.groupBy("video_id", "bucket").agg(F.avg((F.col("watched") >= F.col("bucket") / buckets * F.col("length")).cast("int")).alias("retention"))
    before = F.lag("retention").over(W.partitionBy("video_id").orderBy("bucket"))
    drop = before - F.col("retention")
    return out.withColumn("drop", F.coalesce(drop, F.lit(0.0))).withColumn("major", (F.col("drop") > 0.1) | F.coalesce(sd(drop, before) > 0.2, F.lit(False)))


def watch_patterns(watches: DataFrame) -> DataFrame:
    """Q1, Q3: mean and median watch time, completion, replay rate and engagement score of each video."""
    users = watches.groupBy("video_id", "user_id").agg(F.count(F.lit(1)).alias("n"))
    replay = users.groupBy("video_id").agg(F.avg((F.col("n") > 1).cast("int")).alias("replay_rate"))
    out = watches.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("watches"), F.avg("watched").alias("mean_watched"), 
        F.avg((F.col("watched") >= 0.95 * F.col("length")).cast("int")).alias("completion"), F.avg(F.least(F.lit(1.0), F.col("watched") / F.col("length"))).alias("watch_ratio"), F.max("length").alias("length"),
    ).join(replay, "video_id").join(quantiles(watches, F.col("watched"), (0.5,), ("video_id",)).select("video_id", F.get("q", F.lit(0)).alias("median_watched")), "video_id", "left")
    score = F.least(F.lit(1.0), 0.4 * F.col("completion") + 0.3 * F.least(2 * F.col("replay_rate"), F.lit(1.0)) + 0.3 * F.col("watch_ratio"))
    kind = F.when(F.col("length") <= 15, "micro").when(F.col("length") <= 60, "short").when(F.col("length") <= 180, "medium").when(F.col("length") <= 600, "long").otherwise("extended")
    return out.withColumns({"engagement": score, "category": kind})


def coarse_rank(candidates: DataFrame, recall: Column, ctr: Column, floor: float = 0.001, per_category: int = 200, k: int = 1000) -> DataFrame:
    """.3 recall + .7 click rate, at least ``floor``; at most ``per_category`` of a category and ``k`` a user."""
    rows = candidates.withColumn("score", F.round(0.3 * recall + 0.7 * ctr, 6)).filter(F.col("score") >= floor)
    return quota(rows, per_category, k, ["user_id"])


def video_preference(same_length: Column, liked: Column, genres: Column, cares: Column, quality: Column, same_platform: Column) -> Column:
    """.3 for the preferred length, .4 x the share of liked genres, .2 x quality for who cares, .1 for the platform."""
    shared = F.size(F.array_intersect(liked, genres)) / F.size(liked)
    score = F.when(same_length, 0.3).otherwise(0.0) + 0.4 * F.when(F.size(liked) > 0, shared).otherwise(0.0)
    return F.least(F.lit(1.0), score + F.when(cares, 0.2 * quality).otherwise(0.0) + F.when(same_platform, 0.1).otherwise(0.0))
