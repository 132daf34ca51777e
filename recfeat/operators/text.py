"""Text feedback: keywords, lexicon sentiment, quality, topics and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed word lists of this library.
POSITIVE = ["good", "great", "love", "nice", "fast", "happy", "best", "thanks"]
NEGATIVE = ["bad", "slow", "hate", "poor", "broken", "sad", "worst", "idiot", "trash", "stupid"]
STOP = ["that", "this", "with", "from", "have", "were", "will", "your", "they", "them"]
TOPICS = [("quality", "good"), ("quality", "poor"), ("speed", "fast"), ("speed", "slow"), ("abuse", "idiot"), ("abuse", "trash"), ("abuse", "stupid")]


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+"), lambda w: w != "")


def keywords(text: Column, least: int = 4) -> Column:
    """M1: distinct words of ``least`` letters or more that are no stop words, in order."""
    stop = F.array(*[F.lit(w) for w in STOP])
    return F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) >= least) & ~F.array_contains(stop, w)))


def sentiment(text: Column) -> Column:
    """M2: (positive - negative) / (positive + negative), 0 without either."""
    of = lambda words: F.size(F.filter(tokens(text), lambda w: w.isin(words)))
    p, n = of(POSITIVE), of(NEGATIVE)
    return F.when(p + n == 0, 0.0).otherwise((p - n) / (p + n))


def sentiment_class(score: Column) -> Column:
    return F.when(score > 0.5, "very_positive").when(score > 0, "positive").when(score == 0, "neutral").when(score >= -0.5, "negative").otherwise("very_negative")


def class_distribution(scored: DataFrame) -> DataFrame:
    """M4: classes with counts and shares, and the weighted overall score in each row."""
    from pyspark.sql.window import Window as W

    whole = W.partitionBy()
    out = scored.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("class") == "very_positive", 1.0).when(F.col("class") == "positive", 0.5).when(F.col("class") == "neutral", 0.0).when(F.col("class") == "negative", -0.5).otherwise(-1.0)
    return out.select("class", "n", (F.col("n") / F.sum("n").over(whole)).alias("share"), (F.sum(F.col("n") * value).over(whole) / F.sum("n").over(whole)).alias("overall"))


def upgraded_class(score: Column, rating: Column) -> Column:
    """M3: the text's class; a neutral text takes the class of its rating, where there is one."""
    rated = F.when(rating >= 4.5, "very_positive").when(rating >= 3.5, "positive").when(rating >= 2.5, "neutral").when(rating >= 1.5, "negative").otherwise("very_negative")
    return F.when((score == 0) & rating.isNotNull(), rated).otherwise(sentiment_class(score))


def explicit_feedback(events: DataFrame, by: str) -> DataFrame:
    """M5: ratings (count, mean, deviation, distribution) and likes of events (``by``, rating, liked), nulls for none."""
    likes, dislikes, some = F.count(F.when(F.col("liked"), 1)), F.count(F.when(~F.col("liked"), 1)), F.count("liked")
    return events.groupBy(by).agg(
        F.count("rating").alias("ratings"), F.round(F.avg("rating"), 6).alias("mean_rating"), F.round(F.stddev_pop("rating"), 6).alias("std_rating"),
        *[F.count(F.when(F.col("rating") == i, 1)).alias(f"rated_{i}") for i in range(1, 6)], likes.alias("likes"), dislikes.alias("dislikes"),
        F.round(likes / F.greatest(some, F.lit(1)), 6).alias("like_ratio"), F.round(some / F.count(F.lit(1)), 6).alias("engagement_ratio"),
    )
