"""Feature store: registry, long form, latest values with freshness, fusion; business rules compiled to columns."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recfeat.functions.exprs import sd
from recfeat.functions.sized import small


def to_long(wide: DataFrame, entity: str, at: str, source: str, registry: list[str] | None = None) -> DataFrame:
    """(entity_id, feature, value, at, source); features outside the registry are dropped."""
    names = [c for c in wide.columns if c not in (entity, at) and (registry is None or c in registry)]
    cols = [F.col(c).cast("double").alias(c) for c in names]
    long = wide.select(F.col(entity).alias("entity_id"), F.col(at).alias("at"), *cols).unpivot(["entity_id", "at"], names, "feature", "value")
    return long.withColumn("source", F.lit(source))


def latest(long: DataFrame, registry: DataFrame, now_s: int) -> DataFrame:
    """The newest value of each (entity, feature), or the feature's default once it is older than its ttl."""
    last = long.groupBy("entity_id", "feature").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    out = last.join(small(registry), "feature")
    stale = F.lit(now_s) - F.col("at") > F.col("ttl")
    return out.select("entity_id", "feature", F.when(stale, F.col("default")).otherwise(F.col("value")).alias("value"), stale.alias("stale"))


def fuse(offline: Column, offline_age: Column, live: Column, live_age: Column, how: str = "latest") -> Column:
    """Two values of a feature as one, by the strategy named in FUSIONS."""
    return FUSIONS[how](offline, offline_age, live, live_age)


def _latest(offline: Column, offline_age: Column, live: Column, live_age: Column) -> Column:
    """The fresher value; either one where the other is missing."""
    return F.when(live.isNotNull() & (live_age <= offline_age), live).otherwise(F.coalesce(offline, live))


def _by_age(offline: Column, offline_age: Column, live: Column, live_age: Column) -> Column:
    """Weighted by exp(-age / 3600) and exp(-age / 300); the weights' ratio stays finite at any age."""
    share = 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), live_age / 300 - offline_age / 3600))))
    return F.coalesce(offline + (live - offline) * share, offline, live)


def _by_confidence(offline: Column, offline_confidence: Column, live: Column, live_confidence: Column) -> Column:
    """Weighted by confidence in place of age; the offline value without any."""
    total = offline_confidence + live_confidence
    return F.when(total > 0, (offline * offline_confidence + live * live_confidence) / total).otherwise(offline)


#: S3: ways to fuse two values, by name; a caller may add its own.
FUSIONS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {"latest": _latest, "weighted": _by_age, "confidence": _by_confidence}


def freshness(long: DataFrame, now_s: int) -> DataFrame:
    """Rows by source and age class."""
    age = F.lit(now_s) - F.col("at")
    kind = F.when(age < 300, "under_5m").when(age < 3600, "under_1h").when(age < 86_400, "under_1d").otherwise("older")
    return long.groupBy("source", kind.alias("age_class")).agg(F.count(F.lit(1)).alias("n"))


def compile_rule(condition: dict) -> Column:
    """O1: a condition document as a Column; a missing field meets no condition.

    Fields are joined by AND; operators are $gt, $gte, $lt, $lte, $eq, $ne, $in, $not_in, $contains, $not_contains and
    $between.  A right side written as "$name" is a column.
    """
    out = F.lit(True)
    for field, spec in condition.items():
        c = F.col(field)
        for op, raw in (spec if isinstance(spec, dict) else {"$eq": spec}).items():
            v = F.col(raw[1:]) if isinstance(raw, str) and raw.startswith("$") else raw
            made = {
                "$gt": lambda: c > v, "$gte": lambda: c >= v, "$lt": lambda: c < v, "$lte": lambda: c <= v, "$eq": lambda: c == v, "$ne": lambda: c != v,
                "$in": lambda: c.isin(list(v)), "$not_in": lambda: ~c.isin(list(v)), "$contains": lambda: F.array_contains(c, v), "$not_contains": lambda: ~F.array_contains(c, v),
                "$between": lambda: c.between(v[0], v[1]),
            }
            if op not in made:
                raise ValueError(f"unknown operator {op}")
            out = out & F.coalesce(made[op](), F.lit(False))
    return out


def apply_rules(recs: DataFrame, rules: list[dict]) -> DataFrame:
    """O2: rules by falling priority; the first exclusion drops the row, boosts and penalties multiply its score.

    ``rules`` have rule_id, priority, condition and action {"type": "exclude"} or {"type": "boost", "factor": x}.
    The result keeps excluded rows with ``excluded_by``; ``applied`` names the rules that changed the score.
    """
    factor, applied, excluded = F.lit(1.0), [], F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-r["priority"], r["rule_id"])):
        hit = compile_rule(rule["condition"]) & excluded.isNull()
        if rule["action"]["type"] == "exclude":
            excluded = F.coalesce(excluded, F.when(compile_rule(rule["condition"]), F.lit(rule["rule_id"])))
        else:
            factor = factor * F.when(hit, F.lit(float(rule["action"]["factor"]))).otherwise(1.0)
            applied.append(F.when(hit, F.lit(rule["rule_id"])))
    return recs.withColumns({"score": F.col("score") * factor, "excluded_by": excluded, "applied": F.array_join(F.array_compact(F.array(*applied)), ",") if applied else F.lit("")})


def rule_statistics(applied: DataFrame) -> DataFrame:
    """O3: rows each rule blocked or boosted."""
    blocked = applied.filter("excluded_by is not null").groupBy(F.col("excluded_by").alias("rule_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("blocked"))
    boosted = applied.filter("applied <> ''").select(F.explode(F.split("applied", ",")).alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("boosted"))
    return blocked.unionByName(boosted)


def epoch(at: datetime) -> int:
    from datetime import UTC

    return int(at.replace(tzinfo=UTC).timestamp())


def hybrid_features(recent: Column, month: Column, recent_engagement: Column, mean_engagement: Column, hour: Column) -> list[Column]:
    """Events of 300 s against the month's mean of 300 s, engagement against its mean, and a factor for the hour."""
    ratio = F.when(month > 0, recent / (month / 8640)).when(recent > 0, 1.0).otherwise(0.0)
    factor = F.when(hour.between(18, 22), 1.2).when(hour.between(2, 6), 0.8).otherwise(1.0)
    return [
        F.round(ratio, 6).alias("activity_trend_ratio"), F.round(F.when(mean_engagement > 0, recent_engagement / mean_engagement).otherwise(1.0), 6).alias("engagement_acceleration"),
        factor.alias("time_context_multiplier"),
    ]
