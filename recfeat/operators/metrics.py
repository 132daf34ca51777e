"""Ranking metrics, online metrics, experiment statistics, revenue and profiling."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recfeat.functions.exprs import count_if, m1, normal_cdf, sd
from recfeat.operators.quantiles import quantiles


def ranking_metrics(recs: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """Precision, recall, F1, NDCG, average precision, reciprocal rank and hit per user and k.

    ``recs`` has (user_id, item_id, rank from 1), ``truth`` (user_id, item_id).  Precision divides by
    min(k, list length), average precision by min(truths, k).
    """
    hits = recs.join(truth.select("user_id", "item_id").distinct().withColumn("hit", F.lit(1)), ["user_id", "item_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    w = W.partitionBy("user_id").orderBy("rank")
    hits = hits.withColumn("found", F.sum("hit").over(w.rowsBetween(W.unboundedPreceding, 0)))
    n_truth = truth.select("user_id", "item_id").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("n_truth"))
    long = hits.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("rank <= k")
    gain = 1 / F.log2(F.col("rank") + 1.0)
    per = long.groupBy("user_id", "k").agg(
        F.count(F.lit(1)).alias("listed"), F.sum("hit").alias("hits"), F.sum(F.col("hit") * gain).alias("dcg"),
        F.sum(F.col("hit") * F.col("found") / F.col("rank")).alias("ap_sum"), F.max(F.when(F.col("hit") == 1, 1.0 / F.col("rank"))).alias("rr"),
    ).join(n_truth, "user_id", "left").withColumn("n_truth", F.coalesce("n_truth", F.lit(0)))
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n_truth", "k")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    p, r = sd(F.col("hits"), F.least("listed", "k")), sd(F.col("hits"), F.col("n_truth"))
    return per.select(
        "user_id", F.col("k").cast("long").alias("k"), p.alias("precision"), r.alias("recall"), sd(2 * p * r, p + r).alias("f1"),
        F.when(F.col("n_truth") == 0, 0.0).otherwise(F.col("dcg") / best).alias("ndcg"), sd(F.col("ap_sum"), F.least("n_truth", "k")).alias("ap"),
        F.coalesce("rr", F.lit(0.0)).alias("rr"), (F.col("hits") > 0).cast("int").cast("long").alias("hit"),
    )


def ranking_report(per_user: DataFrame) -> DataFrame:
    """Means over users by k."""
    return per_user.groupBy("k").agg(*[F.avg(c).alias(n) for c, n in (("precision", "precision"), ("recall", "recall"), ("f1", "f1"), ("ndcg", "ndcg"), ("ap", "map"), ("rr", "mrr"), ("hit", "hit_rate"))], F.count(F.lit(1)).alias("users"))


def auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Mann-Whitney AUC of scores within 0..1, ties one half.  Rows are first summed by score; ranks run inside a
    thousand bins of scores, and over the bins' totals."""
    by = scored.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("n"))
    binned = by.withColumn("bin", F.floor(F.col("s") * 1000))
    below = binned.groupBy("bin").agg(F.sum("n").alias("n_bin"))
    w = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    below = below.withColumn("before", F.coalesce(F.sum("n_bin").over(w), F.lit(0)))
    inside = W.partitionBy("bin").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    ranked = binned.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(below), "bin")
    out = ranked.agg(F.sum(F.col("p") * (F.col("before") + F.col("within") + F.col("n") / 2)).alias("u"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    return out.select("positives", "negatives", sd(F.col("u"), F.col("positives") * F.col("negatives")).alias("auc"))


def engagement_rates(interactions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Click, view, cart and purchase rates, users, actions a user."""
    n = {a: count_if(F.col("action") == a).alias(a) for a in ("impression", "click", "view", "add_cart", "purchase")}
    out = interactions.groupBy(*(by or [])).agg(*n.values(), F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"))
    c = F.col
    return out.withColumns({
        "ctr": m1(c("click"), c("impression")), "view_rate": m1(c("view"), c("click")), "cart_rate": m1(c("add_cart"), c("view")), "purchase_rate": m1(c("purchase"), c("add_cart")),
        "end_to_end": m1(c("purchase"), c("impression")), "actions_per_user": m1(c("events"), c("users")),
    })


def wilson(successes: Column, trials: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """The Wilson interval; (0, 0) without trials."""
    p = successes / trials
    middle = (p + z * z / (2 * trials)) / (1 + z * z / trials)
    half = z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials)) / (1 + z * z / trials)
    return F.when(trials == 0, 0.0).otherwise(F.greatest(F.lit(0.0), middle - half)), F.when(trials == 0, 0.0).otherwise(F.least(F.lit(1.0), middle + half))


def z_test(c1: Column, n1: Column, c2: Column, n2: Column) -> dict[str, Column]:
    """Two-proportion z-test of group 2 against group 1, effect size by the arcsine transform."""
    p1, p2, p = c1 / n1, c2 / n2, (c1 + c2) / (n1 + n2)
    se = F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    z = sd(p2 - p1, se)
    return {
        "z": z, "p_value": 2 * (1 - normal_cdf(F.abs(z))), "lift": sd(p2 - p1, p1), "ci_low": p2 - p1 - 1.96 * se, "ci_high": p2 - p1 + 1.96 * se,
        "effect": 2 * (F.asin(F.sqrt(p2)) - F.asin(F.sqrt(p1))),
    }


def t_two_sided(t: Column, df: Column, steps: int = 2000) -> Column:
    """The two-sided p-value of Student's t: with x = sqrt(df) tan(u) the density is cos(u) ** (df - 1), integrated over
    u by Simpson's rule from |t|'s place to where nothing is left."""
    end = F.least(F.lit(pi / 2), 40 / F.sqrt(df))
    area = lambda lo, hi: (hi - lo) / steps * F.aggregate(
        F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0),
        lambda acc, i: acc + F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0) * F.pow(F.greatest(F.lit(0.0), F.cos(lo + (hi - lo) * i / steps)), df - 1),
    )
    at = F.least(end, F.atan(F.abs(t) / F.sqrt(df)))
    return area(at, end) / area(F.lit(0.0), end)


def welch(m1_: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> dict[str, Column]:
    """Welch's t, degrees of freedom, the p-value of Student's distribution, Cohen's d from population variances."""
    s1, s2 = v1 * n1 / (n1 - 1), v2 * n2 / (n2 - 1)
    a, b = s1 / n1, s2 / n2
    t = (m2 - m1_) / F.sqrt(a + b)
    df = (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1))
    return {"t": t, "df": df, "p_value": t_two_sided(t, df), "cohens_d": (m2 - m1_) / F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))}


def diversity(counts: DataFrame, n: str = "n") -> DataFrame:
    """Simpson, Shannon and Gini of a count table (one row a value).

    Values with one count have one rank sum, so only the distinct counts are ordered, and there are few of them.
    """
    by = counts.groupBy(F.col(n).alias("n")).agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(W.orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = F.col("m") * before + F.col("m") * (F.col("m") + 1) / 2
    total = by.agg(F.sum(F.col("n") * F.col("m")).alias("total"))
    p = F.col("n") / F.col("total")
    x = by.withColumn("ranks", ranks).crossJoin(F.broadcast(total))  # one row broadcast
    out = x.agg(F.sum("m").alias("values"), (1 - F.sum(F.col("m") * p * p)).alias("simpson"), (-F.sum(F.col("m") * p * F.log(p))).alias("shannon"), F.sum(F.col("ranks") * F.col("n")).alias("ix"), F.max("total").alias("sx"))
    gini = 2 * F.col("ix") / (F.col("values") * F.col("sx")) - (F.col("values") + 1) / F.col("values")
    return out.select("values", "simpson", "shannon", gini.alias("gini"))


def funnel(interactions: DataFrame) -> DataFrame:
    """Users by stage, rates between stages, and the weakest step."""
    stages = ["impression", "click", "view", "add_cart", "purchase"]
    out = interactions.agg(*[F.countDistinct(F.when(F.col("action") == s, F.col("user_id"))).alias(s) for s in stages])
    steps = list(zip(stages, stages[1:], strict=False))
    drops = F.array(*[F.struct((1 - sd(F.col(b), F.col(a))).alias("drop"), F.lit(f"{a}->{b}").alias("step")) for a, b in steps])
    worst = F.array_max(drops)
    return out.select(*stages, *[sd(F.col(b), F.col(a)).alias(f"rate_{b}") for a, b in steps], worst["step"].alias("bottleneck"), worst["drop"].alias("drop_off"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, nulls, moments with sample-corrected skewness and kurtosis, quartiles, outliers by 1.5 IQR."""
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        parts.append(df.select(F.lit(c).alias("column"), x.alias("x")))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    stats = long.groupBy("column").agg(
        F.count("x").alias("n"), count_if(F.col("x").isNull()).alias("nulls"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"),
        F.min("x").alias("min"), F.max("x").alias("max"),
    ).join(quantiles(long, F.col("x"), (0.25, 0.5, 0.75), ("column",)), "column", "left")
    n = F.col("n").cast("double")
    stats = stats.select(
        "column", "n", "nulls", "mean", "std", "min", F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q75"), "max",
        (F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"), ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurtosis"),
    )
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    bounds = stats.select("column", (F.col("q25") - reach).alias("lo"), (F.col("q75") + reach).alias("hi"))
    far = long.join(F.broadcast(bounds), "column").groupBy("column").agg(count_if((F.col("x") < F.col("lo")) | (F.col("x") > F.col("hi"))).alias("outliers"))
    return stats.join(far, "column")
