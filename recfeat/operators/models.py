"""Training sets and fitted models with pyspark.ml: feature assembly, CTR models, matrix factorisation, importance."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import FMClassifier, LogisticRegression
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recfeat.functions.exprs import action_weight
from recfeat.functions.sized import tasks


def training_rows(interactions: DataFrame) -> DataFrame:
    """One row an interaction with the label and plain features; later events give no features to earlier ones."""
    label = F.when(F.col("action").isin("purchase", "like"), 1.0).otherwise(0.0)
    return interactions.select("event_id", "ts", label.alias("label"), "user_id", "item_id", "category_id", "brand_id", "platform", F.hour("ts").alias("hour"), F.log1p("price").alias("log_price"))


def ctr_model(rows: DataFrame, kind: str = "logistic", buckets: int = 1 << 14, seed: int = 7) -> PipelineModel:
    """Factorisation machine or logistic regression over hashed categories and numbers.

    A price of 0 is hashed to a stored zero, which the factorisation machine's gradient can't take; the assembler keeps what isn't zero.
    """
    hasher = FeatureHasher(inputCols=["user_id", "item_id", "category_id", "brand_id", "platform", "hour", "log_price"], outputCol="hashed", numFeatures=buckets, categoricalCols=["user_id", "item_id", "category_id", "brand_id", "hour"])
    model = FMClassifier(factorSize=4, maxIter=20, stepSize=0.05, seed=seed) if kind == "fm" else LogisticRegression(maxIter=20, regParam=0.01)
    return Pipeline(stages=[hasher, VectorAssembler(inputCols=["hashed"], outputCol="features"), model]).fit(rows)


def factorise(interactions: DataFrame, rank: int = 8, seed: int = 7) -> ALSModel:
    """Implicit-preference factorisation of summed weights, refitted as a job."""
    ratings = interactions.groupBy("user_id", "item_id").agg(F.sum(action_weight(F.col("action"), "profile")).alias("rating"))
    ratings = ratings.select(F.col("user_id").cast("int"), F.col("item_id").cast("int"), F.col("rating").cast("float"))
    return ALS(rank=rank, maxIter=5, implicitPrefs=True, userCol="user_id", itemCol="item_id", ratingCol="rating", seed=seed).fit(ratings)


def importance(df: DataFrame, features: list[str], target: str, bins: int = 10, each: int = 500_000) -> DataFrame:
    """Each feature's forest importance, mutual information of binned values, lasso weight and correlation, each
    scaled to its largest, and their mean.

    The forest keeps its rows, with a count for each tree, in blocks as large as its tasks (some 220 bytes a row), so rows are
    counted and dealt to tasks of ``each`` first; the order within a task is fixed, as the trees' samples are drawn in it.
    """
    spark = df.sparkSession
    df = df.select(*features, target)
    ranges = df.agg(*[x for c in (*features, target) for x in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"))]).first()
    corr = df.agg(*[F.corr(f, target).alias(f) for f in features]).first()

    def scaled_of(c: str):
        lo, hi = float(ranges[f"{c}_lo"]), float(ranges[f"{c}_hi"])
        return (F.col(c) - lo) / (hi - lo) if hi > lo else F.lit(0.5)

    dealt = df.repartition(tasks(df.count(), each)).sortWithinPartitions(*features, target)
    dealt = dealt.select(*[scaled_of(c).alias(c) for c in features], F.col(target).cast("double").alias("label")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        data = VectorAssembler(inputCols=features, outputCol="features").transform(dealt)
        forest = RandomForestRegressor(numTrees=20, maxDepth=5, seed=7).fit(data).featureImportances.toArray()
        lasso = abs(LinearRegression(elasticNetParam=1.0, regParam=0.01).fit(data).coefficients.toArray())
    finally:
        dealt.unpersist()

    def bin_of(c: str):
        lo, hi = float(ranges[f"{c}_lo"]), float(ranges[f"{c}_hi"])
        return F.least(F.lit(bins - 1), F.floor((F.col(c) - lo) / max(hi - lo, 1e-12) * bins))

    def information(f: str) -> float:
        cells = df.groupBy(bin_of(f).alias("x"), bin_of(target).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most bins x bins
        total = sum(c.n for c in cells)
        px, py = {}, {}
        for c in cells:
            px[c.x], py[c.y] = px.get(c.x, 0) + c.n, py.get(c.y, 0) + c.n
        from math import log

        return sum(c.n / total * log(c.n * total / (px[c.x] * py[c.y])) for c in cells)

    parts = {"forest": forest, "information": [information(f) for f in features], "lasso": lasso, "correlation": [abs(corr[f] or 0.0) for f in features]}
    scaled = {k: [float(x) / (float(max(v)) or 1.0) for x in v] for k, v in parts.items()}
    rows = [(f, *[scaled[k][i] for k in parts], sum(scaled[k][i] for k in parts) / len(parts)) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, forest double, information double, lasso double, correlation double, mean double")


def rating_sums(ratings: DataFrame, key: str) -> DataFrame:
    """(``key``, total, n): what a bias needs of ratings (user_id, item_id, rating); sums of batches add up."""
    return ratings.groupBy(key).agg(F.sum("rating").alias("total"), F.count(F.lit(1)).alias("n"))


def merged_sums(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The sums after another batch, without reading the earlier ones' ratings again."""
    return old.unionByName(new).groupBy(key).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def biases(sums: DataFrame, key: str, shrink: float = 5.0) -> DataFrame:
    """(``key``, bias): how far the mean rating of a user or an item is from the mean of all, shrunk towards 0."""
    mean = sums.agg((F.sum("total") / F.sum("n")).alias("mean"))
    return sums.crossJoin(F.broadcast(mean)).select(key, ((F.col("total") - F.col("n") * F.col("mean")) / (F.col("n") + shrink)).alias("bias"))  # one row broadcast


def fold_in_sums(ratings: DataFrame, factors: DataFrame, rank: int) -> DataFrame:
    """What a user's normal equations need of ratings (user_id, item_id, rating) and fixed item factors
    (item_id, factors, bias): a_i_j and b_i, with the user's own bias as one more factor.  Sums of batches add up."""
    z = [F.get("factors", F.lit(i)).cast("double") for i in range(rank)] + [F.lit(1.0)]
    target = F.col("rating") - F.col("bias")
    a = [F.sum(z[i] * z[j]).alias(f"a_{i}_{j}") for i in range(rank + 1) for j in range(i, rank + 1)]
    return ratings.join(factors, "item_id").groupBy("user_id").agg(*a, *[F.sum(z[i] * target).alias(f"b_{i}") for i in range(rank + 1)])


def added_sums(old: DataFrame, new: DataFrame) -> DataFrame:
    """The sums after another batch, and whether it touched the user; earlier ratings aren't read again."""
    names = [c for c in old.columns if c != "user_id"]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy("user_id").agg(*[F.sum(c).alias(c) for c in names], (F.max("_new") == 1).alias("touched"))


def fold_in(sums: DataFrame, rank: int, regularization: float) -> DataFrame:
    """(user_id, factors, bias) that solve each user's regularised normal equations, in Arrow batches of users."""
    import numpy as np
    import pyarrow as pa

    size = rank + 1
    cells = [(i, j) for i in range(size) for j in range(i, size)]

    def work(batches):
        for batch in batches:
            columns = [np.asarray(batch.column(k)) for k in range(1, batch.num_columns)]
            a = np.zeros((len(batch), size, size))
            for (i, j), c in zip(cells, columns, strict=False):
                a[:, i, j] = a[:, j, i] = c
            b = np.stack(columns[len(cells) :], 1) if len(batch) else np.zeros((0, size))
            x = np.linalg.solve(a + regularization * np.eye(size), b[..., None])[..., 0]
            offsets = pa.array(np.arange(len(batch) + 1) * rank, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x[:, :rank].ravel())), pa.array(x[:, rank])], names=["user_id", "factors", "bias"])

    ordered = sums.select(F.col("user_id").cast("long"), *[F.col(f"a_{i}_{j}").cast("double") for i, j in cells], *[F.col(f"b_{i}").cast("double") for i in range(size)])
    return ordered.mapInArrow(work, "user_id long, factors array<double>, bias double")


def predicted(pairs: DataFrame, users: DataFrame, items: DataFrame, base: float) -> DataFrame:
    """Ratings of pairs (user_id, item_id) from factors and biases, within 1..5; unknown users and items count as 0."""
    u, i = users.select("user_id", F.col("factors").alias("_u"), F.col("bias").alias("_ub")), items.select("item_id", F.col("factors").alias("_i"), F.col("bias").alias("_ib"))
    dot = F.aggregate(F.zip_with("_u", "_i", lambda x, y: x * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    zero = F.lit(0.0)
    value = base + F.coalesce("_ub", zero) + F.coalesce("_ib", zero) + F.coalesce(dot, zero)
    return pairs.join(u, "user_id", "left").join(i, "item_id", "left").select(*pairs.columns, F.least(F.lit(5.0), F.greatest(F.lit(1.0), value)).alias("predicted"))
