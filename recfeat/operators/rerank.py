"""Lists built row by row under quotas, and lists shared out between channels; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recfeat.operators.recall import top_k

#: A user's candidates, as the recall stage limits them.
CANDIDATES = 1000


def walk(df: DataFrame, k: int, accept: Callable[[Column, Column], Column], by: str = "user_id", candidates: int = CANDIDATES) -> DataFrame:
    """Each group's rows in score order, taken one by one if ``accept(list so far, row)`` holds, up to ``k``.

    The best ``candidates`` rows of a group are looked at, so its array is bounded; a fold keeps the list.
    """
    best = top_k(df, candidates, "score", "item_id", [by])
    fields = [c for c in df.columns if c != by]
    lists = best.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("rows"))
    none = F.array().cast(lists.schema["rows"].dataType)
    step = lambda kept, r: F.when((F.size(kept) < k) & accept(kept, r), F.array_append(kept, r)).otherwise(kept)
    out = lists.select(by, F.posexplode(F.aggregate("rows", none, step)).alias("at", "row"))
    return out.select(by, *[F.col(f"row.{c}").alias(c) for c in fields], (F.col("at") + 1).cast("long").alias("rank"))


def _held(kept: Column, field: str, value: Column) -> Column:
    return F.size(F.filter(kept, lambda x: x[field].eqNullSafe(value)))


def greedy_quota(df: DataFrame, per_category: int, per_brand: int, k: int) -> DataFrame:
    """F5 with two independent quotas: a rejected row uses up no quota."""
    return walk(df, k, lambda kept, r: (_held(kept, "category_id", r["category_id"]) < per_category) & (_held(kept, "brand_id", r["brand_id"]) < per_brand))


def spread(df: DataFrame, k: int, per_brand: int = 3) -> DataFrame:
    """a row of the category of the one before it, or of a brand that has ``per_brand`` rows, is passed over."""

    def accept(kept: Column, r: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        fresh = (F.size(kept) == 0) | ~last["category_id"].eqNullSafe(r["category_id"])
        return fresh & (_held(kept, "brand_id", r["brand_id"]) < per_brand)

    return walk(df, k, accept)


def half_free(df: DataFrame, k: int = 20) -> DataFrame:
    """the first half of the list is free, the second takes rows of new categories only."""
    return walk(df, k, lambda kept, r: (F.size(kept) < k // 2) | (_held(kept, "category_id", r["category_id"]) == 0))


def apportioned(channels: dict[str, tuple[float, DataFrame]], k: int, by: str = "user_id") -> DataFrame:
    """``k`` rows a group from channels (share, rows of ``by``, item_id, score), with channel and rank.

    An item belongs to the first channel that offers it.  A channel has floor(k x share) places; what its rows don't fill, and
    what rounding leaves, goes to the rows that are left, channel by channel in the given order.
    """
    parts = [df.select(by, "item_id", "score", F.lit(i).alias("_c")) for i, (_, df) in enumerate(channels.values())]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    own = rows.groupBy(by, "item_id").agg(F.min(F.struct("_c", -F.col("score"))).alias("x")).select(by, "item_id", F.col("x._c").alias("_c"), (-F.col("x.col2")).alias("score"))
    place = F.row_number().over(W.partitionBy(by, "_c").orderBy(F.desc("score"), "item_id"))
    own = own.withColumn("_n", place).filter(F.col("_n") <= k)
    budget = F.get(F.array(*[F.lit(int(k * share + 1e-9)) for share, _ in channels.values()]), F.col("_c"))
    own = own.withColumn("_over", F.col("_n") > budget)
    rank = F.row_number().over(W.partitionBy(by).orderBy("_over", "_c", "_n"))
    name = F.get(F.array(*[F.lit(c) for c in channels]), F.col("_c"))
    return own.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select(by, "item_id", "score", name.alias("channel"), F.col("_over").alias("spilled"), "rank")
