"""Exact percentiles that no task has to hold the values for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Ranges of values into which a group is cut.
RANGES = 64


def quantiles(df: DataFrame, value: Column, probabilities: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``by`` and ``q``, the interpolated percentiles of ``value`` in each group, in the order asked for.

    Values are counted first, so that equal ones are one row.  Nulls are passed over; without rows there are no groups,
    and without ``by`` no row.
    """
    counts = df.select(*by, value.cast("double").alias("v")).filter(F.col("v").isNotNull()).groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))
    return counted_quantiles(counts, probabilities, by)


def counted_quantiles(counts: DataFrame, probabilities: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """``quantiles`` of values that are counted already: one row (``by``, v, n) a value v that isn't null.

    An approximate sketch cuts each group's values into RANGES ranges of about equal size; a value's rank is its rank in
    its range, in the order of a window over that range alone, after the rows of the ranges before.  The sketch decides
    only how even the ranges are: ranks are exact.
    """
    by = list(by)
    inner = [F.lit(i / RANGES) for i in range(1, RANGES)]
    cuts = counts.groupBy(*by).agg(F.approx_percentile("v", F.array(*inner), F.lit(1000)).alias("cuts"), F.sum("n").alias("total")).filter("total is not null")
    rows = counts.join(cuts, by) if by else counts.crossJoin(F.broadcast(cuts))  # one row broadcast
    rows = rows.withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    sizes = rows.groupBy(*by, "range").agg(F.sum("n").alias("m"))
    upto = W.partitionBy(*by).orderBy("range")
    starts = sizes.select(*by, "range", (F.sum("m").over(upto) - F.col("m")).alias("start"))
    within = W.partitionBy(*by, "range").orderBy("v")
    rows = rows.join(starts, [*by, "range"]).withColumn("end", F.col("start") + F.sum("n").over(within)).withColumn("begin", F.col("end") - F.col("n"))

    def at(p: float) -> Column:
        place = F.lit(float(p)) * (F.col("total") - 1)
        held = lambda r: F.max(F.when((F.col("begin") <= r) & (r < F.col("end")), F.col("v")))
        low, high, part = held(F.floor(place)), held(F.ceil(place)), F.max(place - F.floor(place))
        return low + (high - low) * part

    return rows.groupBy(*by).agg(F.array(*[at(p) for p in probabilities]).alias("q")).filter(F.get("q", F.lit(0)).isNotNull())


def with_quantiles(stats: DataFrame, of: DataFrame, value: Column, probabilities: tuple[float, ...], name: str = "q") -> DataFrame:
    """``stats``, one row, with the array ``name`` of percentiles of ``value`` over ``of``; null without values."""
    return stats.join(F.broadcast(quantiles(of, value, probabilities).withColumnRenamed("q", name)), how="left")  # one row broadcast
