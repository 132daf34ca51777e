"""Sums over a key's history, for keys of any size.

A key's rows are dealt by time buckets: a bucket's running sums are worked out on their own and start from the sum of
the key's earlier buckets, which are totals of one row a bucket.  A hot user or item thus spreads over as many tasks
as it has buckets.

A sum over the last ``w`` seconds is a running sum too: each event adds its value when it happens and takes it away
``w`` seconds later.  Distinct values are counted in the same way: an occurrence takes its 1 away when the value
occurs again or leaves the window, whichever comes first.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Seconds of a bucket; hotter keys may ask for fewer.
BUCKET = 21_600


class Recent(NamedTuple):
    """A value to sum over the last ``seconds``; with ``distinct`` a column whose different values are counted."""

    seconds: int
    value: Column | None = None
    distinct: str | None = None


def running_sums(df: DataFrame, keys: list[str], us: str, sums: dict[str, Column], ties: list[str] | None = None, bucket: int = BUCKET) -> DataFrame:
    """``df`` with the sums of whole-number columns over the rows of its ``keys`` that are earlier by ``us``.

    With ``ties`` a row's own value and those of rows before it in the order (``us``, ``ties``) count as well.
    """
    names = {name: f"_v{i}" for i, name in enumerate(sums)}
    # Rows are shuffled before the columns to sum are made: one value may go into many sums.
    dealt = df.withColumn("_bucket", F.expr(f"floor({us} / {bucket * 1_000_000})")).repartition(*keys, "_bucket")
    dealt = dealt.select("*", *[sums[name].cast("long").alias(v) for name, v in names.items()])
    totals = dealt.groupBy(*keys, "_bucket").agg(*[F.expr(f"sum({v}) as {v}") for v in names.values()])
    over = f"over (partition by {', '.join(keys)} order by _bucket rows between unbounded preceding and 1 preceding)"  # one row a bucket
    carried = totals.selectExpr(*keys, "_bucket", *[f"sum({v}) {over} as {v}c" for v in names.values()])
    frame = f"{us} range between unbounded preceding and 1 preceding" if ties is None else f"{', '.join([us, *ties])} rows between unbounded preceding and current row"
    own = f"over (partition by {', '.join(keys)}, _bucket order by {frame})"
    out = dealt.selectExpr("*", *[f"sum({v}) {own} as {v}w" for v in names.values()]).join(carried, [*keys, "_bucket"], "left")
    return out.selectExpr(*df.columns, *[f"coalesce({v}w, 0L) + coalesce({v}c, 0L) as {name}" for name, v in names.items()])


def recent_sums(events: DataFrame, keys: list[str], us: str, recent: dict[str, Recent], with_now: bool = False, bucket: int = BUCKET) -> DataFrame:
    """``events`` with sums and distinct counts over [t - seconds, t), or up to t with ``with_now``, of each event's keys.

    Each event becomes one row and one for each window and distinct column that it leaves: no frame is read again.
    """
    base, counted = events, sorted({r.distinct for r in recent.values() if r.distinct})
    for i, c in enumerate(counted):  # when the value occurs next
        base = base.withColumn(f"_next{i}", F.lead(us).over(W.partitionBy(*keys, c).orderBy(us)) - F.lit(int(with_now)))
    leaves = sorted({(r.seconds, r.distinct or "") for r in recent.values()})
    later = lambda s: f"{us} + {s * 1_000_000}L"
    marks = [f"named_struct('at', {us}, 'kind', 0)", *([f"named_struct('at', {us} - 1, 'kind', -1)"] if with_now else [])]
    marks += [
        f"named_struct('at', {f'least({later(s)}, coalesce(_next{counted.index(c)}, {later(s)}))' if c else later(s)}, 'kind', {k})" for k, (s, c) in enumerate(leaves, 1)
    ]
    values = list({id(r.value): r.value for r in recent.values() if not r.distinct}.values())  # one column for all windows of a value
    row = ", ".join(f"'{c}', {c}" for c in events.columns)
    rows = base.select(*keys, F.expr(f"named_struct({row})").alias("_row"), *[v.cast("long").alias(f"_x{i}") for i, v in enumerate(values)], F.expr(f"explode(array({', '.join(marks)}))").alias("_m"))
    rows = rows.selectExpr(*keys, *[f"_x{i}" for i in range(len(values))], "case when _m.kind = 0 then _row end as _row", "_m.at as _at", "_m.kind as _kind")
    sums = {}
    for i, r in enumerate(recent.values()):
        x = "1L" if r.distinct else f"coalesce(_x{next(j for j, v in enumerate(values) if v is r.value)}, 0L)"
        sums[f"_s{i}"] = F.expr(f"case when _kind = {-1 if with_now else 0} then {x} when _kind = {leaves.index((r.seconds, r.distinct or '')) + 1} then -{x} else 0L end")
    out = running_sums(rows, keys, "_at", sums, bucket=bucket)
    return out.filter("_kind = 0").selectExpr("_row.*", *[f"_s{i} as {name}" for i, name in enumerate(recent)])


def exact(price: Column) -> Column:
    """A price in millionths, as a whole number: its sums don't depend on their order."""
    return F.round(price * 1_000_000).cast("long")


def mean_exact(price: Column) -> Column:
    """The mean of prices that doesn't depend on their order, so that one at a limit is always on the same side of it."""
    return F.sum(exact(price)).cast("double") / F.count(price) / 1_000_000
