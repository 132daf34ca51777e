"""Running and windowed sums against plain loops, with one key that holds half of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from recfeat.operators import features
from recfeat.operators.running import Recent, recent_sums, running_sums


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(i, 7 if i % 2 else rng.randrange(20), rng.randrange(6), rng.choice([0, 1, 1, 3_600_000_000, rng.randrange(40_000_000_000)]), rng.choice([None, rng.randrange(9)])) for i in range(900)]


@pytest.mark.parametrize("bucket", [1, 600, 3600, 10**6])
@pytest.mark.parametrize("now", [False, True])
def test_recent_sums(spark, rows, bucket, now):
    df = spark.createDataFrame(rows, "event_id long, k long, v int, us long, x int")
    got = recent_sums(df, ["k"], "us", {"n": Recent(3600, F.lit(1)), "s": Recent(7200, F.col("x")), "d": Recent(3600, distinct="v"), "e": Recent(60, distinct="v")}, now, bucket)
    assert got.columns == [*df.columns, "n", "s", "d", "e"]
    found = {r.event_id: tuple(r)[5:] for r in got.collect()}
    assert len(found) == len(rows)
    for i, k, _, us, _ in rows:
        near = lambda w: [r for r in rows if r[1] == k and us - w * 1_000_000 <= r[3] and (r[3] <= us if now else r[3] < us)]  # noqa: B023, E731
        want = (len(near(3600)), sum(r[4] or 0 for r in near(7200)), len({r[2] for r in near(3600)}), len({r[2] for r in near(60)}))
        assert found[i] == want, i


def test_running_sums_with_ties(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, k long, v int, us long, x int")
    found = {r.event_id: r.s for r in running_sums(df, ["k"], "us", {"s": F.col("v")}, ties=["event_id"], bucket=60).collect()}
    for i, k, _, us, _ in rows:
        assert found[i] == sum(r[2] for r in rows if r[1] == k and (r[3], r[0]) <= (us, i))
    assert running_sums(df.limit(0), ["k"], "us", {"s": F.col("v")}).count() == 0


def test_a_hot_key_spreads(spark, rows):
    """No task's window holds all rows of a key: rows are dealt by key and time bucket."""
    df = spark.createDataFrame(rows, "event_id long, k long, v int, us long, x int")
    plan = running_sums(df, ["k"], "us", {"s": F.col("v")})._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Window [" in line]
    assert len(dealt) == 2 and sum("_bucket" in line.split("], [")[1] for line in dealt) == 1  # the other one runs over totals, a row a bucket
    largest = df.groupBy("k", F.floor(F.col("us") / 3_600_000_000)).count().agg(F.max("count")).first()[0]
    assert largest < df.filter("k = 7").count()


def test_bursts(spark):
    rows = [(i, 1, i, 1_000_000 * i) for i in range(30)] + [(100 + i, 2, i % 5, 1_000_000 * i) for i in range(60)]
    made = spark.createDataFrame(rows, "event_id long, user_id long, item_id long, us long").select("event_id", "user_id", "item_id", F.timestamp_micros("us").alias("ts"))
    assert sorted(tuple(r) for r in features.bursts(made).collect()) == [(i, 1, i + 1) for i in range(20, 30)]
    assert sorted(r.items for r in features.bursts(made, 3, 3).collect()) == [4] * (27 + 57)
