"""The stream-stream join, incremental factors, and lists shared out between channels."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from recfeat import views
from recfeat.operators import models, rerank
from recfeat.streaming import windows

_T0 = datetime.datetime(2024, 1, 1, 10, 0, 0)


def _events(rows):
    """(event_id, seconds from the start, user, item, price) as rows of the event table."""
    return [(i, _T0 + datetime.timedelta(seconds=s), u, "view", float(p), f'{{"k": {k}}}') for i, s, u, k, p in rows]


def test_cross_scores_of_a_stream(spark, tmp_path):
    """The streamed join equals the batch one; a row behind the watermark changes nothing and isn't scored."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    rng = np.random.default_rng(6)
    rows = sorted((int(s), int(rng.integers(4)), int(rng.integers(3)), float(rng.integers(1, 90))) for s in rng.integers(0, 3600, 240))
    rows = [(n, *r) for n, r in enumerate(rows)]
    source = str(tmp_path / "in")
    for part in range(6):
        some = [r for r in rows if part * 600 <= r[1] < (part + 1) * 600]
        if part == 4:
            some.append((9999, 5, 1, 1, 5000.0))  # hours late, by the watermark
        spark.createDataFrame(_events(some), schema).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame(_events([(10_000, 90_000, 77, 77, 1.0)]), schema).coalesce(1).write.mode("append").parquet(source)  # lets all windows close
    spark.createDataFrame(_events([(10_001, 190_000, 77, 77, 1.0)]), schema).coalesce(1).write.mode("append").parquet(source)
    stream = views.from_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    scored = windows.cross_scores(stream)
    query = scored.writeStream.format("memory").queryName("t_cross").outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.event_id: tuple(r)[4:] for r in spark.table("t_cross").collect() if r.event_id < 9999}
    kept = views.from_events(spark.createDataFrame(_events(rows), schema))
    want = {r.event_id: tuple(r)[4:] for r in windows.cross_scores(kept).collect()}
    assert got == want and sum(x[0] > 0 for x in want.values()) > 20
    assert 9999 not in {r.event_id for r in spark.table("t_cross").collect()}
    state = sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])
    assert state < 20  # what has been closed is gone


def _rows(rng, n, users):
    return [(int(rng.choice(users)), int(rng.integers(12)), float(rng.integers(1, 6))) for _ in range(n)]


def test_fold_in(spark):
    """A second batch changes the users that it touches alone, and factors agree with a plain solution."""
    rng, rank, reg = np.random.default_rng(8), 3, 0.2
    q, bias = rng.normal(size=(12, rank)), rng.normal(size=12)
    items = spark.createDataFrame([(i, q[i].tolist(), float(bias[i])) for i in range(12)], "item_id long, factors array<double>, bias double")
    first, second = _rows(rng, 300, range(20)), _rows(rng, 60, [3, 5, 99])
    frame = lambda rows: spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    old, new = (models.fold_in_sums(frame(x), items, rank) for x in (first, second))
    both = models.added_sums(old, new)
    assert {r.user_id for r in both.filter("touched").collect()} == {u for u, *_ in second}

    def plain(rows):
        out = {}
        for u in {u for u, *_ in rows}:
            z = np.array([[*q[i], 1.0] for v, i, _ in rows if v == u])
            t = np.array([r - bias[i] for v, i, r in rows if v == u])
            out[u] = np.linalg.solve(z.T @ z + reg * np.eye(rank + 1), z.T @ t)
        return out

    before, after = ({r.user_id: [*r.factors, r.bias] for r in models.fold_in(s, rank, reg).collect()} for s in (old, both))
    for got, want in ((before, plain(first)), (after, plain(first + second))):
        assert got.keys() == want.keys() and all(np.allclose(got[u], want[u]) for u in got)
    assert all(np.allclose(before[u], after[u]) for u in before if u not in (3, 5, 99)) and not np.allclose(before[3], after[3])

    pairs = spark.createDataFrame([(3, 1), (3, 400), (400, 1)], "user_id long, item_id long")
    users = models.fold_in(both, rank, reg)
    got = {(r.user_id, r.item_id): r.predicted for r in models.predicted(pairs, users, items, 2.5).collect()}
    clip = lambda v: min(5.0, max(1.0, v))
    assert np.isclose(got[3, 1], clip(2.5 + after[3][-1] + bias[1] + q[1] @ after[3][:-1]))
    assert np.isclose(got[3, 400], clip(2.5 + after[3][-1])) and np.isclose(got[400, 1], clip(2.5 + bias[1]))


def test_places_of_empty_channels(spark):
    """A user with two empty channels still gets k rows; an item of two channels belongs to the first of them."""
    frame = lambda rows: spark.createDataFrame(rows, "user_id long, item_id long, score double")
    a, b, c, d = [(1, i, 9.0 - i) for i in range(20)], [], [(1, i, float(i)) for i in range(15, 40)], []
    channels = {"a": (0.4, frame(a)), "b": (0.3, frame(b)), "c": (0.2, frame(c + [(2, 7, 1.0)])), "d": (0.1, frame(d))}
    rows = sorted(rerank.apportioned(channels, 10).collect(), key=lambda r: (r.user_id, r.rank))
    assert [(r.channel, r.item_id, r.spilled) for r in rows if r.user_id == 1] == [("a", i, False) for i in range(4)] + [("c", 39, False), ("c", 38, False)] + [("a", i, True) for i in range(4, 8)]
    assert [(r.item_id, r.rank) for r in rows if r.user_id == 2] == [(7, 1)]


def test_walks_by_hand(spark):
    rows = [(1, i, 50.0 - i, i % 2 if i < 6 else i, i % 3) for i in range(12)]
    df = spark.createDataFrame(rows, "user_id long, item_id int, score double, category_id int, brand_id int")
    assert [r.item_id for r in rerank.half_free(df, 6).orderBy("rank").collect()] == [0, 1, 2, 6, 7, 8]
    assert [r.item_id for r in rerank.spread(df, 5, per_brand=1).orderBy("rank").collect()] == [0, 1, 2]
    assert rerank.spread(df.limit(0), 5).count() == 0 and rerank.walk(df, 3, lambda kept, r: F.lit(True), candidates=2).count() == 2
