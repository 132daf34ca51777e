"""Hand-computed fixtures, properties, defect regressions and batch/stream parity."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recfeat import views
from recfeat.functions import exprs as X
from recfeat.operators import features as O
from recfeat.operators import metrics as M
from recfeat.operators import recall as R
from recfeat.operators import rerank
from recfeat.operators import store as S
from recfeat.operators import tags as T
from recfeat.streaming import sinks, state, windows


def test_ranking_metrics_by_hand(spark):
    lists = {1: ([1, 2, 3, 4, 5], {1, 3, 5}), 2: ([3, 4, 5, 6, 7], {4, 6}), 3: ([1, 5, 8, 9, 10], {5, 8, 11})}
    recs = spark.createDataFrame([(u, i, r) for u, (items, _) in lists.items() for r, i in enumerate(items, 1)], "user_id long, item_id int, rank int")
    truth = spark.createDataFrame([(u, i) for u, (_, t) in lists.items() for i in t], "user_id long, item_id int")
    got = {r.k: r for r in M.ranking_report(M.ranking_metrics(recs, truth, [3, 5, 10])).collect()}
    want = {3: (0.555556, 0.611111, 0.577778, 0.540497), 5: (0.466667, 0.888889, 0.607143, 0.689034), 10: (0.466667, 0.888889, 0.607143, 0.689034)}
    for k, (p, r, f, n) in want.items():
        assert (got[k].precision, got[k].recall, got[k].f1, got[k].ndcg) == pytest.approx((p, r, f, n), abs=1e-6)
    assert (got[10].map, got[10].mrr, got[10].hit_rate) == pytest.approx((0.548148, 0.666667, 1.0), abs=1e-6)


def test_auc_ties(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "score double, label int")
    assert M.auc(rows).first().auc == 0.875
    flipped = M.auc(rows.withColumn("score", -F.col("score"))).first().auc
    assert flipped == pytest.approx(1 - 0.875)


def test_ratio_helpers(spark):
    row = spark.range(1).select(X.sd(F.lit(5), F.lit(0)).alias("sd"), X.m1(F.lit(5), F.lit(0)).alias("m1"), X.p1(F.lit(5), F.lit(0)).alias("p1")).first()
    assert (row.sd, row.m1, row.p1) == (0.0, 5.0, 5.0)


def test_decay_is_one_at_start_and_falls(spark):
    for kind in ("exponential", "linear", "logarithmic", "power"):
        rows = [r.d for r in spark.range(0, 40).orderBy("id").select(X.decay(F.col("id").cast("double"), kind, 0.1).alias("d")).collect()]
        assert rows[0] == 1 and all(b <= a + 1e-12 <= 1 + 1e-9 for a, b in zip(rows, rows[1:], strict=False))


def test_point_in_time_bounds(spark):
    """An event at t - w counts, one at t doesn't."""
    rows = [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 01:00:00"), (3, "2024-01-01 01:00:00"), (4, "2024-01-01 01:00:01")]
    df = spark.createDataFrame(rows, "event_id long, t string").select("event_id", F.col("t").cast("timestamp").alias("ts"), F.lit(1).alias("user_id"), F.lit(1).alias("item_id"), F.lit(1.0).alias("price"), F.lit("view").alias("action"))
    got = {r.event_id: r.n for r in O.rolling(df, 3600).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}


def test_rules(spark):
    df = spark.createDataFrame([(1, 10.0, ["eu"], 5.0), (2, 100.0, None, 5.0), (3, 100.0, ["us"], None)], "id int, score double, regions array<string>, price double")
    out = {r.id: r for r in S.apply_rules(df, [
        {"rule_id": "region", "priority": 2, "condition": {"regions": {"$not_contains": "eu"}}, "action": {"type": "exclude"}},
        {"rule_id": "cheap", "priority": 1, "condition": {"price": {"$lte": 5}}, "action": {"type": "boost", "factor": 2}},
    ]).collect()}
    assert (out[1].excluded_by, out[1].score, out[1].applied) == (None, 20.0, "cheap")
    assert out[2].excluded_by is None and out[3].excluded_by == "region" and out[3].score == 100.0
    with pytest.raises(ValueError):
        S.compile_rule({"a": {"$like": 1}})


def test_greedy_quota_rejects_without_using_quota(spark):
    rows = [(1, 1, 9.0, 1, 1), (1, 2, 8.0, 1, 2), (1, 3, 7.0, 2, 1), (1, 4, 6.0, 2, 2), (1, 5, 5.0, 2, 3)]
    df = spark.createDataFrame(rows, "user_id long, item_id int, score double, category_id int, brand_id int")
    assert [r.item_id for r in rerank.greedy_quota(df, 1, 1, 10).orderBy("rank").collect()] == [1, 4]
    walk = [r.category_id for r in rerank.spread(df, 10).orderBy("rank").collect()]
    assert all(a != b for a, b in zip(walk, walk[1:], strict=False))


def test_similar_vectors(spark, sf_dir):
    """The same neighbours for any number of pivots, and for vectors without a direction."""
    v = views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    one, many, some = (R.similar_vectors(v.filter("vec_id % 10 = 0"), v, 5, pivots=n) for n in (1, 60, None))
    want = sorted(map(tuple, one.collect()))
    assert sorted(map(tuple, many.select(*one.columns).collect())) == want == sorted(map(tuple, some.select(*one.columns).collect()))
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [-1.0, 0.0]), (5, None)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.similarity for r in R.similar_vectors(odd, odd, 3, pivots=2).collect()}
    assert got == {(1, 2): 0.0, (1, 3): 0.0, (1, 4): 0.0, (2, 3): 1.0, (2, 1): 0.0, (2, 4): -1.0, (3, 2): 1.0, (3, 1): 0.0, (3, 4): -1.0, (4, 1): 0.0, (4, 2): -1.0, (4, 3): -1.0}
    assert R.similar_vectors(odd.limit(0), odd.limit(0), 3).count() == 0


def test_similar_vectors_skip_far_clusters(spark):
    """On clustered vectors less than a tenth of all pairs is compared, and no neighbour is lost."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(40, size=1200)] + 0.05 * rng.normal(size=(1200, 16))
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    queries = v.filter("vec_id % 20 = 0")
    assert R.compared_vectors(queries, v, 5, pivots=120).count() < 0.1 * 60 * 1200
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    cos = np.round(unit[::20] @ unit.T, 6)
    for r in R.similar_vectors(queries, v, 5, pivots=120).collect():
        mine = cos[r.query_id // 20].copy()
        mine[r.query_id] = -2
        assert abs(np.sort(mine)[-r.rank] - r.similarity) < 2e-6


def test_short_sequences_keep_all_items(spark, sf_dir):
    last = O.last_n(views.interactions(spark, sf_dir), "user_id", 10_000)
    assert last.count() == views.interactions(spark, sf_dir).count()


def test_closure(spark):
    got = {(r.tag, r.ancestor, r.distance) for r in T.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None)], "tag string, parent string")).collect()}
    assert got == {("a", "b", 1), ("b", "c", 1), ("a", "c", 2)}


def _stream(spark, sf_dir, tmp_path):
    source = str(tmp_path / "in")
    views.table(spark, sf_dir, "events").orderBy("ts").coalesce(1).write.parquet(source)
    return views.from_events(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source))


def _run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


@pytest.mark.parametrize("make", [windows.user_tumbling, windows.user_hopping, windows.item_tumbling, windows.behaviour, windows.item_sliding, windows.ab_hourly])
def test_stream_equals_batch_on_closed_windows(make, spark, sf_dir, tmp_path):
    got = {tuple(r) for r in _run(make(_stream(spark, sf_dir, tmp_path)), tmp_path, f"t_{make.__name__}").collect()}
    batch = {tuple(r) for r in make(views.interactions(spark, sf_dir)).collect()}
    assert got and got <= batch
    end = max(r[1] for r in batch)
    assert all(r in got for r in batch if r[1] < end - 7200)


def test_sessions_stream(spark, sf_dir, tmp_path):
    got = {tuple(r) for r in _run(windows.sessions(_stream(spark, sf_dir, tmp_path)), tmp_path, "t_sessions").collect()}
    batch = {tuple(r) for r in windows.sessions(views.interactions(spark, sf_dir)).collect()}
    assert got <= batch and len(batch) - len(got) < 20


def test_item_counters_stream(spark, sf_dir, tmp_path):
    got = {r.event_id: (r.views, r.clicks, r.purchases, round(r.ctr, 9)) for r in _run(state.item_counters(_stream(spark, sf_dir, tmp_path)), tmp_path, "t_counters").collect()}
    want = {r.event_id: (r.views, r.clicks, r.purchases, round(r.ctr, 9)) for r in O.running_rates(views.interactions(spark, sf_dir)).collect()}
    assert got == want


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 3, 5)], "k string, v int, at long")
    once, keyed = str(tmp_path / "once"), str(tmp_path / "keyed")
    write = sinks.fan_out(sinks.exactly_once(once), sinks.latest_by_key(keyed, "k", "at", 60))
    write(df, 0)
    write(df, 0)
    assert spark.read.parquet(once).count() == 3
    write(df.limit(0).unionByName(spark.createDataFrame([("b", 9, 50)], "k string, v int, at long")), 1)
    assert {(r.k, r.v, r.expires_at) for r in spark.read.parquet(f"{keyed}/v=1").collect()} == {("a", 2, 80), ("b", 9, 110)}


def test_late_and_repeated_events(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:03")]
    df = spark.createDataFrame(rows, "event_id long, t string").select("event_id", F.col("t").cast("timestamp").alias("ts"))
    source = str(tmp_path / "in")
    df.write.parquet(source)
    out = _run(windows.dedup(spark.readStream.schema(df.schema).parquet(source)), tmp_path, "t_dedup")
    assert sorted(r.event_id for r in out.collect()) == [1, 2] and windows.dedup(df).count() == 2


def test_exact_quantiles(spark):
    """Against the interpolated percentile of each group, with ties, single values and nulls."""
    import numpy as np
    from pyspark.sql import functions as F

    from recfeat.operators.quantiles import quantiles, with_quantiles

    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=3000), "b": np.repeat([1.0, 2.0, 3.0], [900, 5, 95]), "c": np.array([7.0]), "d": rng.integers(0, 40, 500).astype(float)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    p = (0.0, 0.25, 0.5, 0.9, 0.999, 1.0)
    got = {r.k: r.q for r in quantiles(df, F.col("x"), p, ("k",)).collect()}
    assert set(got) == set(groups) and all(np.allclose(got[k], np.quantile(v, p)) for k, v in groups.items())
    whole = quantiles(df, F.col("x"), p).collect()
    assert len(whole) == 1 and np.allclose(whole[0].q, np.quantile(np.concatenate(list(groups.values())), p))
    assert quantiles(df.limit(0), F.col("x"), p).count() == 0
    one = with_quantiles(df.limit(0).agg(F.count("x").alias("n")), df.limit(0), F.col("x"), p).collect()
    assert len(one) == 1 and one[0].n == 0 and one[0].q is None


def test_tables_too_large_for_a_broadcast(spark):
    """Beyond the bound a lookup has no hint and the same rows; a list without an equi-join raises."""
    from recfeat.functions.sized import listed, small
    from recfeat.operators import tags

    rows = spark.createDataFrame([(1, "steel"), (2, "metal"), (3, None)], "item_id long, tag string")
    tree = tags.closure(tags.dictionary(spark)).select("tag", "ancestor")
    hints = [d._jdf.queryExecution().analyzed().toString().count("broadcast") for d in (small(tree), small(tree, 1))]
    assert hints == [1, 0]
    assert rows.join(small(tree), "tag").collect() == rows.join(small(tree, 1), "tag").collect() == [("steel", 1, "metal")]
    items = spark.createDataFrame([(1, "STEEL", 5.0)], "item_id long, category string, price double")
    assert {r.tag for r in tags.auto_tag(items, tags.dictionary(spark)).collect()} == {"steel", "cheap"}
    with pytest.raises(ValueError, match="tags"):
        tags.auto_tag(items, tags.dictionary(spark), most=3)
    assert listed(tree.limit(0), "none", 0).count() == 0
