"""Findings of the third review, one test each."""

from functools import partial

from pyspark.sql import functions as F

from recfeat import views
from recfeat.functions import sized
from recfeat.operators import models as L
from recfeat.operators import recall as R
from recfeat.operators import tags as T
from recfeat.plans import catalog, products

from . import duck


def test_free_items_are_learned_from(spark):
    """a price of 0 is a stored zero among the hashed parts."""
    rows = spark.range(200).selectExpr("id event_id", "double(id % 3 = 0) label", "id % 11 user_id", "id % 7 item_id", "id % 5 category_id", "id % 2 brand_id", "'PS5' platform", "int(id % 24) hour", "double(id % 4) log_price")
    for kind in ("fm", "logistic"):
        assert L.ctr_model(rows, kind).transform(rows).filter("prediction in (0.0, 1.0)").count() == 200


def _exactly(name, spark, path):
    """The query's and its twin's rows, compared bit by bit."""
    cur = duck.connect(path).execute(catalog.ORACLE[name])
    names = [c[0] for c in cur.description]
    plain = lambda rows: sorted(repr(tuple(duck.plain(v) for v in r)) for r in rows)
    assert plain(catalog.QUERIES[name](spark, path).select(*names).collect()) == plain(cur.fetchall())


def _tables(sf_dir, path, **own):
    """The given tables, ``own`` (SQL for DuckDB) in place of some."""
    con = duck.connect(sf_dir)
    for t in duck.TABLES:
        con.execute(f"copy ({own.get(t, f'select * from {t}')}) to '{path}/{t}.parquet'")
    return str(path)


def test_ties_of_vectors(spark, sf_dir, tmp_path):
    """pairs of prices whose product has a 5 in the seventh place, which the engines' ROUND takes different ways."""
    pairs = "select * from (values (1, 500, 2490), (2, 500, 2510), (3, 850, 2900), (4, 1004, 1250), (5, 1690, 1500), (6, 1956, 1250), (7, 2075, 600), (8, 2600, 975)) p(u, a, b)"
    rows = f"select 2 * u + k event_id, timestamp '2024-01-29 10:00:00' + to_minutes(k::bigint) ts, u user_id, 'view' event_type, (case k when 0 then a else b end / 100)::double as value, '{{\"k\": ' || u % 100 || '}}' props from ({pairs}), range(2) z(k)"
    _exactly("B13_model_vector", spark, _tables(sf_dir, tmp_path, events=rows))


def _typed(steps, micros):
    """SQL of events (user, type) that follow each other by so many microseconds."""
    rows = ", ".join(f"({n}, {u}, '{kind}')" for n, (u, kind) in enumerate(steps))
    return f"select n::bigint event_id, timestamp '2024-01-29 10:00:00' + to_microseconds(n::bigint * {micros}) ts, u::bigint user_id, t event_type, 1.0::double as value, '{{\"k\": 3}}' props from (values {rows}) v(n, u, t)"


def test_ties_of_dwell_times(spark, sf_dir, tmp_path):
    """every gap is 1.00185 s, which the engines' ROUND takes to 1.0018 or 1.0019."""
    _exactly("D14_dwell_distribution", spark, _tables(sf_dir, tmp_path, events=_typed([(1, "view")] * 20, 1_001_850)))


def test_discounts_at_the_limit(spark, sf_dir, tmp_path):
    """discounts whose mean is .05, but less than that when added up as doubles in this order."""
    lines = "select l.* replace (1::bigint as l_partkey, d::double as l_discount) from (select * from lineitem limit 1) l, (values (0.0), (0.01), (0.06), (0.09), (0.09)) v(d)"
    path = _tables(sf_dir, tmp_path, lineitem=lines)
    assert [r.discount for r in products._products(spark, path).filter("item_id = 1").collect()] == [0.05]
    _exactly("J17_hybrid_score", spark, path)


def test_equal_users_are_one_segment(spark, sf_dir, tmp_path):
    """the same actions in another order are the same mean engagement."""
    steps = [(u, kind) for u in range(10) for kind in (("purchase", "error", "error") if u == 4 else ("error", "error", "purchase"))]
    path = _tables(sf_dir, tmp_path, events=_typed(steps, 1000))
    assert [tuple(r) for r in catalog.QUERIES["P5_segments"](spark, path).select("high", "low", "medium").collect()] == [(0, 0, 10)]
    _exactly("P5_segments", spark, path)


def test_all_hot_users(spark, sf_dir, tmp_path):
    """more than a thousand of them."""
    path = _tables(sf_dir, tmp_path, events=_typed([(u, "view") for u in range(1200)] * 2, 50_000_000))
    _exactly("A18_hot_users", spark, path)
    assert catalog.QUERIES["A18_hot_users"](spark, path).count() == 1200


def test_search_in_parts_of_blocks(spark, sf_dir, monkeypatch):
    """F8: blocks are cut into parts, and copies of a vector in several of them are ranked by their ids."""
    v = views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    v = v.unionByName(v.filter("vec_id < 7").selectExpr("explode(sequence(1000 + 100 * vec_id, 1020 + 100 * vec_id)) vec_id", "embedding"))
    rows = lambda: sorted(map(tuple, R.similar_vectors(v.filter("vec_id < 7"), v, 5, pivots=3).collect()))
    want = rows()
    monkeypatch.setattr(R, "PART", 16)
    assert rows() == want and [r[1] for r in want if r[0] == 3] == [1300, 1301, 1302, 1303, 1304]


def test_pairs_are_dealt_by_their_number(spark):
    """the tasks that count pairs are as many as the pairs ask for, not a fixed number."""
    baskets = spark.range(600).selectExpr("id % 2 order_id", "id % 7 + 100 * (id div 300) item_id")
    _, pairs = products.P.frequent_pairs(baskets, 1, 3)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert sized.tasks(10, 1_000_000) == 1 and sized.tasks(3e8, 1_000_000) == 300 and plan.count("RepartitionByExpression") >= 3
    items = {o: sorted({r.item_id for r in baskets.filter(f"order_id = {o}").collect()}) for o in (0, 1)}
    want = {}
    for own in items.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    assert {(r.item_id, r.other): r.support for r in pairs.collect()} == want


def test_rows_stay_with_their_users(spark, sf_dir):
    """a user's rows are dealt once; what they are joined with is broadcast while it is small."""
    for name in ("J12_fine_score", "J5_graph_recall", "J11_sequence_vectors"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan and "RepartitionByExpression [user_id" in plan, name


def test_forests_rows_are_dealt_by_their_number(spark, monkeypatch):
    """rows of one input split, equal ones too, go to several tasks of the forest, and the same way each time."""
    seen, fit = [], L.RandomForestRegressor.fit

    def watched(self, data):
        seen.append([r["count"] for r in data.groupBy(F.spark_partition_id()).count().collect()])
        return fit(self, data)

    monkeypatch.setattr(L.RandomForestRegressor, "fit", watched)
    monkeypatch.setattr(L, "tasks", lambda rows, each: sized.tasks(rows, each / 5000), raising=False)
    rows = spark.range(0, 1200, 1, 1).selectExpr("double(if(id < 600, 7, id % 9)) a", "double(id % 5 = 0 and id >= 600) b", "double(if(id < 600, 3, id % 11)) t")
    first, again = (sorted(map(tuple, L.importance(rows, ["a", "b"], "t").collect())) for _ in range(2))
    assert first == again and [r[0] for r in first] == ["a", "b"]
    assert all(sum(x) == 1200 and max(x) <= 110 for x in seen), seen


def test_numbers_are_counted_before_they_are_profiled(spark, sf_dir, tmp_path):
    """F16: rows aren't multiplied by the columns before they are counted; a column of nulls alone is reported."""
    plan = catalog.QUERIES["P4_recommendations"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert all("Aggregate" in below for line, below in zip(plan, plan[1:], strict=False) if "Expand" in line)
    _exactly("P4_recommendations", spark, sf_dir)
    for d in ("some", "all"):
        (tmp_path / d).mkdir()
    rows = "select e.* replace (null::double as value) from events e"
    lines = "select l.* replace ((case when l_orderkey % 9 = 0 then null when l_orderkey % 10 = 1 then 9000 else l_quantity end)::double as l_quantity) from lineitem l"
    some, path = (_tables(sf_dir, d, **own) for d, own in ((tmp_path / "some", {"lineitem": lines}), (tmp_path / "all", {"events": rows, "lineitem": lines})))
    _exactly("P4_recommendations", spark, some)
    got = {tuple(r) for r in catalog.QUERIES["P4_recommendations"](spark, path).collect()}
    assert [code for feature, code in got if feature == "value"] == ["CONSIDER_IMPUTATION"]
    assert {("l_quantity", "CONSIDER_IMPUTATION"), ("l_quantity", "CONSIDER_OUTLIER_TREATMENT"), ("l_quantity", "CONSIDER_LOG_TRANSFORM")} <= got
    li = views.table(spark, path, "lineitem")
    q, want = li.selectExpr("percentile(l_quantity, array(0.25, 0.75)) q").first().q, li.agg(F.skewness("l_quantity"), F.count("l_quantity")).first()
    reach = 1.5 * (q[1] - q[0])
    out = li.filter((F.col("l_quantity") < q[0] - reach) | (F.col("l_quantity") > q[1] + reach)).count()
    r = products.P.number_profile(products.P.value_counts(li, ("l_quantity",))).first()
    assert abs(r.skewness - want[0]) < 1e-9 and r.outlier_share == out / want[1]


def test_similarities_with_every_item(spark, sf_dir, tmp_path, monkeypatch):
    """Round 4, F1: a row a user and item, of several classes of items and blocks of them; items without key or tag have none."""
    kinds = "case p_partkey % 5 when 0 then 'POLISHED STEEL' when 1 then 'PLATED TIN' when 2 then 'BRASS' else p_type end as p_type"
    prices = "(case when p_partkey % 11 = 0 then -1 when p_partkey % 3 = 0 then 1500 else p_retailprice end)::double as p_retailprice"
    path = _tables(sf_dir, tmp_path, part=f"select p.* replace ({kinds}, {prices}, if(p_partkey = 150, null, p_partkey) as p_partkey) from part p")
    monkeypatch.setattr(T, "similar_items", partial(T.similar_items, side=7, run=3), raising=False)
    name = "K8_user_item_tag_similarity"
    _exactly(name, spark, path)
    out = catalog.QUERIES[name](spark, path)
    assert out.columns == ["user_id", "item_id", "similarity"] and out.filter("user_id is null or item_id is null").isEmpty()
    shares = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) > 2000 and len(shares) > 20 and max(shares) < sum(shares) / 5, shares
