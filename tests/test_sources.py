"""Sources and sinks round trips."""

import json

import pytest
from pyspark.sql import functions as F

from recfeat.operators import recall, store
from recfeat.operators import tags as T
from recfeat.sources import dictionary, files, kafka
from recfeat.streaming import windows


def test_json_logs(spark, tmp_path):
    rows = [{"user_id": "u1", "item_id": "i1", "action": "view", "timestamp": 1704067200000, "session_id": "s", "platform": "PS5"}, {"user_id": None, "item_id": "i1", "timestamp": 5}]
    (tmp_path / "a.json").write_text("\n".join([json.dumps(rows[0]), json.dumps(rows[0]), json.dumps(rows[1]), "{broken"]))
    logs = files.read_json_logs(spark, str(tmp_path / "a.json"))
    assert logs.count() == 4
    got = files.clean(logs).collect()
    assert len(got) == 1 and (got[0].hour, got[0].day_of_week, str(got[0].date)) == (0, 2, "2024-01-01")


def test_partitioned_overwrite(spark, tmp_path):
    path = str(tmp_path / "p")
    files.write_parquet(spark.createDataFrame([(1, "a"), (2, "b")], "x int, date string"), path, "date")
    files.write_parquet(spark.createDataFrame([(3, "b")], "x int, date string"), path, "date")
    assert {(r.x, r.date) for r in files.read_parquet(spark, path).collect()} == {(1, "a"), (3, "b")}


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "n int, m int")
    files.write_statistics(df, str(tmp_path / "s"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "s")).collect()] == [{"n": 1, "m": 2}]
    rows = spark.range(1).select(F.lit("u").alias("user_id"), F.lit("i").alias("item_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    files.write_atomic(rows, str(tmp_path / "t"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t"))
    assert back.columns == ["user_id:token", "item_id:token", "timestamp:float"] and back.count() == 1


def test_event_parser(spark):
    raw = spark.createDataFrame([('{"user_id":"u","item_id":"i","action":"view","timestamp":"2024-01-01T00:00:05","price":1.5}',), ("junk",), (None,)], "value string")
    got = kafka.parse_events(raw).collect()
    assert len(got) == 1 and got[0].price == 1.5 and str(got[0].ts) == "2024-01-01 00:00:05"


def test_tag_dictionary(spark, tmp_path):
    """The dictionary's file becomes tables that tagging and the relation checks take."""
    made = {
        "version": "1",
        "tags": [
            {"tag": "metal", "dimension": "material"}, {"tag": "steel", "dimension": "material", "parent": "metal", "keywords": ["STEEL", "IRON"], "weight": 1.2},
            {"tag": "cheap", "dimension": "price", "low": 0, "high": 100}, {"name": "no tag"}, {"tag": "metal", "dimension": "material"},
        ],
        "exclusive": [["steel", "cheap"], ["cheap", "steel"], ["one"]], "requires": [{"tag": "cheap", "needs": ["steel", "metal"]}],
    }
    (tmp_path / "d.json").write_text(json.dumps(made, indent=1))
    t = dictionary.read_dictionary(spark, str(tmp_path / "d.json"))
    assert {(r.tag, r.parent, r.weight) for r in t["tags"].collect()} == {("metal", None, 1.0), ("steel", "metal", 1.2), ("cheap", None, 1.0)} and t["tags"].count() == 3
    assert {tuple(r) for r in t["keywords"].collect()} == {("steel", "STEEL"), ("steel", "IRON")}
    assert [tuple(r) for r in t["exclusive"].collect()] == [("cheap", "steel")] and t["implies"].count() == 0
    assert {tuple(r) for r in t["requires"].collect()} == {("cheap", "steel"), ("cheap", "metal")}
    tree = T.closure(t["tags"])
    held = spark.createDataFrame([(1, "steel"), (2, "cheap"), (3, "steel"), (3, "cheap")], "item_id int, tag string")
    assert {tuple(r) for r in T.implied_tags(held, tree).collect()} == {(1, "metal"), (3, "metal")}
    assert {tuple(r) for r in T.missing_dependencies(held, tree, t["requires"]).collect()} == {(2, "cheap", "steel"), (2, "cheap", "metal")}


def test_closure_has_no_depth_limit(spark):
    chain = spark.createDataFrame([("t0", None)] + [(f"t{i}", f"t{i - 1}") for i in range(1, 7)], "tag string, parent string")
    assert {(r.tag, r.ancestor): r.distance for r in T.closure(chain).collect()} == {(f"t{i}", f"t{j}"): i - j for i in range(7) for j in range(i)}
    with pytest.raises(ValueError):
        T.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "tag string, parent string"))


def test_dimension_of_a_stream(spark, tmp_path):
    """Events of a stream get the columns of a lookup table; those without a row there stay."""
    spark.createDataFrame([(1, 10), (2, 11), (3, 99)], "event_id long, item_id long").write.parquet(str(tmp_path / "in"))
    items = spark.createDataFrame([(10, "a"), (11, "b")], "item_id long, brand string")
    stream = spark.readStream.schema("event_id long, item_id long").parquet(str(tmp_path / "in"))
    for most in (1_000_000, 1):
        name = f"dimension_{most}"
        query = windows.with_dimension(stream, items, "item_id", most).writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        query.awaitTermination()
        assert {(r.event_id, r.brand) for r in spark.table(name).collect()} == {(1, "a"), (2, "b"), (3, None)}


def test_grid_refuses_long_lists(spark):
    with pytest.raises(ValueError):
        recall.grid(spark.range(3), spark.range(5), most=4)
    assert recall.grid(spark.range(3).toDF("u"), spark.range(4).toDF("i"), most=4).count() == 12


def test_fusion_by_name(spark):
    """S3: strategies are chosen by name and may be added; weights stay finite for old values."""
    row = spark.createDataFrame([(10.0, 3600.0, 20.0, 300.0)], "a double, x double, b double, y double")
    cols = [row[c] for c in ("a", "x", "b", "y")]
    assert row.select(store.fuse(*cols)).first()[0] == 20.0
    assert row.select(store.fuse(*cols, "weighted")).first()[0] == pytest.approx(15.0)
    assert row.select(store.fuse(F.lit(1.0), F.lit(1e7), F.lit(2.0), F.lit(1e7), "weighted")).first()[0] == 1.0
    store.FUSIONS["mean"] = lambda a, _, b, __: (a + b) / 2
    try:
        assert row.select(store.fuse(*cols, "mean")).first()[0] == 15.0
    finally:
        del store.FUSIONS["mean"]
