"""The corpus operators' whole jobs on cases that a rounded or capped form gets wrong."""

import time
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recfeat.llm import decontam, mixing, neardup, quality

from . import brute


@pytest.mark.parametrize("weights", [{"hot": 10.0 ** 0.7, **{f"s{i:02}": 1.0 for i in range(19)}}, {"a": 0.37, "b": 999.63}, {"a": 1.0, "b": 2.0**0.5, "c": 3.3, "d": 0.01}])
def test_lag_against_the_exact_weights(weights):
    """Over thousands of slots each source is less than one block from its real target, not from a rounded one."""
    total = sum(map(Fraction, weights.values()))
    plan = mixing.phases({s: max(1, int(w / sum(weights.values()) * 20_000)) for s, w in weights.items()}, weights)
    slots = sum(x["n"] for x in plan[0]["sources"].values())
    assert slots > 2000
    for s, x in plan[0]["sources"].items():
        w = Fraction(weights[s]) / total
        for j, t in enumerate(x["slots"]):  # the lag is largest just before and just after a block
            assert w * t - j < 1 and j + 1 - w * (t + 1) < 1
        assert w * slots - x["n"] < 1


def test_blocks_grow_with_the_rows(spark, monkeypatch):
    """The schedule is as long for every table, and every row has its place in it."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.floor(F.sqrt("id") / 5)).alias("source"))
    monkeypatch.setattr(mixing, "SLOTS", 60)
    rows = mixing.mix(docs).collect()
    sources = {r.source for r in rows}
    assert len({r.slot for r in rows}) <= 60 + len(sources) and Counter(Counter(r.slot for r in rows).values()).most_common(1)[0][0] == 9
    assert sorted(r.position for r in rows) == list(range(500))
    at = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.position):
        at[r.source].append(r.block)
    assert all(x == sorted(x) for x in at.values())


def test_many_sources(spark):
    """Twenty thousand sources of a few rows each, as if domains were sources: the work doesn't grow with their square."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("d"), F.floor(F.pow(F.rand(3), 3) * 20_000)).alias("source"))
    docs = docs.union(spark.range(20_000).select(F.col("id") + 60_000, F.concat(F.lit("d"), F.col("id"))))
    begin = time.time()
    mixed = mixing.mix(docs).agg(F.count("*").alias("n"), F.min("position").alias("lo"), F.max("position").alias("hi"), F.countDistinct("position").alias("places"), F.countDistinct("source").alias("sources")).first()
    assert tuple(mixed) == (80_000, 0, 79_999, 80_000, 20_000) and time.time() - begin < 60
    rng = np.random.default_rng(2)
    weights = {i: float(w) for i, w in enumerate(rng.random(3000) ** 4 + 1e-6)}
    (first, *_) = mixing.phases({i: 1 + int(9e4 * w / sum(weights.values())) for i, w in weights.items()}, weights)
    exact, total = {i: Fraction(w) for i, w in weights.items()}, sum(map(Fraction, weights.values()))
    for i, x in first["sources"].items():
        assert all(exact[i] / total * t - j < 1 and j + 1 - exact[i] / total * (t + 1) < 1 for j, t in enumerate(x["slots"]))


def test_rows_without_ids_are_split(spark):
    """Rows of one source without an id have places of their own, and the range partitions can part them."""
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one").alias("source"))
    rows = mixing.mix(docs, keep=()).select("position").collect()
    assert sorted(r.position for r in rows) == list(range(3000))


def _brute_mixture(rows, weights, block):
    """(source, block, slot) by trying every slot: the released block with the least deadline, sources in order."""
    left = {s: -(-n // block) for s, n in Counter(s for _, s in rows).items()}
    done, out, slot = dict.fromkeys(left, 0), [], 0
    while active := sorted(s for s in left if left[s]):
        total, begin, served = sum(Fraction(weights[s]) for s in active), slot, dict.fromkeys(active, 0)
        while all(left[s] for s in active):
            share = {s: Fraction(weights[s]) / total for s in active}
            due = [(-(-(served[s] + 1) // share[s]), s) for s in active if served[s] // share[s] <= slot - begin]
            _, s = min(due)
            out.append((s, done[s], slot))
            served[s], done[s], left[s], slot = served[s] + 1, done[s] + 1, left[s] - 1, slot + 1
    return out


@pytest.mark.parametrize("weights", [{"s0": 0.7, "s1": 0.2, "s2": 0.1}, {"s0": 1.0, "s1": 1.0, "s2": 5.0}, {"s0": 3**0.5, "s1": 2.0, "s2": 0.01}])
def test_mixture_against_brute_force(spark, weights):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.floor(F.sqrt("id") / 6)).alias("source"))
    rows = mixing.mix(docs, weights, block=4).collect()
    want = _brute_mixture([(r.doc_id, r.source) for r in rows], weights, 4)
    assert {(r.source, r.block, r.slot) for r in rows} == set(want)


def test_weights_of_zero_or_none(spark):
    """A source without a weight comes after all others and loses no row; all without one share alike."""
    docs = spark.range(120).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    rows = mixing.mix(docs, {"s0": 1.0, "s1": 0.0}, block=2).collect()
    assert sorted(r.position for r in rows) == list(range(120))
    assert {r.source for r in rows if 2 <= r.position < 40} == {"s0"} or sum(r.source == "s0" for r in rows if r.position < 42) >= 38
    none = sorted(mixing.mix(docs, {}, block=2).collect(), key=lambda r: r.position)
    assert Counter(r.source for r in none[:60]) == {"s0": 20, "s1": 20, "s2": 20}


def _shards(spark, docs, weights, path):
    mixing.mixed(docs, weights, block=4).write.parquet(path)
    return corpus_pipeline.shard(spark, spark.read.parquet(path), "").collect()


def test_weights_reach_the_shards(spark, tmp_path):
    """The pipeline's last stage gives each shard the mixture's proportions, and other rows under other weights."""
    docs = spark.range(2400).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"),
        F.when(F.col("id") < 1800, "a").otherwise("b").alias("source"), F.lit(8).cast("long").alias("n_chars"),
    )
    one, two = _shards(spark, docs, {"a": 3, "b": 1}, str(tmp_path / "1")), _shards(spark, docs, {"a": 1, "b": 1}, str(tmp_path / "2"))
    n = Counter((r.shard, r.source) for r in one)
    assert all(abs(n[s, "a"] - 75) <= 8 and abs(n[s, "b"] - 25) <= 8 for s in range(24))
    n = Counter((r.shard, r.source) for r in two)
    assert all(abs(n[s, "b"] - 50) <= 8 for s in range(11)) and all(n[s, "a"] == 100 for s in range(13, 24))
    for rows in (one, two):
        assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in range(24) for i in range(100)]
        assert {r.doc_id for r in rows} == set(range(2400))


@pytest.mark.parametrize(("copies", "unique", "kept"), [(2, 50, True), (10, 129, False), (10, 400, True)])
def test_repeated_passage_of_five_words(copies, unique, kept):
    """Later occurrences count: 25 % of a text in nine later copies fails, though all ten are under 30 %."""
    words, at = [], 0
    for i in range(copies):
        step = unique * (i + 1) // copies
        words += [*(f"u{j:03}" for j in range(at, step)), "aaaa", "bbbb", "cccc", "dddd", "eeee"]
        at = step
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    m = quality.measure(data, np.array([0, len(data)]))
    assert m["later_5"][0] == pytest.approx(5 * (copies - 1) / (unique + 5 * copies))
    assert m["dup_5"][0] < 0.3 or copies == 2
    assert bool(quality.verdicts(m)[1][0]) == kept


def test_tested_pairs_grow_with_the_members(spark, monkeypatch):
    """A family of copies without their original, most of them not linked: pairs tested stay a small multiple of the
    members, and no link is lost.  Rows that the join makes before its filters grow with the square of such a family, by
    about a tenth of all its pairs' number: a known limit, which the last line keeps from getting worse."""
    rng, tested, joined = np.random.default_rng(5), [], []

    def counted(pairs, *args, f=neardup._confirm):
        tested.append(pairs.count())
        return f(pairs, *args)

    def stored(df, name, *args, f=neardup.stash):
        out = f(df, name, *args)
        if name == "apart-heads":  # the equi-join on centre and item, before any other condition
            ends = out.groupBy("centre", "item").agg(F.count_if(F.col("place") < F.col("probe")).alias("x"), F.count_if(F.col("place") < F.col("index")).alias("y"))
            joined.append(ends.agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0))).first()[0])
        return out

    monkeypatch.setattr(neardup, "_confirm", counted)
    monkeypatch.setattr(neardup, "stash", stored)
    per_member = []
    for n in (100, 400):
        rows = []
        for i in range(n):
            words = [f"b{j}" for j in range(60)]
            for j in rng.choice(60, 3, replace=False):
                words[j] = f"x{i}-{j}"
            rows.append((i, " ".join(words)))
        tested.clear(), joined.clear()
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near(rows, 2)
        per_member.append((sum(tested) / n, sum(joined) / n))
    assert per_member[1][0] < 2 * per_member[0][0] and per_member[1][0] < 48
    assert all(joined < n / 8 for n, (_, joined) in zip((100, 400), per_member, strict=True))


def test_columns_whose_names_clash(spark, tmp_path):
    """No stage loses or confuses a user's own columns."""
    docs = spark.createDataFrame([(i, f"some text number {i} of ten words a b c d", "en", "s", 1) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(c) for c in ("gone_0", "_gone", "_dirty", "size", "curve", "mix_file", "mix_at", "_row", "shard", "slot")})
    items = spark.createDataFrame([(1, "nothing of this kind stands there")], "item_id long, text string")
    assert neardup.deduplicate(docs).columns == docs.columns and decontam.decontaminate(docs, items).count() == 6
    docs.write.parquet(str(tmp_path / "d"))
    out = corpus_pipeline.shard(spark, spark.read.parquet(str(tmp_path / "d")), "")
    assert {c for c in docs.columns if c not in ("shard", "slot")} <= set(out.columns)
    assert {r["size"] for r in out.collect()} == {"size"} and {r.mix_at for r in out.collect()} == {"mix_at"}
