"""Queries over all rows, against brute force: no id subset, no cap, no shortfall."""

import math
from collections import Counter, defaultdict

import pytest

from recfeat import views
from recfeat.operators import features as O
from recfeat.plans import catalog, profiles


def test_tag_similarity_of_all_items(spark, sf_dir):
    tags = defaultdict(list)
    for r in profiles._item_tags(spark, sf_dir).collect():
        tags[r.item_id].append(r.tag)
    weights = defaultdict(Counter)
    for r in views.interactions(spark, sf_dir).select("user_id", "item_id").collect():
        weights[r.user_id].update(tags.get(r.item_id, []))
    want = {}
    for user, w in weights.items():
        norm = math.sqrt(sum(x * x for x in w.values()))
        for item, own in tags.items():
            if any(t in w for t in own):
                want[user, item] = sum(w[t] for t in own) / norm / math.sqrt(len(own))
    rows = catalog.QUERIES["K8_user_item_tag_similarity"](spark, sf_dir).collect()
    assert max(i for _, i in want) >= 60 and len(rows) == len(want)
    assert {(r.user_id, r.item_id): r.similarity for r in rows} == pytest.approx(want, abs=1e-6)


def test_fm_pairs_of_all_vectors(spark, sf_dir):
    groups = defaultdict(list)
    for r in views.table(spark, sf_dir, "embeddings").select("label", "embedding").collect():
        groups[r.label].append(r.embedding)
    want = {k: sum(0.5 * (sum(x) ** 2 - sum(v * v for v in x)) for x in zip(*e, strict=True)) for k, e in groups.items()}
    rows = catalog.QUERIES["R10_fm_pairs"](spark, sf_dir).collect()
    assert len(rows) == len(want) and {r.label: r.pairs for r in rows} == pytest.approx(want, abs=1e-3)


def _events(spark, rows, path):
    """An events table of (user, item, type)."""
    df = spark.createDataFrame([(n, u, k, i) for n, (u, i, k) in enumerate(rows)], "event_id long, user_id long, event_type string, k int")
    made = df.selectExpr("event_id", "timestamp '2024-01-30 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, event_id % 3600) ts", "user_id", "event_type", "1.0D value", "concat('{\"k\": ', k, '}') props")
    made.write.parquet(f"{path}/events.parquet")
    return str(path)


def test_negatives_are_complete(spark, sf_dir, tmp_path):
    wide = [(u, (u * 37 + i * 11) % 700, "purchase" if i % 3 == 0 else "view") for u in range(1, 8) for i in range(u * u * 3)]
    wide += [(8, i, "purchase") for i in range(690)] + [(9, i, "view") for i in range(700)] + [(10, i, "purchase") for i in range(700)]
    for path in (sf_dir, _events(spark, wide, tmp_path)):
        seen, bought = defaultdict(set), defaultdict(set)
        for r in views.interactions(spark, path).select("user_id", "item_id", "action").collect():
            seen[r.user_id].add(r.item_id)
            if r.action == "purchase":
                bought[r.user_id].add(r.item_id)
        items = set().union(*seen.values())
        rows = catalog.QUERIES["R3_negative_samples"](spark, path).collect()
        assert len(rows) == len({(r.user_id, r.item_id) for r in rows}) and all(r.item_id in items - seen[r.user_id] for r in rows)
        want = {u: min(4 * len(b), len(items - seen[u])) for u, b in bought.items()}
        assert Counter(r.user_id for r in rows) == {u: n for u, n in want.items() if n}


@pytest.mark.parametrize("full", [False, True])
def test_similarity_of_long_histories(spark, full):
    """Users with more than 500 items count with all of them."""
    rows = [(u, i, 1.0 + (u * i) % 7) for u in range(6) for i in range(0, 520, 1 + u % 2)] + [(9, i, 2.0) for i in range(30)]
    of, norm = defaultdict(list), Counter()
    for u, i, s in rows:
        of[u].append((i, s))
        norm[i] += s * s
    want = defaultdict(lambda: [0, 0.0, 0.0, 0.0])
    for own in of.values():
        for a, s in own:
            for b, t in own:
                if a < b:
                    w = want[a, b]
                    w[:] = w[0] + 1, w[1] + s * t, w[2] + s * s, w[3] + t * t
    want = {p: (n, d / math.sqrt(norm[p[0]] * norm[p[1]] if full else q * r)) for p, (n, d, q, r) in want.items() if n >= 5}
    got = O.item_similarity(spark.createDataFrame(rows, "user_id long, item_id int, score double"), full_norms=full).collect()
    assert {(r.item1, r.item2): r.users for r in got} == {p: n for p, (n, _) in want.items()} and len(got) == len(want)
    assert all(abs(r.similarity - want[r.item1, r.item2][1]) < 2e-6 for r in got)


def test_no_list_or_single_window(spark, sf_dir):
    """No row holds all prices of an item, and no window runs over all time buckets."""
    plan = lambda q: catalog.QUERIES[q](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan("S1_percentile_element")
    assert "windowspecdefinition(run" in plan("M11_sentiment_trend")
