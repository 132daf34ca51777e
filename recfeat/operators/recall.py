"""Recall channels, quotas, ranking scores and ranked-list exports, for all users at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recfeat.functions.exprs import action_weight, seconds_between
from recfeat.functions.sized import listed, small, tasks

#: Pivots at most that vectors are dealt to.
PIVOTS = 1024
#: Vectors at most, about, that one group of a search holds.
PART = 4096


def top_k(df: DataFrame, k: int, score: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """the ``k`` best rows, or the k best of each group, with their rank; ties go to the smaller id."""
    if not by:
        return df.orderBy(F.desc(score), F.asc(tie)).limit(k)
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))).cast("long")).filter(F.col("rank") <= k)


def hot_items(interactions: DataFrame, k: int) -> DataFrame:
    """Popularity .1 x weights {view 1, click 2, cart 3, purchase 5} plus half the log of clicks."""
    weight = action_weight(F.col("action"), "graph")
    out = interactions.groupBy("item_id").agg((F.sum(weight) * 0.1 + 0.5 * F.log1p(F.count(F.when(F.col("action") == "click", 1)))).alias("score"))
    return top_k(out.withColumn("score", F.round("score", 6)), k, "score", "item_id")


def category_recall(interactions: DataFrame, per_user: int = 3, k: int = 30) -> DataFrame:
    """Popular items of each user's most used categories, k / categories of each."""
    cats = interactions.groupBy("user_id", "category_id").agg(F.count(F.lit(1)).alias("n"))
    cats = top_k(cats, per_user, "n", "category_id", ["user_id"]).select("user_id", "category_id")
    items = interactions.groupBy("category_id", "item_id").agg(F.count(F.lit(1)).alias("popularity"))
    items = top_k(items, k // per_user, "popularity", "item_id", ["category_id"]).drop("rank")
    return cats.join(items, "category_id").select("user_id", "item_id", F.col("popularity").cast("double").alias("score"))


def new_items(interactions: DataFrame, as_of, days: int, k: int) -> DataFrame:
    """Items first seen in the last ``days`` days, popularity x (1 + freshness)."""
    age = seconds_between(F.lit(as_of).cast("timestamp"), F.min("ts")) / 86_400
    out = interactions.groupBy("item_id").agg(age.alias("age"), F.count(F.lit(1)).alias("n"))
    out = out.withColumn("score", F.round(F.col("n") * (1 + F.greatest(F.lit(0.0), 1 - F.col("age") / days)), 6))
    return top_k(out.filter(F.col("age") <= days).select("item_id", "n", "score"), k, "score", "item_id")


def seasonal_items(interactions: DataFrame, season: int, k: int) -> DataFrame:
    """Items of the season's boosted categories."""
    boosts = {1: {2: 1.5, 5: 1.5}, 3: {2: 1.3, 4: 1.3}}.get(season, {})
    if not boosts:
        return interactions.select("item_id", F.lit(0.0).alias("score")).limit(0)
    table = F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv])
    out = interactions.groupBy("item_id", "category_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("category_id").isin(list(boosts)))
    return top_k(out.select("item_id", F.round(F.col("n") * F.try_element_at(table, F.col("category_id")), 6).alias("score")), k, "score", "item_id")


def attention_edges(interactions: DataFrame, as_of) -> DataFrame:
    """Item -> next item of the same user, weighted by action and age in days, normalised per item."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    days = seconds_between(F.lit(as_of).cast("timestamp"), F.col("ts")) / 86_400
    steps = interactions.select(F.lag("item_id").over(w).alias("src"), F.col("item_id").alias("dst"), (action_weight(F.col("action"), "graph") * F.exp(-0.1 * days)).alias("w"))
    edges = steps.filter("src is not null and src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return edges.withColumn("weight", F.col("w") / F.sum("w").over(W.partitionBy("src"))).filter("w > 0").select("src", "dst", F.round("weight", 6).alias("weight"))


def merge_channels(**channels: DataFrame) -> DataFrame:
    """Union with source tags; duplicates keep the best score and all sources."""
    parts = [df.select("user_id", "item_id", "score", F.lit(name).alias("source")) for name, df in channels.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("user_id", "item_id").agg(
        F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.max_by("source", F.struct("score", "source")).alias("best_source"),
    )


def quota(df: DataFrame, per_category: int, k: int, by: list[str]) -> DataFrame:
    """at most ``per_category`` rows of a category, then the ``k`` best, in each group."""
    w = W.partitionBy(*by, "category_id").orderBy(F.desc("score"), F.asc("item_id"))
    return top_k(df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per_category).drop("_rn"), k, "score", "item_id", by)


def _helpers():
    """Rows of length 1 (vectors without a direction stay 0), and a matrix as lists; made here so that tasks get them with their function."""

    def unit(lists: pa.Array, dims: int) -> np.ndarray:
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), dims)
        length = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, length, out=np.zeros_like(x), where=length > 0)

    def packed(m: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))

    return unit, packed


def _placed(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, unit, block, angle): each vector's direction, nearest pivot and the angle to it."""
    directions, packed = _helpers()

    def work(batches):
        for batch in batches:
            unit = directions(batch.column(1), pivots.shape[1])
            near = unit @ pivots.T
            block = near.argmax(1)
            angle = np.arccos(np.clip(near[np.arange(len(unit)), block], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), packed(unit), pa.array(block, pa.int32()), pa.array(angle)], names=["vec_id", "unit", "block", "angle"])

    return vectors.filter("embedding is not null").select(F.col("vec_id").cast("long"), "embedding").mapInArrow(work, "vec_id long, unit array<double>, block int, angle double")


def _reached(queries: DataFrame, pivots: np.ndarray, blocks: np.ndarray, k: int, seeds: bool) -> DataFrame:
    """(query_id, q, block, part) of the blocks that each query (vec_id, embedding, bar) is compared with: with ``seeds`` the
    nearest ones that hold ``k`` vectors beside it, else those of the others that may hold a similarity of ``bar``."""
    ids, n, lo, hi, parts = blocks.T
    directions, packed = _helpers()

    def work(batches):
        for batch in (piece for whole in batches for piece in (whole.slice(i, 512) for i in range(0, len(whole), 512))):
            unit = directions(batch.column(1), pivots.shape[1])
            at = np.arccos(np.clip(unit @ pivots[ids.astype(int)].T, -1, 1))
            least = np.maximum(0, np.maximum(at - hi, lo - at))
            order = np.lexsort((at, least))
            held = n[order]
            first = np.empty(at.shape, bool)
            np.put_along_axis(first, order, held.cumsum(1) - held < k + 1, 1)
            bar = np.asarray(batch.column(2), np.float64)[:, None]
            row, col = np.nonzero(first if seeds else ~first & (np.cos(least) >= bar))
            copies = parts[col].astype(int)  # a row for each part of the block
            part = np.arange(copies.sum()) - np.repeat(copies.cumsum() - copies, copies)
            row, col = np.repeat(row, copies), np.repeat(col, copies)
            for i in range(0, len(row), 8192):
                r, c = row[i : i + 8192], col[i : i + 8192]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), packed(unit[r]), pa.array(ids[c].astype(np.int32)), pa.array(part[i : i + 8192].astype(np.int32))], names=["query_id", "q", "block", "part"])

    return queries.select(F.col("vec_id").cast("long"), "embedding", "bar").mapInArrow(work, "query_id long, q array<double>, block int, part int")


def _best(k: int):
    """The ``k`` best vectors of a part of a block for each of its queries; ties go to the smaller id."""

    def work(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        ids, mine = np.asarray(vectors["vec_id"]), np.asarray(queries["query_id"])
        order = ids.argsort()
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(ids) and len(mine):
            matrix = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
            q, v, ids = matrix(queries["q"]), matrix(vectors["unit"])[order], ids[order]
            step = max(1, 2_000_000 // len(ids))
            for i in range(0, len(mine), step):
                s = q[i : i + step] @ v.T
                s = np.sign(s) * np.floor(np.abs(s) * 1e6 + 0.5) / 1e6 + 0.0
                s[mine[i : i + step, None] == ids] = -np.inf
                bar = np.partition(s, -k, 1)[:, -k, None] if len(ids) > k else -2.0
                row, col = np.nonzero((s >= bar) & (s > -np.inf))
                by = np.lexsort((col, -s[row, col], row))
                row, col = row[by], col[by]
                taken = np.arange(len(row)) - np.searchsorted(row, row) < k
                for x, y in zip(found, (mine[i + row[taken]], ids[col[taken]], s[row, col][taken]), strict=True):
                    x.append(y)
        return pa.table([pa.array(np.concatenate(x)) for x in found], names=["query_id", "vec_id", "similarity"])

    return work


def _searched(queries: DataFrame, vectors: DataFrame, k: int, pivots: int | None = None):
    """What J3 compares: (placed vectors, first blocks of the queries, their best, further blocks), or None without vectors.

    Vectors are dealt to the nearest of some pivots, about the square root of their number and PIVOTS at most.  Angles obey the
    triangle inequality, so a block is no nearer to a query than the difference of their angles to the pivot.  A query is
    compared with the nearest blocks that hold k vectors beside it; elsewhere only with blocks that can beat the k-th of
    these.  Blocks of more than PART vectors are cut into parts; a part meets its queries in one product of matrices.
    """
    count = pivots or max(1, min(PIVOTS, int(vectors.count() ** 0.5)))
    first = vectors.filter("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).collect()  # PIVOTS rows at most
    if not first:
        return None
    units = _helpers()[0](pa.array([r.embedding for r in first], pa.list_(pa.float64())), len(first[0].embedding))
    placed = _placed(vectors, units)
    stats = placed.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi")).withColumn("parts", F.ceil(F.col("n") / PART)).orderBy("block").collect()
    blocks = np.array([tuple(r) for r in stats], np.float64)  # a row a pivot
    parts = F.create_map(*[F.lit(x) for r in stats for x in (r.block, int(r.parts))])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.try_element_at(parts, F.col("block"))).cast("int"))
    q = queries.filter("embedding is not null").select("vec_id", "embedding")
    seeds = _reached(q.withColumn("bar", F.lit(None).cast("double")), units, blocks, k, True)
    near = _compared(seeds, placed, k)
    # Similarities are rounded; the bar is lowered by as much.
    bar = top_k(near, k, "similarity", "vec_id", ["query_id"]).groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) < k, -2.0).otherwise(F.min("similarity") - 2e-6).alias("bar"))
    rest = _reached(q.join(bar, "vec_id", "left").withColumn("bar", F.coalesce("bar", F.lit(-2.0))), units, blocks, k, False)
    return placed, seeds, near, rest


def _compared(reached: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    grouped = reached.groupBy("block", "part").cogroup(placed.select("block", "part", "vec_id", "unit").groupBy("block", "part"))
    return grouped.applyInArrow(_best(k), "query_id long, vec_id long, similarity double")


def compared_vectors(queries: DataFrame, vectors: DataFrame, k: int, pivots: int | None = None) -> DataFrame:
    """(query_id, vec_id) of all pairs that J3 compares for the ``k`` best of each query."""
    found = _searched(queries, vectors, k, pivots)
    if found is None:
        return vectors.select(F.col("vec_id").alias("query_id"), "vec_id").limit(0)
    placed, seeds, _, rest = found
    return seeds.union(rest).join(placed, ["block", "part"]).filter("query_id <> vec_id").select("query_id", "vec_id")


def similar_vectors(queries: DataFrame, vectors: DataFrame, k: int, pivots: int | None = None) -> DataFrame:
    """Exact cosine top-k of a query set among ``vectors`` (vec_id, embedding), without comparing all pairs; null vectors
    are nobody's neighbours and have none."""
    found = _searched(queries, vectors, k, pivots)
    if found is None:
        best = vectors.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("similarity")).limit(0)
    else:
        placed, _, near, rest = found
        best = near.union(_compared(rest, placed, k))
    return top_k(best, k, "similarity", "vec_id", ["query_id"])


def ranked_list(df: DataFrame, key: str = "user_id") -> DataFrame:
    """A user's list as item:rank text and as parallel arrays with scores in millionths."""
    order = F.sort_array(F.collect_list(F.struct("rank", "item_id", "score")))
    out = df.groupBy(key).agg(order.alias("x"))
    join = lambda f: F.array_join(F.transform("x", f), ",")
    return out.select(
        key, F.size("x").cast("long").alias("n"), join(lambda x: F.concat_ws(":", x["item_id"].cast("string"), x["rank"].cast("string"))).alias("items"),
        join(lambda x: F.round(x["score"] * 1_000_000).cast("long").cast("string")).alias("micros"),
    )


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str) -> DataFrame:
    """For each left row the value of the latest right row of its key with right time <= left time."""
    a = left.select(key, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias(value), F.struct(*left.columns).alias("_row"))
    b = right.select(key, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), value, F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    w = W.partitionBy(key).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("_side = 1").select("_row.*", value)


def score_parts(position: Column, length: Column, share: Column, popularity: Column, similarity: Column) -> Column:
    """.5 similarity + .2 position term + .2 category share + .1 popularity."""
    return 0.5 * similarity + 0.2 * F.when(position.isNull(), 0.0).otherwise(-(1 - position / length)) + 0.2 * share + 0.1 * popularity


def grid(users: DataFrame, items: DataFrame, most: int = 10_000) -> DataFrame:
    """Every user with every item of a short list; a longer one than ``most`` raises."""
    return users.crossJoin(listed(items, "a grid's items", most))


def range_join(left: DataFrame, right: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Left rows with every right row of their key whose [start, end] holds ``at``; rows without any stay, with nulls.

    Both sides meet in slots of ``width`` on the time axis as well as on the key: a right row goes to each slot that it
    touches, so no slot sees more than its own rows and the range is tested inside it.
    """
    slots = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    r = right.select(F.col(key).alias("_key"), F.explode(slots).alias("_slot"), *[F.col(c) for c in right.columns if c != key])
    a = left.withColumn("_at_slot", F.floor(F.col(at) / width))
    on = (F.col(key) == F.col("_key")) & (F.col("_at_slot") == F.col("_slot")) & (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))
    return a.join(r, on, "left").drop("_key", "_slot", "_at_slot")


def neighbour_recall(history: DataFrame, edges: DataFrame, popularity: DataFrame, k: int, neighbours: int = 5, boost: float = 1.2) -> DataFrame:
    """An item's strongest edges lead to its neighbours; edges to them count ``boost`` times, and each adds half of the
    neighbour's popularity.  Items of the history are left out."""
    near = F.row_number().over(W.partitionBy("src").orderBy(F.desc("weight"), F.asc("dst"))) <= neighbours
    out = edges.withColumn("near", near).join(popularity.select(F.col("item_id").alias("dst"), "popularity"), "dst")
    part = F.col("weight") * F.when(F.col("near"), boost).otherwise(1.0) + F.when(F.col("near"), 0.5 * F.col("popularity")).otherwise(0.0)
    out = small(out.select("src", "dst", "weight", "near", "popularity"), 1_000_000)
    history = history.repartition(tasks(history.count(), 10_000), "user_id")  # an item leads to many: few users a task
    reached = history.join(out, history.item_id == out.src).groupBy("user_id", F.col("dst").alias("item_id")).agg(F.round(F.sum(part), 6).alias("score"))
    return top_k(reached.join(history, ["user_id", "item_id"], "left_anti"), k, "score", "item_id", ["user_id"])
