"""Interleaving sources by target weights with Pfair scheduling, with DataFrame operations only.

A source of weight w, its part of the sum of the weights, has the release time floor(j / w) and the deadline
ceil((j + 1) / w) for its block j.  Serving the released block with the earliest deadline in each slot keeps every
source less than one block from its exact target at all times.  The weights are taken as whole numbers, without
rounding, so the bound holds however long a phase is.  When a source has run out, the rest go on with their weights
scaled up, as a new phase.  The driver works out the slot of each block in steps that grow with the logarithm of the
number of sources; a block is one of SLOTS equal runs of the rows, so the schedule is as long for every table, and rows
find their block's slot by a join.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ranked

#: Blocks of a table, beside a last short one of each source.
SLOTS = 1 << 16


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights."""
    exact = [Fraction(w) for w in weights]
    scale = lcm(*(x.denominator for x in exact))
    return [int(x * scale) for x in exact]


class _Waiting:
    """Sources that a phase hasn't served yet, found by earliest first deadline, then by place."""

    def __init__(self, parts: list[int]):
        self.by_part = sorted(range(len(parts)), key=lambda i: (-parts[i], i))
        self.falling = [-parts[i] for i in self.by_part]
        self.place = [0] * len(parts)
        for at, i in enumerate(self.by_part):
            self.place[i] = at
        self.size = 1 << max(0, (len(parts) - 1).bit_length())
        self.none = len(parts)
        self.least = [self.none] * (2 * self.size)  # the least source of each range of places
        self.heap: list[int] = []

    def add(self, i: int) -> None:
        heapq.heappush(self.heap, self.place[i])
        self._put(i, i)

    def take(self, i: int) -> None:
        self._put(i, self.none)

    def _put(self, i: int, value: int) -> None:
        at = self.place[i] + self.size
        self.least[at] = value
        while at > 1:
            at >>= 1
            self.least[at] = min(self.least[2 * at], self.least[2 * at + 1])

    def first(self, total: int) -> tuple[int, int] | None:
        """(deadline, source): of those whose first deadline is earliest, the first one."""
        while self.heap and self.least[self.heap[0] + self.size] == self.none:
            heapq.heappop(self.heap)
        if not self.heap:
            return None
        deadline = -(total // self.falling[self.heap[0]])
        # Parts of total / deadline or more are due by then; they stand first.
        lo, hi, found = self.size, self.size + bisect_left(self.falling, 1 - -(-total // deadline)), self.none
        while lo < hi:
            if lo & 1:
                found, lo = min(found, self.least[lo]), lo + 1
            if hi & 1:
                hi -= 1
                found = min(found, self.least[hi])
            lo, hi = lo >> 1, hi >> 1
        return deadline, found


def phases(blocks: dict, weights: dict) -> list[dict]:
    """The phases of the schedule: first slot, and for each source that it serves the first block, block count and slots.

    ``blocks`` has the number of blocks of each source.  A phase ends when a source has run out; what it costs depends on
    the blocks that it serves, not on the sources that wait.
    """
    names = [s for s in blocks if blocks[s] > 0]
    given = [float(weights.get(s) or 0) for s in names]
    least = max(given, default=0.0) * 1e-9 or 1.0
    parts = whole([max(w, least) for w in given])
    left, done = [blocks[s] for s in names], [0] * len(names)
    total, base, out, waiting = sum(parts), 0, [], _Waiting(parts)
    for i in range(len(names)):
        waiting.add(i)
    while total:
        served: dict[int, list[int]] = {}
        ready: list[tuple[int, int]] = []
        released: dict[int, list[int]] = {}
        slot, over = 0, None
        while over is None:
            for i in released.pop(slot, ()):
                heapq.heappush(ready, (-(-(len(served[i]) + 1) * total // parts[i]), i))
            fresh = waiting.first(total)
            if fresh is not None and (not ready or fresh < ready[0]):
                i = fresh[1]
                waiting.take(i)
                served[i] = []
            else:
                i = heapq.heappop(ready)[1]
            served[i].append(slot)
            slot += 1
            if len(served[i]) == left[i]:
                over = i
            else:
                released.setdefault(max(slot, len(served[i]) * total // parts[i]), []).append(i)
        out.append({"base": base, "sources": {names[i]: {"first": done[i], "n": len(t), "slots": t} for i, t in served.items()}})
        for i, t in served.items():
            done[i] += len(t)
            left[i] -= len(t)
            base += len(t)
            if left[i]:
                waiting.add(i)
        total -= parts[over]
    return out


def period_table(parts: list[int]) -> list[list[int]]:
    """For each source the slots of its blocks in one period, in which it has as many as its part."""
    total = sum(parts)
    first = phases({i: 2 * x for i, x in enumerate(parts)}, dict(enumerate(parts)))[0]["sources"]
    return [[t for t in first[i]["slots"] if t < total] for i in range(len(parts))]


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a table, broadcast if they are few enough."""
    made = spark.createDataFrame(rows, schema)
    return F.broadcast(made) if len(rows) <= BROADCAST_ROWS else made


def placed_blocks(spark: SparkSession, plan: list[dict], counts: dict, block: int, offset: dict) -> DataFrame:
    """_g (the block's number over all sources, from ``offset``), phase, slot and first position of each block: SLOTS rows and
    one for each source."""
    made = []
    for p, phase in enumerate(plan):
        for s, x in phase["sources"].items():
            for j, t in enumerate(x["slots"], x["first"]):
                made.append((phase["base"] + t, p, offset[s] + j, min(block, counts[s] - j * block)))
    rows, at = [], 0
    for slot, p, g, n in sorted(made):
        rows.append((g, p, slot, at))
        at += n
    return _small(spark, rows, "_g long, phase int, slot long, _first long")


def mix(docs: DataFrame, weights: dict | None = None, alpha: float = 0.7, block: int | None = None, keep: tuple[str, ...] = (), id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """doc_id, source, the columns ``keep``, phase, block, slot and position (0 .. rows-1 in the mixed order).

    ``weights`` gives each source's target weight; without it a source of n rows weighs n ** ``alpha``.  A weight of
    zero or none counts as 1e-9 of the largest, so that its rows come last.  No row is dropped or repeated: a source's
    rows go, in an order that a hash of the id shuffles, into blocks of ``block`` rows (the last may be shorter), by
    default a SLOTS-th of all rows.  The null source is a source of its own; null and repeated ids each keep their row,
    those without an id in the order of the files.  An empty table gives an empty result.
    The number of distinct sources is metadata and is brought to the driver with one count each.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), *[F.col(c) for c in keep if c not in (id_col, source_col)],
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = ranked(rows.withColumn("_shuffle", F.xxhash64(F.coalesce("doc_id", "_tie"))), ["source", "_shuffle", "doc_id", "_tie"], "mix").drop("_shuffle", "_tie")
    found = {r.source: (r.n, r.start) for r in order.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("start")).collect()}
    sources = sorted(found, key=lambda s: (s is not None, s))
    counts = {s: found[s][0] for s in sources}
    block = block or max(1, -(-sum(counts.values()) // SLOTS))
    target = weights if weights is not None else {s: counts[s] ** alpha for s in sources}
    blocks = {s: -(-counts[s] // block) for s in sources}
    offset, before = {}, 0
    for s in sources:
        offset[s], before = before, before + blocks[s]
    ids = _small(spark, [(s, found[s][1], offset[s]) for s in sources], "_s string, _start long, _offset long")
    placed = (
        order.join(ids, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_at", F.col("rank") - F.col("_start"))
        .withColumn("block", F.expr(f"_at div {block}L")).withColumn("_g", F.col("_offset") + F.col("block"))
        .join(placed_blocks(spark, phases(blocks, target), counts, block, offset), "_g")
    )
    return placed.select("doc_id", "source", *[c for c in keep if c not in (id_col, source_col)], "phase", "block", "slot", (F.col("_first") + F.col("_at") % block).alias("position"))


def mixed(docs: DataFrame, weights: dict | None = None, alpha: float = 0.7, block: int | None = None) -> DataFrame:
    """All rows and columns of ``docs``, whatever their names, in the mixed order: sorted in and across partitions."""
    packed = docs.select("doc_id", "source", F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    out = mix(packed, weights, alpha, block, keep=("_row",))
    return out.repartitionByRange("position").sortWithinPartitions("position").select("_row.*")
