"""Cells, curve places, shards and slots against a plain version."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from recfeat.llm import queries, sharding

from . import brute


def plain_place(point, bits):
    """The Hilbert curve by its own recursion: which corner of the cube of each level, seen from the entry and direction there."""
    x, n = list(point), len(point)
    level = 1 << (bits - 1)
    while level > 1:  # undo the turns of each level
        for i in range(n):
            if x[i] & level:
                x[0] ^= level - 1
            else:
                t = (x[0] ^ x[i]) & (level - 1)
                x[0] ^= t
                x[i] ^= t
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, level = 0, 1 << (bits - 1)
    while level > 1:
        if x[-1] & level:
            t ^= level - 1
        level >>= 1
    x = [v ^ t for v in x]
    return int("".join(str((v >> b) & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_the_curve(spark):
    """Every cell has a place of its own, neighbours on the curve touch, and the places are those of the plain version."""
    bits = 3
    cells = [(a, b, c) for a in range(8) for b in range(8) for c in range(8)]
    df = spark.createDataFrame(cells, "a int, b int, c int")
    got = {(r.a, r.b, r.c): r.h for r in df.select("*", sharding.hilbert_index([F.col(x) for x in "abc"], bits).alias("h")).collect()}
    assert got == {p: plain_place(p, bits) for p in cells} and sorted(got.values()) == list(range(512))
    at = {h: p for p, h in got.items()}
    assert all(sum(abs(x - y) for x, y in zip(at[h], at[h + 1], strict=True)) == 1 for h in range(511))


def plain_shards(rows, shards):
    """(doc_id, size, crc, curve, shard, slot) of rows (doc_id, text, lang, source)."""

    def cells(values):
        counts, before, out = Counter(values), 0, {}
        for v in sorted(counts, key=lambda v: (v is not None, v or "")):
            out[v] = math.floor(before * 32 / len(values))
            before += counts[v]
        return out

    langs, sources = cells([r[2] for r in rows]), cells([r[3] for r in rows])
    made = []
    for i, text, lang, source in rows:
        data = (text or "").encode()
        size = len(data) + 8
        cell = min(31, max(0, math.floor(2 * math.log2(size)) - 6))
        made.append((plain_place((cell, langs[lang], sources[source]), 5), zlib.crc32(data), i, size))
    made.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))
    slots, out = defaultdict(int), []
    for rank, (curve, crc, i, size) in enumerate(made):
        shard = rank * shards // len(made)
        out.append((i, size, crc, curve, shard, slots[shard]))
        slots[shard] += 1
    return sorted(out, key=str)


@pytest.mark.parametrize("odd", [False, True])
def test_shards_against_the_plain_version(spark, sf_dir, odd):
    docs = spark.createDataFrame(brute.odd_rows(), brute.SCHEMA) if odd else spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    columns = ["doc_id", "size", "text_crc32", "curve", "shard", "slot"]
    got = sharding.shard_rows(docs, 24) if odd else queries.op7_hilbert_shards(spark, sf_dir)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == plain_shards(rows, 24)
