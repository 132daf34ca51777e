"""Benchmark decontamination by winnowing.

A text's fingerprints are the least k-gram hash of each run of ``window - k + 1`` consecutive k-grams, so two
texts that share ``window`` words share a fingerprint.  Fingerprints of documents and benchmark meet in an equi-join
on hash and words; each carries the words around it, by which a hit is extended to either side, and what reaches
``window`` words is a shared passage.  A Bloom filter of the benchmark's fingerprints, of a size that follows their
number, keeps those of the documents that can't meet any out of the join; its errors cost rows, never a hit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import checked_broadcast, small_batches, stash, without

#: Words of a fingerprinted gram.
GRAM = 6
#: log2 of the filter's bits, at least and at most (8 MB); 16 bits a fingerprint between them.
FILTER_BITS = 18, 26
#: Distinct benchmark fingerprints with their surroundings up to which they are sent to every executor (some 150 bytes
#: each).
BROADCAST_PRINTS = 200_000


class _Words:
    """The folded alphanumeric words of a slice of texts, with span hashes over words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data = tb.FOLD[data]
        self.starts, self.ends, self.first = tb.words(self.data, bounds, tb.ALNUM)
        self.raw = self.data.tobytes()
        self.prefix = tb.prefix_hash(tb.span_hash(tb.prefix_hash(self.data), self.starts, self.ends))
        #: For each word the end of its text and the text's length, in words.
        self.length = np.repeat(np.diff(self.first), np.diff(self.first))
        self.stop = np.repeat(self.first[1:], np.diff(self.first))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all k-grams that stay inside a text."""
        at = np.flatnonzero(np.arange(len(self.starts)) + k <= self.stop)
        return at, tb.mix(tb.span_hash(self.prefix, at, at + k) + np.uint64(k))

    def winnowed(self, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the grams that are least (the last of equals) in a run inside ``window`` words."""
        run = window - k + 1
        n = len(self.starts) - k + 1
        if n < run:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(n)
        h = tb.mix(tb.span_hash(self.prefix, at, at + k) + np.uint64(k))
        least, place = h[: n - run + 1].copy(), at[: n - run + 1].copy()
        for j in range(1, run):
            then = h[j : n - run + 1 + j]
            less = then <= least
            least[less] = then[less]
            place[less] = at[j : n - run + 1 + j][less]
        picked = np.unique(place[at[: n - run + 1] + window <= self.stop[: n - run + 1]])
        return picked, h[picked]

    def around(self, at: int, k: int, most: int) -> tuple[bytes, list[bytes], list[bytes]]:
        """The words of the gram at ``at``, and up to ``most`` words of its text before it (nearest first) and after."""
        lo, hi = max(int(self.stop[at]) - int(self.length[at]), at - most), min(int(self.stop[at]), at + k + most)
        some = [self.raw[a:b] for a, b in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist(), strict=True)]
        return b" ".join(some[at - lo : at - lo + k]), some[: at - lo][::-1], some[at - lo + k :]


def _places(ws: _Words, window: int, lengths: list[int]):
    """(place, hash, words) of all fingerprints of a slice: winnowed grams, and all grams of the short ``lengths``."""
    at, h = ws.winnowed(window, GRAM)
    yield at, h, GRAM
    for n in lengths:
        yield (*ws.grams(n), n)


_PRINT = "h long, n int, gram string, before array<string>, after array<string>"
_ARROW = pa.struct([("h", pa.int64()), ("n", pa.int32()), ("gram", pa.string()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])


def _print(ws: _Words, at: int, h: int, n: int, window: int) -> dict:
    gram, before, after = ws.around(at, n, window - GRAM if n == GRAM else 0)
    return {"h": h, "n": n, "gram": gram.decode("utf-8", "replace"), "before": [w.decode("utf-8", "replace") for w in before], "after": [w.decode("utf-8", "replace") for w in after]}


def _item_prints(items: DataFrame, window: int) -> DataFrame:
    """(item_id, short, and the fields of a fingerprint): an item of fewer words than ``window`` is one gram."""

    def work(batches):
        for batch in batches:
            for a, _, data, bounds in tb.slices(batch.column(1)):
                ws = _Words(data, bounds)
                ids, short, prints = [], [], []

                def put(at: int, h: int, n: int, is_short: bool):
                    owner = int(np.searchsorted(ws.first, at, side="right")) - 1
                    ids.append(batch.column(0)[a + owner].as_py())
                    short.append(is_short)
                    prints.append(_print(ws, at, h, n, window) if not is_short else _print(ws, at, h, n, GRAM))

                places, hashes = ws.winnowed(window, GRAM)
                for at, h in zip(places.tolist(), hashes.view(np.int64).tolist(), strict=True):
                    put(at, h, GRAM, False)
                for lo, hi in zip(ws.first[:-1].tolist(), ws.first[1:].tolist(), strict=True):
                    if 0 < hi - lo < window:
                        h = tb.mix(tb.span_hash(ws.prefix, np.array([lo]), np.array([hi])) + np.uint64(hi - lo))
                        put(lo, int(h.view(np.int64)[0]), hi - lo, True)
                cells = pa.array(prints, _ARROW)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(short, pa.bool_()), *cells.flatten()], names=["item_id", "short", *(f.name for f in _ARROW)])

    return items.mapInArrow(work, f"item_id long, short boolean, {_PRINT}")


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << bits) - 1)
    return (h & low).astype(np.int64), ((h >> np.uint64(32)) & low).astype(np.int64)


def _bitmap(prints: DataFrame, bits: int) -> np.ndarray:
    """The filter's bytes: at most 2**bits / 32 rows reach the driver, however many fingerprints there are."""
    mask = (1 << bits) - 1
    both = F.array(F.col("h").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(mask)))
    rows = prints.select(F.explode(both).alias("bit")).groupBy(F.shiftright("bit", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("set")).toPandas()
    out = np.zeros((1 << bits) // 32, np.uint32)
    out[rows["at"].to_numpy(np.int64)] = rows["set"].to_numpy(np.int64).astype(np.uint32)
    return out.view(np.uint8)


def _candidates(docs: DataFrame, known, bits: int, lengths: list[int], window: int) -> DataFrame:
    """One row a document: n_words, and the fingerprints that the filter knows, with their places."""

    def work(batches):
        filled = known.value

        def in_filter(h: np.ndarray) -> np.ndarray:
            one, two = _probes(h, bits)
            return ((filled[one >> 3] >> (one & 7).astype(np.uint8)) & (filled[two >> 3] >> (two & 7).astype(np.uint8)) & 1).astype(bool)

        kind = pa.list_(pa.struct([("at", pa.int32()), *_ARROW]))
        for batch in batches:
            for a, b, data, bounds in tb.slices(batch.column(1)):
                ws = _Words(data, bounds)
                by_doc: list[list | None] = [None] * (b - a)
                for at, h, n in _places(ws, window, lengths):
                    hit = in_filter(h)
                    owner = np.searchsorted(ws.first, at[hit], side="right") - 1
                    for p, x, d in zip(at[hit].tolist(), h[hit].view(np.int64).tolist(), owner.tolist(), strict=True):
                        mine = by_doc[d] = by_doc[d] or []
                        mine.append({"at": p - int(ws.first[d])} | _print(ws, p, x, n, window))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(ws.first), pa.int64()), pa.array(by_doc, kind)], names=["doc_id", "n_words", "near"])

    return docs.mapInArrow(work, f"doc_id long, n_words long, near array<struct<at: int, {_PRINT.replace(' long', ': long').replace(' int', ': int').replace(' string', ': string').replace(' array', ': array')}>>")


def _shared(x: str, y: str, most: int, i: int = 0):
    """How many leading words two lists share, up to ``most``."""
    if i == most:
        return F.lit(0)
    return F.when(F.get(x, F.lit(i)) == F.get(y, F.lit(i)), 1 + _shared(x, y, most, i + 1)).otherwise(0)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of digits, letters and non-ASCII characters with A-Z folded.  A benchmark item's windows are its
    runs of ``window`` words; an item of fewer words, but not none, is one window.  A document word inside any
    occurrence of a window is hit; n_items counts items with such windows, and items_sha256 digests their ids,
    sorted as strings and joined by commas (of nothing: the empty string's digest).  A null text has no words.
    Benchmark rows without an id or without words are passed over.  Every input row gives one row, repeated or null
    doc_ids included; other columns are not read.  An empty table gives an empty result, an empty benchmark no hits.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    prints = stash(_item_prints(items, window), "prints")
    # Fingerprints of the same surroundings and items are one row; items that always stand together form a class.
    grouped = prints.groupBy("short", "h", "n", "gram", "before", "after").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    grouped = stash(grouped.withColumn("class", F.md5(F.concat_ws(",", "items"))), "grouped-prints")
    lengths = [r.n for r in grouped.filter("short").select("n").distinct().collect()]  # at most window - 1
    least, most = FILTER_BITS
    bits = min(most, max(least, (16 * grouped.count()).bit_length()))
    known = spark.sparkContext.broadcast(_bitmap(grouped, bits))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = stash(_candidates(texts, known, bits, sorted(lengths), window).withColumn("row", F.monotonically_increasing_id()), "candidates")

    near = base.filter("near is not null").select("row", F.inline("near"))
    asked = grouped.select("short", "h", "n", "gram", F.col("before").alias("item_before"), F.col("after").alias("item_after"), "class")
    met = near.join(checked_broadcast(asked, BROADCAST_PRINTS), ["h", "n", "gram"])
    reach = window - GRAM
    back = F.when(F.col("short"), 0).otherwise(_shared("before", "item_before", reach))
    ahead = F.when(F.col("short"), 0).otherwise(_shared("after", "item_after", reach))
    met = met.withColumns({"back": back, "ahead": ahead}).filter(F.col("short") | (F.col("back") + F.col("n") + F.col("ahead") >= window))
    hits = met.select("row", "class", F.sequence(F.col("at") - F.col("back"), F.col("at") + F.col("n") + F.col("ahead") - 1).alias("words"))
    per_doc = stash(
        hits.groupBy("row")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("words")))).cast("long").alias("n_hit"), F.concat_ws(",", F.sort_array(F.collect_set("class"))).alias("classes")),
        "hits",
    )
    digest = (
        per_doc.select("classes").distinct().withColumn("class", F.explode(F.split("classes", ",")))
        .join(grouped.select("class", "items").distinct(), "class")
        .select("classes", F.explode("items").alias("item")).distinct()
        .groupBy("classes").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("item"))), 256).alias("items_sha256"))
    )
    full = per_doc.join(stash(digest, "digests"), "classes")
    out = base.select("row", "doc_id", "n_words").join(full, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose id has no contaminated text; rows without an id
    stay."""
    dirty = contamination(docs, benchmark, window, id_col).filter("contaminated").select("doc_id").distinct()
    return without(docs, id_col, stash(dirty, "contaminated"))
