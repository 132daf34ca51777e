"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges, exact confirmation.

Stages, each a Spark job over stored tables:

1. one Arrow pass: shingle set, its 128-bit key, and band keys of a one-permutation sketch with optimal
   densification (an empty bin copies the bin that its own probe sequence finds first);
2. equal sets collapse to the smallest doc_id, so exact copies never meet each other in a bucket;
3. a bucket's hub is the member with the most bucket mates, and its centre is what one reaches from the hub by going
   twice to the best hub in reach: the buckets of a family share one centre, so a document has few of them;
4. star edges centre-member are confirmed on the full sets, and components are grown from confirmed links; buckets
   whose members still lie in several components get star edges from their hub and from a second one;
5. for what that leaves, members are compared by their differences from the centre, which are small and mostly their
   own: prefix, position and bitmap filters over the differences leave next to no pair that isn't linked.
   So no pair that shares a bucket goes untested unless its two sides are already joined or can't be linked.

A pair at the threshold itself shares no bucket with probability (1 - 0.8**6)**48, about 5e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import checked_broadcast, small_batches, stash, without

BANDS, ROWS = 48, 6
#: Star edges of one hub up to which they stay together; the edges of a larger star are spread over SALTS groups.
STAR, SALTS = 1000, 64
#: 64-bit words of a set's parity bitmap.
BITMAP = 8

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_TRIES = 24


def _probes(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin the bins it tries first, and a whole order of all bins for what those tries leave."""
    rng = np.random.default_rng(20_251)
    return rng.integers(0, bins, (bins, _TRIES)), np.stack([rng.permutation(bins) for _ in range(bins)])


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, an empty one none."""
    data = tb.FOLD[data]
    starts, ends, first = tb.words(data, bounds, tb.NOT_SPACE)
    h = tb.span_hash(tb.prefix_hash(data), starts, ends)
    s = h[: max(0, len(h) - size + 1)]
    for k in range(1, size):
        s = tb.mix(s * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            yield np.unique(s[a : b - size + 1])
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    whole = tb.mix(np.array([whole * np.uint64(0xD6E8FEB86659FD93) + x]))[0]
            yield np.array([whole], np.uint64)
        else:
            yield h[:0]


def sketch(sets: list[np.ndarray], bands: int, rows: int, probes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Band keys (sets x bands) of non-empty sorted sets."""
    bins = bands * rows
    sig = np.full((len(sets), bins), _EMPTY, np.uint64)
    for i, u in enumerate(sets):
        b = ((u >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)  # grows with u, so a bin's first value is its least
        at = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        sig[i, b[at].astype(np.int64)] = u[at]
    full, src = sig != _EMPTY, sig.copy()
    row, col = np.nonzero(~full)
    tries, order = probes
    for t in range(_TRIES):
        if not len(row):
            break
        to = tries[col, t]
        ok = full[row, to]
        sig[row[ok], col[ok]] = src[row[ok], to[ok]]
        row, col = row[~ok], col[~ok]
    for a in range(0, len(row), 20_000):
        r, c = row[a : a + 20_000], col[a : a + 20_000]
        to = order[c, full[r[:, None], order[c]].argmax(1)]
        sig[r, c] = src[r, to]
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sets), bands)).copy()
    for k in range(rows):
        key = tb.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, k::rows])
    return key


def _sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def work(batches):
        probes = _probes(bands * rows)
        for batch in batches:
            for a, b, data, bounds in tb.slices(batch.column(1)):
                sets = list(shingle_sets(data, bounds, size))
                keys = iter(sketch([u for u in sets if len(u)], bands, rows, probes).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(u) for u in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(u.tobytes()) if len(u) else None for u in sets], pa.binary()),
                        pa.array([next(keys) if len(u) else None for u in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "bands"],
                )

    return docs.mapInArrow(work, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def parity_bits(u: np.ndarray) -> np.ndarray:
    """The parities of a set's items in BITMAP x 64 bins: two sets differ in no fewer items than in bits."""
    odd = np.bincount((u >> np.uint64(20)).astype(np.int64) % (64 * BITMAP), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            for a, b, data, bounds in tb.slices(batch.column(1)):
                sets = list(shingle_sets(data, bounds, size))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array([len(u) for u in sets], pa.int64()),
                        pa.array([u.view(np.int64) for u in sets], pa.list_(pa.int64())), pa.array([parity_bits(u) for u in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc", "n", "items", "bits"],
                )

    return docs.mapInArrow(work, "doc long, n long, items array<long>, bits array<long>")


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(doc, label) for the ends of undirected ``edges`` (a, b): label is the smallest doc reachable.

    Each round takes the least label among neighbours, then the label's own label, and stores the result;
    stars settle in two rounds, chains in a number of rounds that grows with the logarithm of their length.
    """
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct(), f"{name}-edges")
    labels = stash(both.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("b"), F.min("a")).alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels.toDF("b", "near"), "b").groupBy(F.col("a").alias("doc")).agg(F.min("near").alias("near"))
        hooked = labels.join(near, "doc").select("doc", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumped = hooked.join(labels.toDF("label", "up"), "label", "left").select("doc", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        new = stash(jumped, f"{name}-labels")
        if new.filter("label < old").isEmpty():
            return new.select("doc", "label")
        labels = new.select("doc", "label")


def _beside(pairs: DataFrame, sets: DataFrame, hub: str, doc: str) -> DataFrame:
    """``pairs`` with items_a (of ``hub``) and items_b (of ``doc``), the sizes n_a and n_b, and bits_b.

    A hub's set goes to each group of its edges once: large stars are spread over SALTS groups by the other end.
    """
    large = checked_broadcast(pairs.groupBy(hub).agg(F.count(F.lit(1)).alias("edges")).filter(F.col("edges") > STAR).select(hub, F.lit(SALTS).alias("salts")))
    salt = F.pmod(F.xxhash64(doc), F.coalesce("salts", F.lit(1)))
    spread = pairs.join(large, hub, "left").withColumn("salt", salt).drop("salts")
    ends = pairs.select(hub).distinct().join(large, hub, "left").select(F.col(hub), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1)).alias("salt"))
    hubs = ends.join(sets.select(F.col("doc").alias(hub), F.col("n").alias("n_a"), F.col("items").alias("items_a")), hub)
    members = sets.select(F.col("doc").alias(doc), F.col("n").alias("n_b"), F.col("items").alias("items_b"), F.col("bits").alias("bits_b"))
    return spread.withColumn("salt", F.col("salt").cast("long")).join(members, doc).join(hubs, [hub, "salt"]).drop("salt")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b), a being the hub, with the verdict ``linked``, taken from the full sets."""
    both = F.size(F.array_intersect("items_a", "items_b"))
    return _beside(pairs, sets, "a", "b").select("a", "b", (100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).alias("linked"))


def _apart_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of ``rest`` (centre, centre_label, doc, label) with one centre and different labels that can
    reach the threshold.

    With D(x) the items in which x differs from the centre, x and y differ in d(x) + d(y) - 2 |D(x) & D(y)| items, which
    the threshold bounds by most = (n(x) + n(y)) (100 - percent) / (100 + percent).  So they share at least
    t = (d(x) + d(y) - most) / 2 differences, one or more: documents that both lie as near to the centre as a link
    asks have its label.  Differences are ordered by the number of documents that have them, so two linked
    documents meet first in a place that leaves t of them in both; the one with more differences is probed with its first
    most + 1, the other indexed by its first d - t + 1 for the least t that a partner of the centre's family allows.
    Pairs that meet there must also pass the bitmaps: sets differ in no fewer items than their bitmaps in bits.
    Differences that many documents have, such as the same word of the original changed, still let a share of a family's
    pairs meet: the rows of that join, before its filters, grow with the square of a family that lost its original.
    """
    q = (100.0 - percent) / (100.0 + percent)
    apart = _beside(rest, sets, "centre", "doc").select(
        "centre", "doc", "label", (F.col("label") == F.col("centre_label")).alias("near"), F.col("n_a").alias("n_c"), F.col("n_b").alias("n"), F.col("bits_b").alias("bits"),
        F.concat(F.array_except("items_b", "items_a"), F.array_except("items_a", "items_b")).alias("items"),
    )
    apart = stash(apart.withColumn("d", F.size("items")).filter("d > 0"), "apart")
    sizes = apart.groupBy("centre").agg(F.min("n").alias("n_lo"), F.max("n").alias("n_hi"))
    each = apart.select("centre", "doc", "bits", F.explode("items").alias("item"))
    shared = stash(each.groupBy("centre", "item").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "apart-df")
    lists = each.join(shared, ["centre", "item"]).groupBy("centre", "doc", "bits").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("held"))
    lo = F.greatest(F.col("n") * percent / 100.0, F.col("n_lo"))
    hi = F.least(F.col("n") * 100.0 / percent, F.col("n_hi"))
    most = (F.col("n") + hi) * q
    partner = F.greatest(F.col("d"), F.when(F.col("near"), F.floor((lo + F.col("n_c")) * q + 1e-6) + 1).otherwise(0))
    least = F.greatest(F.lit(1), F.ceil((F.col("d") + partner - most) / 2 - 1e-6))
    lists = lists.join(apart.drop("items"), ["centre", "doc", "bits"]).join(sizes, "centre").select(
        "centre", "doc", "label", "n", "d", "bits", "held", (F.col("d") - F.size("held")).alias("own"),
        F.least(F.col("d"), F.floor(most + 1e-6) + 1).alias("probe"), (F.col("d") - least + 1).alias("index"),
    )
    lead = F.slice("held", F.lit(1), F.greatest(F.lit(0), F.greatest("probe", "index") - F.col("own")).cast("int"))
    heads = lists.select("centre", "doc", "label", "n", "d", "bits", "own", "probe", "index", F.posexplode(lead).alias("at", "x"))
    heads = stash(heads.withColumn("place", F.col("own") + F.col("at")).select("centre", F.col("x.item").alias("item"), "doc", "label", "n", "d", "bits", "place", "probe", "index"), "apart-heads")
    kept = ("doc", "label", "n", "d", "bits", "place")
    x = heads.filter("place < probe").select("centre", "item", *[F.col(c).alias(f"x_{c}") for c in kept])
    y = heads.filter("place < index").select("centre", "item", *[F.col(c).alias(f"y_{c}") for c in kept])
    bound = (F.col("x_n") + F.col("y_n")) * q + 1e-6
    room = F.least(F.col("x_d") - F.col("x_place"), F.col("y_d") - F.col("y_place"))
    bits = sum((F.bit_count(F.get("x_bits", F.lit(i)).bitwiseXOR(F.get("y_bits", F.lit(i)))) for i in range(BITMAP)), F.lit(0))
    pairs = x.join(
        y,
        (x["centre"] == y["centre"]) & (x["item"] == y["item"]) & (F.col("x_label") != F.col("y_label"))
        & ((F.col("y_d") < F.col("x_d")) | ((F.col("y_d") == F.col("x_d")) & (F.col("y_doc") < F.col("x_doc"))))
        & (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")) & (2 * room >= F.col("x_d") + F.col("y_d") - bound) & (bits <= bound),
    )
    return pairs.select(F.least("x_doc", "y_doc").alias("a"), F.greatest("x_doc", "y_doc").alias("b")).distinct()


def _in_buckets(members: DataFrame, *columns: str) -> DataFrame:
    """A row (doc, ``columns``, key, mates) for each bucket of each member."""
    return members.select("doc", *columns, F.explode("keys").alias("bucket")).select("*", "bucket.key", "bucket.mates").drop("bucket")


def _of_bucket(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` (doc, key, mates, ..), one for each member of a bucket, with the columns of their bucket's row in ``buckets``.

    A bucket of more than STAR members is spread over SALTS groups by doc, and its row goes to each of them.
    """
    salts = F.when(F.col("mates") > STAR, SALTS).otherwise(1)
    each = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("mates")
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc"), salts).cast("int")).join(each, ["key", "salt"]).drop("salt")


def _centres(members: DataFrame) -> DataFrame:
    """(key, mates, hub, hub_n, centre, centre_n) of all buckets of ``members`` (doc, n_shingles, weight, keys)."""
    each = _in_buckets(members, "n_shingles", "weight")
    order = F.struct("weight", -F.col("doc"))
    heads = each.groupBy("key").agg(F.max("mates").alias("mates"), F.max_by(F.struct("doc", "n_shingles", "weight"), order).alias("h"))
    hubs = stash(heads.select("key", "mates", F.col("h.doc").alias("hub"), F.col("h.n_shingles").alias("hub_n"), F.col("h.weight").alias("hub_weight")), "hubs")
    leading = each.join(hubs.select(F.col("hub").alias("doc")).distinct(), "doc", "left_semi")
    best = F.max_by(F.struct("hub", "hub_n"), F.struct("hub_weight", -F.col("hub")))
    up = stash(_of_bucket(leading.select("doc", "key", "mates"), hubs).groupBy("doc").agg(best.alias("b")).select("doc", F.col("b.hub").alias("up"), F.col("b.hub_n").alias("up_n")), "best-hubs")
    again = up.select(F.col("doc").alias("up"), F.col("up").alias("centre"), F.col("up_n").alias("centre_n"))
    far = up.select("doc", "up").join(again, "up").select(F.col("doc").alias("hub"), "centre", "centre_n")
    return stash(hubs.join(far, "hub").select("key", "mates", "hub", "hub_n", "centre", "centre_n"), "centres")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Two documents are linked when 100 x intersection >= ``percent`` x union of their sets of distinct
    ``shingle``-word shingles (words between white space, A-Z folded).  A shorter text is one shingle.
    Null or wordless texts have no shingles, are linked with nothing and kept.  A null doc_id gets a null
    component and is kept.  Rows that repeat a doc_id each get their own result, by their own text.  Other
    columns of ``docs`` are not read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = stash(_sketches(texts, shingle, bands, rows), "sketches")
    rep = stash(base.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep")), "reps")
    heads = base.join(rep.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "left_semi")
    rows_ = stash(heads.select(F.col("doc_id").alias("doc"), "n_shingles", F.explode("bands").alias("key")).distinct(), "bands")

    buckets = stash(rows_.groupBy("key").agg(F.count(F.lit(1)).alias("mates")).filter("mates > 1"), "buckets")
    # One row a document, so that what is known of it is joined once and not once a bucket.
    members = stash(rows_.join(buckets, "key").groupBy("doc", "n_shingles").agg(F.collect_list(F.struct("key", "mates")).alias("keys"), F.sum("mates").alias("weight")), "members")
    centres = _centres(members)
    own_texts = texts.join(checked_broadcast(members.select(F.col("doc").alias("doc_id"))), "doc_id", "left_semi")
    repeated = base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    own_texts = own_texts.join(repeated, "doc_id", "left_anti").union(own_texts.join(repeated, "doc_id", "left_semi").distinct())
    sets = stash(_sets(own_texts, shingle), "sets")

    def near_sizes(star: DataFrame, hub: str, size: str) -> DataFrame:
        """The star edges (a, b) from ``hub`` that the sizes allow."""
        near = star.filter((F.col(hub) != F.col("doc")) & (100 * F.least("n_shingles", size) >= percent * F.greatest("n_shingles", size)))
        return near.select(F.col(hub).alias("a"), F.col("doc").alias("b")).distinct()

    at = _of_bucket(_in_buckets(members, "n_shingles"), centres)
    tested = stash(_confirm(stash(near_sizes(at, "centre", "centre_n"), "stars"), sets, percent), "tested")
    labels = components(tested.filter("linked"))

    def unsettled() -> DataFrame:
        """Members of the buckets that still hold several components, a row for each bucket, with label."""
        at = _in_buckets(members.join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc")), "n_shingles", "weight", "label")
        mixed = at.groupBy("key").agg(F.max("mates").alias("mates"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key", "mates")
        return _of_bucket(at, mixed)

    of_hub = labels.select(F.col("doc").alias("hub"), F.col("label").alias("hub_label"))
    hubs = centres.select("key", "mates", "hub", "hub_n").join(of_hub, "hub", "left").withColumn("hub_label", F.coalesce("hub_label", "hub"))
    at = stash(_of_bucket(unsettled(), hubs), "hub-members")
    # A bucket's second hub is its weightiest member of another component than the hub's.
    best = F.max_by(F.struct(F.col("doc").alias("hub"), F.col("n_shingles").alias("hub_n"), F.col("label").alias("hub_label")), F.struct("weight", -F.col("doc")))
    second = at.filter("label != hub_label").groupBy("key").agg(F.max("mates").alias("mates"), best.alias("h")).select("key", "mates", "h.*")
    both_hubs = at.unionByName(_of_bucket(at.drop("hub", "hub_n", "hub_label"), second)).filter("label != hub_label")
    tried = tested.select("a", "b").union(tested.select("b", "a"))
    fresh = stash(_confirm(stash(near_sizes(both_hubs, "hub", "hub_n").join(tried, ["a", "b"], "left_anti"), "stars"), sets, percent), "tested")
    tested = tested.union(fresh)
    if not fresh.filter("linked").isEmpty():
        labels = components(tested.filter("linked"))

    of_centre = labels.select(F.col("doc").alias("centre"), F.col("label").alias("centre_label"))
    rest = _of_bucket(unsettled(), centres.select("key", "mates", "centre")).select("centre", "doc", "label").distinct()
    rest = rest.join(of_centre, "centre", "left").select("centre", F.coalesce("centre_label", "centre").alias("centre_label"), "doc", "label")
    pairs = stash(_apart_pairs(stash(rest, "rest"), sets, percent), "pairs")
    fresh = stash(_confirm(pairs, sets, percent), "tested")
    if not fresh.filter("linked").isEmpty():
        labels = components(tested.union(fresh).filter("linked"))

    out = base.select("doc_id", "n_shingles", "set_key").join(rep, "set_key", "left").join(labels.toDF("rep", "label"), "rep", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == comp)).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, of which ``near_duplicates`` keeps the document; rows
    without an id stay.  An id goes if one of its rows is linked to a smaller id."""
    gone = near_duplicates(docs, id_col, text_col, shingle, percent).filter("not kept").select("doc_id").distinct()
    return without(docs, id_col, stash(gone, "duplicates"))
