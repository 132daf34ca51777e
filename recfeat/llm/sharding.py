"""Sharding along a Hilbert curve over document metadata, with DataFrame operations only.

Size, language and source are quantised in their order, the cells are numbered along a three-dimensional Hilbert curve, documents
are sorted by that number and the order is cut into runs of equal row counts.  Neighbours on the curve are close in
all three dimensions, so a shard's files span small ranges of each and readers can skip the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import checked_broadcast, ranked, stash

#: Bits of each dimension: 32 cells a side.
BITS = 5


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """The place on the Hilbert curve of the cell with integer coordinates ``dims``, each below 2**bits.

    The coordinates are turned and mirrored level by level (a fold over levels and axes), Gray-coded, and their
    bits interleaved.
    """
    n = len(dims)
    one = F.lit(1)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, s: Column) -> Column:
        xi, x0, low = F.get(x, s["i"]), F.get(x, F.lit(0)), s["q"] - one
        hit = xi.bitwiseAND(s["q"]) != 0
        swap = x0.bitwiseXOR(xi).bitwiseAND(low)
        return F.transform(
            x,
            lambda v, j: F.when(j == 0, F.when(hit, x0.bitwiseXOR(low)).otherwise(x0.bitwiseXOR(swap)))
            .when((j == s["i"]) & ~hit, xi.bitwiseXOR(swap)).otherwise(v),
        )

    turned = F.aggregate(steps, F.array(*[d.cast("int") for d in dims]), turn)

    def gray(t: Column) -> Column:
        return F.transform(t, lambda v, j: F.aggregate(F.slice(t, 1, j + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b)))

    levels = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])

    def unwind(g: Column) -> Column:
        flip = F.aggregate(levels, F.lit(0), lambda t, q: F.when(F.get(g, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - one)).otherwise(t))
        axes = F.transform(g, lambda v: v.bitwiseXOR(flip))
        places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
        return F.aggregate(
            places, F.lit(0),
            lambda acc, p: F.shiftleft(acc, 1).bitwiseOR(F.call_function("shiftright", F.get(axes, p["i"]), p["b"]).bitwiseAND(one)),
        )

    # One-element arrays name an intermediate result, so that it is worked out once.
    return F.get(F.transform(F.transform(F.array(turned), gray), unwind), F.lit(0))


def size_cell(size: Column, bits: int = BITS) -> Column:
    """Twice the binary logarithm of a size in bytes, from 8 bytes on."""
    return F.least(F.lit((1 << bits) - 1), F.greatest(F.lit(0), F.floor(2 * F.log2(size.cast("double"))).cast("int") - 6))


def value_cells(docs: DataFrame, column: str, value: str, cell: str, bits: int = BITS) -> DataFrame:
    """(``value``, ``cell``): the distinct values of a column in their order, cut into cells of about equal row counts.

    Neighbouring cells hold neighbouring values, so a file's range of cells is a range of values.  Null comes first.
    One row a distinct value meets in the running sum: languages and sources are few, however many documents.
    """
    counts = docs.groupBy(F.col(column).cast("string").alias(value)).agg(F.count(F.lit(1)).alias("n"))
    upto = W.orderBy(F.col(value).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(value, F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy()).alias("total"))
    return counts.select(value, F.floor(F.col("before") * (1 << bits) / F.col("total")).cast("int").alias(cell))


def shard_rows(docs: DataFrame, shards: int = 24, keep: tuple[str, ...] = (), then: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", first: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, curve, the columns ``keep``, shard (0 .. shards-1) and slot (from 0 in each shard).

    Law ``rows``: rank r of N goes to shard floor(r * shards / N), so counts are at most one apart and slots have no
    gaps.  The order is the columns ``first``, curve place, then the columns ``then``, the text's checksum (equal texts stand together) and
    doc_id; nulls come first.  Size is the UTF-8 length plus 8; a null text counts as empty.  Null language or
    source share the first cell.  Rows with repeated or null ids each get a slot.  An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + 8
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        *[(F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(f"_{c}") for c in ("lang", "source")],
        *[F.col(c) for c in dict.fromkeys([*keep, *first, *then]) if c != id_col],
    )
    for c in ("lang", "source"):
        cells = value_cells(docs, c, "_value", f"_{c}_cell") if c in docs.columns else None
        rows = rows.join(checked_broadcast(cells), F.col(f"_{c}").eqNullSafe(F.col("_value"))).drop("_value") if cells is not None else rows.withColumn(f"_{c}_cell", F.lit(0))
    place = hilbert_index([size_cell(F.col("size")), F.col("_lang_cell"), F.col("_source_cell")])
    rows = rows.select("doc_id", "size", "text_crc32", place.alias("curve"), *[c for c in dict.fromkeys([*keep, *first, *then]) if c != id_col])
    if not keep:  # narrow rows: stored, the sampling of ranges doesn't compute them again
        rows = stash(rows, "places")
    order = ranked(rows, [*first, "curve", *then, "text_crc32", "doc_id"], "curve")
    total = max(1, order.count())
    return (
        order.withColumn("shard", F.expr(f"cast(rank * {shards}L div {total}L as int)"))
        .withColumn("slot", F.col("rank") - F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L"))
        .drop("rank")
    )


def _packed(docs: DataFrame, shards: int, then: tuple[str, ...], first: tuple[str, ...]) -> DataFrame:
    """_row (the user's columns), size, curve, shard, slot."""
    own = [c for c in docs.columns if c not in ("shard", "slot", *first, *then)]
    packed = docs.select(*[F.col(c) for c in ("doc_id", "text", "lang", "source") if c in docs.columns], *first, *then, F.struct(*[F.col(c) for c in own]).alias("_row"))
    return shard_rows(packed, shards, keep=("_row",), then=then, first=first)


def sharded(docs: DataFrame, shards: int = 24, then: tuple[str, ...] = (), first: tuple[str, ...] = ()) -> DataFrame:
    """All columns of ``docs`` but ``first`` and ``then``, with shard and slot; columns of these two names are replaced."""
    return _packed(docs, shards, then, first).select("_row.*", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> DataFrame:
    """Write all columns of ``docs`` as Parquet under ``path``, a folder a shard, rows in slot order; return the
    manifest: rows, bytes and the ranges of size, language, source and curve place by shard, which readers prune by."""
    rows = _packed(docs, shards, (), ())
    out = rows.select("_row.*", "shard", "slot")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    ranges = [f(f"_row.{c}").alias(f"{name}_{c}") for c in ("lang", "source") if c in docs.columns for f, name in ((F.min, "first"), (F.max, "last"))]
    nulls = [F.count(F.when(F.col(f"_row.{c}").isNull(), 1)).alias(f"null_{c}") for c in ("lang", "source") if c in docs.columns]
    return rows.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("bytes"), F.min("size").alias("least_size"), F.max("size").alias("most_size"),
        F.min("curve").alias("first_curve"), F.max("curve").alias("last_curve"), *ranges, *nulls,
    )


def shards_with(manifest: DataFrame, lang: str | None = None, source: str | None = None, least_size: int | None = None) -> DataFrame:
    """The shards of the manifest that can hold rows of the language, the source and at least the size asked for."""
    out = manifest
    for c, value in (("lang", lang), ("source", source)):
        if value is not None:
            out = out.filter((F.col(f"first_{c}") <= value) & (F.col(f"last_{c}") >= value))
    return (out if least_size is None else out.filter(F.col("most_size") >= least_size)).select("shard")
