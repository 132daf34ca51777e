"""Token-id files with a minimal perfect hash index.

Documents are range-partitioned by id, encoded, and each partition's ids are streamed into one shard file: a 16-byte
header and raw little-endian ids, two bytes each where the vocabulary allows it.  The index is a table of buckets: a
document key hashes to a bucket, the bucket's minimal perfect hash gives a slot, and the slot holds a 32-bit
fingerprint of the key and the place (shard, offset, length).  A lookup costs a constant number of probes however
many documents there are, and a bucket is built from a bounded number of keys.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import new_path, small_batches, stash

END = 0
MAGIC = b"RFIDS\x01"
HEADER = 16
#: Keys wanted in a bucket of the index.
BUCKET = 20_000
#: Pieces of text whose ids a Python worker remembers: about 200 MB, after which it starts afresh.
REMEMBERED = 1_000_000

class _Pieces(dict):
    """Numbers of pieces of text; an unknown piece gets the next number and is noted as new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self) + 1
        self.new.append(word)
        return at


class Encoder:
    """Ids of whole texts by the tokenizers library.

    Byte-level pre-tokenisation never joins a character to a space that follows it, so a text falls into pieces
    before each space that stands after a non-space, and equal pieces have equal ids.  Each worker encodes a piece
    once and remembers it.  A text with other runs of white space before a space, or with the string of an added
    token such as a document end, is encoded in one go.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unsafe = re.compile("|".join([r"\s ", *map(re.escape, filter(None, added))]))
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        vocabulary = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose bytes begin with a space
        self.leads[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self._forget()

    def _forget(self) -> None:
        self.pieces, self.used = _Pieces(), 1
        self.ids = np.zeros(1 << 20, self.kind)
        self.ids[0] = END
        self.at, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32)
        self.size[0] = 1  # piece 0 is the end of a document

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, ids: np.ndarray) -> int:
        start, self.used = self.used, self.used + len(ids)
        if self.used > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), self.used), self.kind)))
        self.ids[start : self.used] = ids
        return start

    def _learn(self) -> None:
        """Encode the new pieces " " + word.  Plain words go as one text: each begins at an id that leads with a
        space, and no other id does."""
        new, self.pieces.new = self.pieces.new, []
        while len(self.pieces) + 1 > len(self.at):
            self.at, self.size = np.concatenate((self.at, self.at)), np.concatenate((self.size, self.size))
        for a in range(0, len(new), 1024):
            some = new[a : a + 1024]
            number = len(self.pieces) - len(new) + 1 + a
            if all(w and not w[-1].isspace() for w in some):
                ids = np.array(self._encode([" " + " ".join(some)])[0], self.kind)
                at = np.flatnonzero(self.leads[ids])
                if len(at) == len(some):
                    self.at[number : number + len(some)] = self._store(ids) + at
                    self.size[number : number + len(some)] = np.diff(at, append=len(ids))
                    continue
            for i, ids in enumerate(self._encode([" " + w for w in some])):
                self.at[number + i], self.size[number + i] = self._store(np.array(ids, self.kind)), len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other and each with the end id, and their numbers."""
        if len(self.pieces) > REMEMBERED:
            self._forget()
        number, counts, whole = self.pieces.__getitem__, [], []
        seen: list[int] = []
        for t in texts:
            before = len(seen)
            seen.append(0)
            if self.unsafe.search(t):
                whole.append(t)
            else:
                parts = t.split(" ")
                whole.append(parts[0])
                seen.extend(map(number, parts[1:]))
            seen.append(0)
            counts.append(len(seen) - before)
        self._learn()
        pieces = np.array(seen, np.int64)
        counts = np.array(counts, np.int64)
        ends = np.cumsum(counts)
        at, size = self.at[pieces], self.size[pieces].astype(np.int64)
        first = [np.array(ids, self.kind) for ids in self._encode(whole)]
        used = self.used
        lead = np.array([self._store(x) for x in first], np.int64)  # for this batch only
        self.used = used
        heads = ends - counts
        at[heads], size[heads] = lead, np.array([len(x) for x in first], np.int64)
        stop = np.cumsum(size)
        out = self.ids[np.repeat(at - stop + size, size) + np.arange(int(size.sum()))]
        return out, np.diff(stop[ends - 1], prepend=0)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a qualified folder."""
    return fs.FileSystem.from_uri(folder)


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as a URI: a plain path belongs to the cluster's default file system, not to a machine's own disk."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return "file://" + uri[len("file:") :] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write_ids(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts under ``folder``; return (doc_id, copy, shard, at, n_tokens) in a stored table.

    ``at`` is the place of the first id in the shard, ``copy`` numbers rows that share a doc_id, and shards hold
    ascending ids (nulls first), equal ones by a hash of their text: rows without an id, or with one that is much
    repeated, spread over as many shards as they fill.  A file is written under a name of its own and renamed when
    whole, so a repeated task leaves the same bytes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = qualified(spark, folder)
    filesystem, path = _open(folder)
    filesystem.create_dir(path, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def work(batches):
        context = TaskContext.get()
        shard, encoder = context.partitionId(), _encoder(tokenizer)
        files, top = _open(folder)
        name = f"{top}/shard-{shard:05d}.bin"
        own = f"{name}.{context.taskAttemptId()}"
        at, last, copy, out = 0, object(), 0, None
        for batch in batches:
            if out is None:
                out = files.open_output_stream(own)
                out.write((MAGIC + bytes([encoder.kind.itemsize])).ljust(HEADER, b"\0"))
            ids, n = encoder.encode(batch.column(1).to_pylist())
            out.write(ids.tobytes())
            keys, copies = batch.column(0).to_pylist(), []
            for k in keys:
                copy = copy + 1 if k == last else 0
                last = k
                copies.append(copy)
            places = at + np.concatenate(([0], np.cumsum(n)[:-1]))
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(copies, pa.int64()), pa.array([shard] * len(n), pa.int32()), pa.array(places, pa.int64()), pa.array(n, pa.int64())],
                names=["doc_id", "copy", "shard", "at", "n_tokens"],
            )
        if out is not None:
            out.close()
            try:
                files.move(own, name)
            except OSError:  # some stores don't rename onto a file; another attempt has left the same bytes there
                if files.get_file_info(name).type != fs.FileType.File:
                    raise
                files.delete_file(own)

    places = stash(rows.mapInArrow(work, "doc_id long, copy long, shard int, at long, n_tokens long"), "token-places")
    # Copies are counted in their shard so far; an id that goes on from earlier shards counts on.
    ends = places.groupBy("shard").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max_by("copy", F.struct("doc_id", "copy")).alias("last"))
    seen, ids, before = 0, None, []
    for r in sorted(ends.collect(), key=lambda r: r.shard):  # one row a shard
        if r.lo is not None and r.lo == ids:
            before.append((r.shard, r.lo, seen))
        seen, ids = r.last + 1 + (seen if r.hi == ids and r.lo == r.hi else 0), r.hi
    if not before:
        return places
    more = F.broadcast(spark.createDataFrame(before, "shard int, doc_id long, before long"))
    return places.join(more, ["shard", "doc_id"], "left").select("doc_id", (F.col("copy") + F.coalesce("before", F.lit(0))).alias("copy"), "shard", "at", "n_tokens")


def key_hash(doc_id: np.ndarray, copy: np.ndarray) -> np.ndarray:
    """64-bit keys; different for different ids of one copy number."""
    return tb.mix(doc_id.astype(np.int64).view(np.uint64)) ^ (copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class PerfectHash:
    """A minimal perfect hash of up to some ten thousand distinct keys: levels of bits, each for the keys that met
    another key on the levels before; a key's slot is the rank of its bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(total + np.cumsum(bits) - 1)
            total += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys):
            if len(levels) == 200:
                raise ValueError("two documents have one key")
            size = 64 + len(keys) * 3 // 2
            at = cls._place(keys, len(levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            levels.append(bits)
            keys = keys[~alone]
        return cls(levels)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (tb.mix(keys + np.uint64((level + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys; for a key that was never put in, some slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self._place(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = self.ranks[level][at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u4")
        return sizes.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        sizes = np.frombuffer(raw, "<u4", n, 4).tolist()
        at, levels = 4 + 4 * n, []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, (size + 7) // 8, at))[:size].astype(bool))
            at += (size + 7) // 8
        return cls(levels)


ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("at", "<u8"), ("n", "<u4")])


def _print(keys: np.ndarray) -> np.ndarray:
    return (tb.mix(keys ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


def build_index(places: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, int]:
    """The index table (bucket, hash, entries) over (doc_id, copy, shard, at, n_tokens), and its number of buckets."""
    buckets = max(1, places.count() // bucket)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys = key_hash(rows["doc_id"].to_numpy(), rows["copy"].to_numpy())
        perfect = PerfectHash.build(keys)
        entries = np.zeros(len(keys), ENTRY)
        slot = perfect.slots(keys)
        for name, value in (("print", _print(keys)), ("shard", rows["shard"]), ("at", rows["at"]), ("n", rows["n_tokens"])):
            entries[name][slot] = value
        return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "hash": [perfect.dump()], "entries": [entries.tobytes()]})

    keyed = places.filter("doc_id is not null").select(_bucket(buckets), "doc_id", "copy", "shard", "at", "n_tokens")
    table = keyed.groupBy("bucket").applyInPandas(build, "bucket long, hash binary, entries binary")
    return stash(table, "token-index"), buckets


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(buckets)).cast("long").alias("bucket")


def look_up(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, copy, shard, at, n_tokens) of the keys (doc_id, copy) that the index knows."""

    def find(rows: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(part):
            return pd.DataFrame({"doc_id": [], "copy": [], "shard": [], "at": [], "n_tokens": []}).astype("int64")
        key = key_hash(rows["doc_id"].to_numpy(), rows["copy"].to_numpy())
        slot = PerfectHash.load(part["hash"].iloc[0]).slots(key)
        e = np.frombuffer(part["entries"].iloc[0], ENTRY)[np.maximum(slot, 0)]
        known = (slot >= 0) & (e["print"] == _print(key))
        e = e[known]
        return pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[known], "copy": rows["copy"].to_numpy()[known], "shard": e["shard"].astype(np.int32), "at": e["at"].astype(np.int64), "n_tokens": e["n"].astype(np.int64)})

    asked = keys.filter("doc_id is not null").select(_bucket(buckets), "doc_id", "copy")
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, "doc_id long, copy long, shard int, at long, n_tokens long")


def read_ids(places: DataFrame, folder: str, digest: bool = True) -> DataFrame:
    """``places`` (doc_id, shard, at, n_tokens) with what the files hold there: ids_crc32, or the ids themselves."""
    folder = qualified(places.sparkSession, folder)

    def work(batches):
        files, top = _open(folder)
        shard, source, kind = None, None, None
        for batch in batches:
            out = []
            for s, at, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if s != shard:
                    shard, source = s, files.open_input_file(f"{top}/shard-{s:05d}.bin")
                    head = source.read_at(HEADER, 0)
                    if head[: len(MAGIC)] != MAGIC:
                        raise ValueError(f"shard {s} is no id file")
                    kind = np.dtype(f"<u{head[len(MAGIC)]}")
                ids = np.frombuffer(source.read_at(n * kind.itemsize, HEADER + at * kind.itemsize), kind).astype("<u4")
                if len(ids) != n or n and ids[-1] != END:
                    raise ValueError(f"shard {s} has no document of {n} ids at {at}")
                out.append(zlib.crc32(ids.tobytes()) if digest else ids.astype(np.int64))
            made = pa.array(out, pa.int64() if digest else pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "ids_crc32" if digest else "ids"])

    rows = places.select("doc_id", "shard", "at", "n_tokens").repartition("shard").sortWithinPartitions("shard", "at")
    return rows.mapInArrow(work, "doc_id long, shard int, at long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>"))


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write id files and index, then read all documents back through the index.

    Returns doc_id, start (ids of all documents before it, in ascending doc_id order), n_tokens (with the end id) and
    ids_crc32.  A null text is empty and has the end id alone.  Rows that share a doc_id are stored side by side and
    are keyed by id and copy number; rows without an id come first and, as they have no key, are read by their place.
    Other columns are not read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    places = write_ids(docs, tokenizer, folder, id_col, text_col)
    index, buckets = build_index(places)
    found = look_up(places.select("doc_id", "copy"), index, buckets).unionByName(places.filter("doc_id is null"))
    totals = places.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()  # one row a shard
    starts, total = [], 0
    for r in sorted(totals, key=lambda r: r.shard):
        starts.append((r.shard, total))
        total += r.n
    begins = F.broadcast(spark.createDataFrame(starts, "shard int, begin long"))
    return read_ids(found, folder).join(begins, "shard").select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
