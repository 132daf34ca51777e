"""The prefix trie of conversations: one row a distinct beginning, with counts of its members and its subtree.

Turns get 128-bit ids, and a conversation is the chain of its turns' ids.  Spark range-shards the chains and sorts
them; a task cuts its sorted rows into matrices of bounded size, padded where conversations end.  In a matrix the ids'
ranks are ordered by lexsort, and a mask of the columns in which a row differs from the one before, accumulated by OR
from left to right, marks where a node begins at each depth; reduceat then adds up every depth, and sums climb from
the deepest to the root.  Nodes on a matrix's first or last row may go on in the next one: they are summed again by
Spark, with corrections for what both sides of a cut counted.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import checked_broadcast, stash

#: Cells of a matrix at most; a longer conversation is a matrix of its own.
CELLS = 1 << 20
WIDTH = 16

NODE, PART, END, EDGE = range(4)
#: What a task yields: whole nodes, parts of nodes at cuts, parts of their members' ids, and its first and last row.
PARTS = (
    "kind int, shard long, piece long, digest binary, parent binary, depth long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, path binary, sizes array<long>"
)
_NAMES = [x.split()[0] for x in PARTS.split(", ")]
_TYPES = dict(zip(_NAMES, (pa.int32(), *repeat(pa.int64(), 2), *repeat(pa.binary(), 2), *repeat(pa.int64(), 7), pa.string(), pa.binary(), pa.list_(pa.int64())), strict=True))


def chains(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (turn, id, size)) of each conversation, its turns in order.

    Null comes first; turns of one number stand in the order of their ids.  Rows without conv_id belong to none.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), name.alias("id"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    return turns.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame, family: int = 5, modulus: int = 9) -> DataFrame:
    """(conv_id, path, sizes): every conversation c with its first h turns replaced by those of c - c % family, where h is
    the unsigned crc32 of c in decimal, modulo ``modulus``; path is its ids one after the other.  The remainder of a negative
    c is negative or 0."""
    own = stash(chains(conversations), "chains")
    heads = own.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, modulus - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("int")
    begin = F.coalesce(F.slice("first", 1, h), F.slice("turns", 1, 0))
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    both = own.join(heads, F.col("conv_id") - F.col("conv_id") % family == F.col("head"), "left")
    both = both.select("conv_id", F.concat(begin, rest).alias("turns"))
    return both.select("conv_id", F.unhex(F.array_join("turns.id", "")).alias("path"), F.col("turns.size").alias("sizes"))


def _digests(path: bytes, most: int) -> list[bytes]:
    """Names of the nodes on a path, from the root to depth ``most``."""
    state = hashlib.blake2b(digest_size=WIDTH)
    out = [state.digest()]
    for at in range(0, most * WIDTH, WIDTH):
        state.update(path[at : at + WIDTH])
        out.append(state.digest())
    return out


def cut_corrections(path: bytes, sizes: list[int], after: bytes) -> list[dict]:
    """What to add to nodes shared by the last row before a cut (``path`` and ``sizes``) and the first one after it.

    Both sides count a shared node's beginning: its parent counts it twice as a child, and its text is taken as
    spoken twice for the first time.  The row before the cut may have been counted as a leaf that goes on.
    """
    m, shared = len(path) // WIDTH, 0
    while shared < min(m, len(after) // WIDTH) and path[shared * WIDTH : (shared + 1) * WIDTH] == after[shared * WIDTH : (shared + 1) * WIDTH]:
        shared += 1
    names, out, again = _digests(path, shared), [], 0
    for e in range(shared, -1, -1):
        again += sizes[e - 1] if e else 0
        out.append({
            "kind": PART, "digest": names[e], "parent": names[e - 1] if e else None, "depth": e, "n_convs": 0,
            "n_children": -1 if e < shared else 0, "n_leaves": -1 if shared == m else 0, "saved_tokens": again,
        })
    return out


def _records(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _TYPES[c]) for c in _NAMES], names=_NAMES)


def matrix_nodes(conv: np.ndarray, paths: list[bytes], sizes: np.ndarray, shard: int = 0, piece: int = 0) -> pa.RecordBatch:
    """The nodes of consecutive rows: whole ones, and parts of those on the first and last row."""
    lens = np.array([len(p) // WIDTH for p in paths], np.int64)
    n, deep = len(paths), int(lens.max())
    row = np.repeat(np.arange(n), lens)
    column = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
    ids = np.frombuffer(b"".join(paths), ">u8").reshape(-1, 2).astype(np.uint64)
    by = np.lexsort((ids[:, 1], ids[:, 0]))
    rank = np.zeros(len(ids), np.int64)
    if len(ids):
        rank[by] = np.cumsum(np.append(True, (ids[by][1:] != ids[by][:-1]).any(1)))
    turns, text = np.zeros((n, deep), np.int32), np.zeros((n, deep), np.int64)  # 0: the conversation has ended
    turns[row, column], text[row, column] = rank, sizes
    order = np.lexsort((conv, *turns.T[::-1]))
    turns, text, conv, lens = turns[order], text[order], conv[order], lens[order]
    first, last = paths[order[0]], paths[order[-1]]

    begins = np.zeros((n, deep + 1), bool)
    begins[0] = True
    if n > 1 and deep:
        begins[1:, 1:] = np.logical_or.accumulate(turns[1:] != turns[:-1], axis=1)

    levels = []
    for d in range(deep + 1):
        at = np.flatnonzero(begins[:, d])
        there = lens[at] >= d
        to = np.append(at[1:], n)
        ends = np.add.reduceat((lens == d).astype(np.int64), at)
        level = {"at": at[there], "to": to[there], "least": np.minimum.reduceat(conv, at)[there], "ends": ends[there]}
        level["n"] = level["to"] - level["at"]
        level["saved"] = (level["n"] - 1) * text[level["at"], d - 1] if d else np.zeros(1, np.int64)
        levels.append(level)
    for d in range(deep, -1, -1):
        level = levels[d]
        size = len(level["at"])
        level["children"], level["leaves"] = np.zeros(size, np.int64), np.zeros(size, np.int64)
        if d < deep:
            below = levels[d + 1]
            below["up"] = np.searchsorted(level["at"], below["at"], side="right") - 1
            for name, value in (("children", 1), ("leaves", below["leaves"]), ("saved", below["saved"])):
                np.add.at(level[name], below["up"], value)
        level["leaves"] += level["children"] == 0
        level["cut"] = (level["at"] == 0) | (level["to"] == n)

    names = (_digests(first, int(lens[0])), _digests(last, int(lens[-1])))
    out: dict[str, list] = {c: [] for c in _NAMES}
    for d, level in enumerate(levels):
        up = level.get("up", np.zeros(len(level["at"]), np.int64))
        above = levels[d - 1] if d else None
        for i in range(len(level["at"])):
            a, e = int(level["at"][i]), int(level["ends"][i])
            cut = bool(level["cut"][i])
            parent_cut = d > 0 and bool(above["cut"][up[i]])
            side = names[0 if a == 0 else 1] if cut else None
            parent_side = names[0 if above["at"][up[i]] == 0 else 1] if parent_cut else None
            members = ",".join(map(str, conv[a : a + e].tolist())) if e else ""
            values = {
                "kind": PART if cut else NODE, "digest": side[d] if cut else None, "parent": parent_side[d - 1] if parent_cut else None, "depth": d,
                "conv_id": int(level["least"][i]), "parent_conv_id": int(above["least"][up[i]]) if d and not parent_cut else None,
                "n_convs": int(level["n"][i]), "n_children": int(level["children"][i]), "n_leaves": int(level["leaves"][i]), "saved_tokens": int(level["saved"][i]),
                "ends": None if cut else hashlib.sha256(members.encode()).hexdigest(),
            }
            for c in _NAMES:
                out[c].append(values.get(c))
            if cut and e:
                piece_row = {"kind": END, "shard": shard, "piece": piece, "digest": side[d], "ends": members}
                for c in _NAMES:
                    out[c].append(piece_row.get(c))
    return pa.RecordBatch.from_arrays([pa.array(out[c], _TYPES[c]) for c in _NAMES], names=_NAMES)


def _shard_nodes(batches, cells: int):
    """The nodes of a task's sorted rows, matrix by matrix, and its first and last row."""
    shard, piece = TaskContext.get().partitionId(), 0
    conv, paths, sizes, widest = [], [], [], 0
    start = end = None

    def flush():
        nonlocal piece, end
        out = [matrix_nodes(np.array(conv, np.int64), paths, np.concatenate(sizes) if sizes else np.zeros(0, np.int64), shard, piece)]
        if end is not None:
            out.append(_records(cut_corrections(*end, paths[0])))
        piece, end = piece + 1, (paths[-1], sizes[-1].tolist())
        conv.clear(), paths.clear(), sizes.clear()
        return out

    for batch in batches:
        own = batch.column(2)
        flat, at = own.values.to_numpy(zero_copy_only=False), own.offsets.to_numpy()
        for i, (c, path) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            wide = max(widest, len(path) // WIDTH + 1)
            if paths and wide * (len(paths) + 1) > cells:
                yield from flush()
                wide = len(path) // WIDTH + 1
            widest = wide
            if start is None:
                start = (path, flat[at[i] : at[i + 1]].tolist())
            conv.append(c), paths.append(path), sizes.append(flat[at[i] : at[i + 1]])
    if paths:
        yield from flush()
        yield _records([{"kind": EDGE, "shard": shard, "piece": k, "path": p, "sizes": s} for k, (p, s) in enumerate((start, end))])


def _hash_ends(batches):
    """One row (digest, ends) a node from its members' ids, which arrive in order, however many pieces they come in."""
    name, state = None, None
    for batch in batches:
        done: tuple[list, list] = ([], [])
        for digest, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest != name:
                if name is not None:
                    done[0].append(name), done[1].append(state.hexdigest())
                name, state = digest, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], names=["digest", "ends"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()])], names=["digest", "ends"])


def trie(sequences: DataFrame, cells: int = CELLS) -> DataFrame:
    """One row a node of the trie of ``sequences`` (conv_id, path: 16 bytes a turn, sizes: UTF-8 bytes of each turn).

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256, as the
    module describes them.  Repeated sequences are members of the same nodes; empty sequences are members of the
    root alone; without sequences there is no node.  A sequence is one row: 24 bytes a turn.  A matrix has ``cells`` cells
    at most, or is one sequence.
    """
    kept = stash(sequences, "sequences")
    dealt = kept.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    parts = stash(dealt.select("conv_id", "path", "sizes").mapInArrow(lambda batches: _shard_nodes(batches, cells), PARTS), "trie")

    # One row a task: where its last row and the next task's first row share nodes, the cut is mended.
    edges = parts.filter(F.col("kind") == EDGE).groupBy("shard").agg(
        F.max(F.when(F.col("piece") == 0, F.col("path"))).alias("start"), F.max(F.when(F.col("piece") == 1, F.struct("path", "sizes"))).alias("end"),
    )
    cuts = edges.select("end.path", "end.sizes", F.lead("start").over(W.orderBy("shard")).alias("after")).filter("after is not null")

    def mend(batches):
        for batch in batches:
            for path, sizes, after in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                yield _records(cut_corrections(path, sizes, after))

    top = parts.filter(F.col("kind") == PART).union(cuts.mapInArrow(mend, PARTS))
    top = top.groupBy("digest").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    pieces = parts.filter(F.col("kind") == END).select("digest", "ends", "shard", "piece")
    ends = pieces.repartition("digest").sortWithinPartitions("digest", "shard", "piece").select("digest", "ends").mapInArrow(_hash_ends, "digest binary, ends string")
    top = stash(top.join(ends, "digest", "left"), "trie-top")
    names = checked_broadcast(top.select(F.col("digest").alias("parent"), F.col("conv_id").alias("at_cut")), 200_000)

    nodes = parts.filter(F.col("kind") == NODE).select("parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    whole = top.select("parent", "depth", "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    out = nodes.union(whole).join(names, "parent", "left")
    return out.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "at_cut").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, family: int = 5, modulus: int = 9) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text); other columns aren't read.

    Null roles and texts count as empty.  Repeated turns each count.  A conversation's turns meet in one row.
    """
    return trie(rebuilt(conversations, family, modulus))
