"""Quality rules: how much of a text stands in repeated n-grams and repeated lines.

Rolling hashes of several n-gram lengths mark every word inside an n-gram that the same text holds twice or more;
the marked characters' share is held against a limit for each length.  A longer n-gram can only repeat where the
shorter ones do, so each length looks at the places that the one before has left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import small_batches

#: Largest share of word characters inside later occurrences of n-grams, by n; the verdict goes by these.
LATER_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters in lines that repeat an earlier line (later occurrences only).
LINE_CHAR_LIMIT = 0.20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which entries occur twice or more."""
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _later(key: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier one."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:][key[order][1:] == key[order][:-1]]] = True
    return out


def measure(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The counts and shares of each text of a slice."""
    n_docs = len(bounds) - 1
    starts, ends, first = tb.words(data, bounds, tb.NOT_SPACE)
    counts = np.diff(first)
    owner = np.repeat(np.arange(n_docs), counts)
    salt = tb.mix(np.arange(1, n_docs + 1, dtype=np.uint64))

    def per_doc(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return total[edges[1:]] - total[edges[:-1]]

    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = lead[ends] - lead[starts] if len(starts) else np.zeros(0, np.int64)
    out = {"n_words": counts, "word_chars": per_doc(chars, first), "n_symbols": per_doc(_SYMBOL[data], bounds)}

    prefix = tb.prefix_hash(data)
    grams = tb.prefix_hash(tb.span_hash(prefix, starts, ends))
    stop = first[1:][owner]
    alive = np.arange(len(starts))  # places whose shorter grams all repeat
    repeats = np.zeros(len(starts) + 1, bool)
    step = 0
    for n in (3, *LATER_LIMITS):
        for j in range(1, n - step + 1 if step else 1):
            alive = alive[repeats[np.minimum(alive + j, len(starts))]]
        alive = alive[alive + n <= stop[alive]]
        key = tb.span_hash(grams, alive, alive + n) ^ salt[owner[alive]]
        again = _repeated(key)
        later = alive[_later(key)]
        alive = alive[again]
        repeats = np.zeros(len(starts) + 1, bool)
        repeats[alive] = True
        edge = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edge, alive, 1)
        np.add.at(edge, alive + n, -1)
        marked = np.cumsum(edge)[:-1] > 0
        if n == 3:
            out["n_repeat_words"] = per_doc(marked, first)
        else:
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, later, 1)
            np.add.at(edge, later + n, -1)
            out[f"later_{n}"] = per_doc(chars * (np.cumsum(edge)[:-1] > 0), first) / np.maximum(1, out["word_chars"])
            out[f"dup_{n}"] = per_doc(chars * marked, first) / np.maximum(1, out["word_chars"])
        step = n

    newline = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate((bounds[:-1], newline + 1)), kind="stable")
    line_owner = np.sort(np.concatenate((np.arange(n_docs), np.searchsorted(bounds, newline, side="right") - 1)))
    line_ends = np.concatenate((line_starts[1:], [len(data)]))
    last = np.concatenate((line_owner[1:] != line_owner[:-1], [True]))
    line_ends = np.where(last, line_ends, line_ends - 1)
    line_ends = np.maximum(line_ends, line_starts)
    word_at = np.searchsorted(starts, line_starts)
    with_word = (word_at < len(starts)) & (starts[np.minimum(word_at, len(starts) - 1)] < line_ends) if len(starts) else np.zeros(len(line_starts), bool)
    line_starts, line_ends, line_owner = line_starts[with_word], line_ends[with_word], line_owner[with_word]
    later = _later(tb.span_hash(prefix, line_starts, line_ends) ^ salt[line_owner])
    length = lead[line_ends] - lead[line_starts]
    out["n_dup_lines"] = np.bincount(line_owner[later], minlength=n_docs)
    out["dup_line_chars"] = np.bincount(line_owner[later], length[later], minlength=n_docs) / np.maximum(1, np.bincount(line_owner, length, minlength=n_docs))
    return out


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    bad = m["dup_line_chars"] > LINE_CHAR_LIMIT
    for n, limit in LATER_LIMITS.items():
        bad |= m[f"later_{n}"] > limit
    return failed, ~failed & ~bad


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the shares of
    characters in repeated n-grams (dup_5 .. dup_10: every occurrence, later_5 .. later_10: all but the first) and lines,
    base_failed and kept.

    Words stand between ASCII white space and keep their case.  A null text has no words and fails.  Every input
    row gives one row, repeated and null ids included; other columns are not read; an empty table gives none.
    Grams and lines are compared by 64-bit hashes of their bytes.
    """
    small_batches(docs.sparkSession)
    ints = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    reals = [*(f"dup_{n}" for n in LATER_LIMITS), *(f"later_{n}" for n in LATER_LIMITS), "dup_line_chars"]

    def work(batches):
        for batch in batches:
            for a, b, data, bounds in tb.slices(batch.column(1)):
                m = measure(data, bounds)
                failed, kept = verdicts(m)
                cols = [pa.array(m[c], pa.int64()) for c in ints] + [pa.array(m[c], pa.float64()) for c in reals]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *cols, pa.array(failed), pa.array(kept)], names=["doc_id", *ints, *reals, "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join([*(f"{c} long" for c in ints), *(f"{c} double" for c in reals)]) + ", base_failed boolean, kept boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, schema)
