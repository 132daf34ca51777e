"""Language identification by multilingual mixture inference.

Each language has smoothed probabilities of hashed byte trigrams.  A document is a mixture of languages: the
proportions are found by expectation-maximisation, and languages are admitted one by one, each time the one that
raises the log-likelihood most, as long as it gains more than the penalty of another free proportion.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import small_batches

BUCKETS = 1 << 16
#: Training documents wanted of each language: whole texts, chosen by a hash of doc_id.
SAMPLE = 2000
#: Tasks that count the sample; a constant, as the sample is bounded.
TASKS = 8
#: Expectation-maximisation stops when no proportion moves by STILL; each step raises the likelihood, so it does.
STILL = 1e-3
UNDETERMINED = "und"


def _grams(data: np.ndarray) -> np.ndarray:
    d = tb.FOLD[data].astype(np.uint32)
    key = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
    return ((key * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def fit(rows: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their gram probabilities (buckets x languages) from rows (doc_id, text, lang).

    The number of languages is the number of distinct values of ``lang``, which is taken to be small.
    """
    small_batches(rows.sparkSession)
    rows = rows.filter("text is not null and lang is not null")
    shares = {r.lang: min(1.0, sample / r.n) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(shares)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("lang"))
    picked = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    place = {lang: i for i, lang in enumerate(langs)}

    def work(batches):
        counts = np.zeros((len(place), BUCKETS), np.int64)
        for batch in batches:
            data, bounds = tb.buffers(batch.column(0))
            for lang, a, b in zip(batch.column(1).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                if b - a > 2:
                    counts[place[lang]] += np.bincount(_grams(data[a:b]), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["counts"])

    parts = picked.select("text", "lang").repartition(TASKS).mapInArrow(work, "counts binary").collect()  # TASKS rows
    total = reduce(np.add, (np.frombuffer(r.counts, np.int64) for r in parts)).reshape(len(langs), BUCKETS).astype(np.float64)
    smooth = total + 0.2
    return langs, np.ascontiguousarray((smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32))


def _em(p: np.ndarray, c: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of grams with probabilities ``p`` (grams x languages), counted ``c`` times."""
    share, n = start.astype(np.float32), c.sum()
    while True:
        last, share = share, share * ((c / (p @ share)) @ p) / n
        if np.abs(share - last).max() < STILL:
            break
    return share, float(c @ np.log(p @ share))


def mixture(grams: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A document's language proportions; zero for languages that are not admitted.

    A language that isn't in can raise the likelihood only if the slope of its proportion at zero is above one, and
    by no more than n log(slope); candidates whose bound doesn't exceed the penalty, or the best gain found, need no
    trial.  Every language is looked at in each round.
    """
    seen, c = np.unique(grams, return_counts=True)
    p, c = table[seen], c.astype(np.float32)
    n, k = float(c.sum()), table.shape[1]
    single = c @ np.log(p)
    chosen, level = [int(single.argmax())], float(single.max())
    share = np.ones(1, np.float32)
    penalty = 3 * (0.5 * np.log(max(2.0, n)) + 3.0)  # a byte stands in three grams
    while len(chosen) < k:
        slope = (c / (p[:, chosen] @ share)) @ p / n
        bound = n * np.log(np.maximum(slope, 1.0))
        bound[chosen] = 0
        best = None
        for nxt in map(int, np.argsort(-bound, kind="stable")):
            if bound[nxt] <= max(penalty, best[0] if best else 0.0):
                break
            trial = [*chosen, nxt]
            got, ll = _em(p[:, trial], c, np.append(share * 0.5, 0.5))
            if ll - level > max(penalty, best[0] if best else 0.0):
                best = ll - level, trial, got, ll
        if best is None:
            break
        _, chosen, share, level = best
    out = np.zeros(k, np.float32)
    out[chosen] = share / share.sum()
    return out


def _mixture_of(text: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The proportions of a text; one of fewer than three bytes is taken with a space at either end."""
    return mixture(_grams(text if len(text) > 2 else np.concatenate(([0x20], text, [0x20])).astype(np.uint8)), table)


def _has_letter(data: np.ndarray) -> bool:
    low = data | 0x20
    if ((low >= 0x61) & (low <= 0x7A)).any():
        return True
    return bool((data >= 0x80).any()) and any(x.isalpha() for x in data.tobytes().decode("utf-8", "replace"))


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, lang_pred, score (the share of that language), mix (languages above zero, by share).

    A text that is null, has no letter, or meets no learned language is ``und`` with score 0.  A text of one or two
    bytes is taken with a space at either end.  Of equally likely languages the first by name counts.  Only the text
    is read; rows with repeated or null ids give a row each, and an empty table an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast((langs, table))

    def work(batches):
        names, probs = model.value
        for batch in batches:
            data, bounds = tb.buffers(batch.column(1))
            preds, scores, mixes = [], [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                text = data[a:b]
                if not names or not _has_letter(text):
                    share = None
                else:
                    share = _mixture_of(text, probs)
                best = -1 if share is None else int(share.argmax())
                preds.append(UNDETERMINED if best < 0 else names[best])
                scores.append(0.0 if best < 0 else min(1.0, float(share[best])))
                mixes.append("" if best < 0 else ",".join(names[i] for i in np.argsort(-share, kind="stable") if share[i] > 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, pa.string())],
                names=["doc_id", "lang_pred", "score", "mix"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, lang_pred string, score double, mix string")


def held_out(id_col: str = "doc_id"):
    """Rows that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def reject(docs: DataFrame, langs: list[str], table: np.ndarray, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is at least ``least`` of one learned language."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast((langs, table))
    at = docs.columns.index("text")

    def work(batches):
        names, probs = model.value
        for batch in batches:
            data, bounds = tb.buffers(batch.column(at))
            keep = [
                bool(names) and _has_letter(data[a:b]) and float(_mixture_of(data[a:b], probs).max()) >= least
                for a, b in zip(bounds[:-1], bounds[1:], strict=True)
            ]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
