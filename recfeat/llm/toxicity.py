"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; documents drawn without regard to any label are the unlabelled set.
A linear classifier over hashed word presence minimises the class-prior-corrected risk
``prior * R+(P) + max(0, R-(U) - prior * R-(P))``; when the corrected part falls below zero its gradient is
turned round, so the classifier can't win by calling all positives negative.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import small_batches, stash

BUCKETS = 1 << 20
#: Bytes of word beginnings that count beside whole words: inflected forms share them.
BEGINNINGS = (4, 5, 6)
#: Training documents at most (expected numbers of a hash sample of doc_id); whole texts are read.
POSITIVES, UNLABELLED = 4000, 16_000
#: Words that the classifier may use, the most telling ones; a training document reaches the driver as so many bits.
WORDS = 4096
#: A word counts if this many training documents hold it.
LEAST_DOCS = 5
STEPS, BATCH, RATE, DECAY, BOUND = 150, 4000, 0.2, 1e-3, 1.0
#: For the estimate of the prior: standard errors from which a word is telling, and shares of the positives reached.
BEYOND, REACHED = (3.0, 4.0, 5.0, 6.0), np.arange(0.5, 0.96, 0.05)


class Sample(NamedTuple):
    """Presence of ``words`` in positives and unlabelled documents, and the half of each; columns by who chose them."""

    words: np.ndarray
    whole: np.ndarray
    by_half: tuple[np.ndarray, np.ndarray]
    pos: np.ndarray
    pos_half: np.ndarray
    unl: np.ndarray
    unl_half: np.ndarray


def _features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words and word beginnings of each text, one text after the other, and n+1 bounds."""
    d = tb.FOLD[data]
    starts, ends, first = tb.words(d, bounds, tb.ALNUM)
    prefix = tb.prefix_hash(d)
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(first))
    keys = [owner * BUCKETS + (tb.span_hash(prefix, starts, ends) >> np.uint64(44)).astype(np.int64)]
    for n in BEGINNINGS:
        long = np.flatnonzero(ends - starts > n)
        h = tb.mix(tb.span_hash(prefix, starts[long], starts[long] + n) + np.uint64(n))
        keys.append(owner[long] * BUCKETS + (h >> np.uint64(44)).astype(np.int64))
    seen = np.unique(np.concatenate(keys))
    return (seen % BUCKETS).astype(np.int32), np.searchsorted(seen, np.arange(len(bounds), dtype=np.int64) * BUCKETS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _batches(rows: np.ndarray, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The rows of a presence matrix, shuffled, in batches of BATCH or fewer: columns, row in the batch, rows."""
    order = rng.permutation(len(rows))
    out = []
    for some in np.array_split(order, -(-len(rows) // BATCH)):
        owner, column = np.nonzero(rows[some])
        out.append((column, owner, len(some)))
    return out


def _descend(pos: np.ndarray, unl: np.ndarray, prior: float, bound: float, rng: np.random.Generator) -> np.ndarray:
    """Weights and, last, the bias that minimise the non-negative risk over rows of word presence, by proximal steps
    scaled by each word's frequency.  A weight stays 0 unless its gradient exceeds ``bound`` standard errors of chance."""
    size = pos.shape[1]
    share = (unl.sum(0, dtype=np.float64) + pos.sum(0, dtype=np.float64) + 1) / (len(unl) + len(pos))
    hold = bound * prior * np.sqrt(share / len(pos))
    w = np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    total, positives, others = np.zeros(size + 1), _batches(pos, rng), _batches(unl, rng)
    for step in range(STEPS):
        grad = np.zeros(size + 1)

        def risk(batch, sign, weight, grad=grad):
            column, owner, n = batch
            g = np.bincount(owner, w[column], minlength=n) + w[-1]
            slope = -sign * _sigmoid(-sign * g) * weight / n
            grad[:size] += np.bincount(column, slope[owner], minlength=size)
            grad[-1] += slope.sum()
            return weight * np.logaddexp(0, -sign * g).mean()

        some = positives[step % len(positives)]
        negative = risk(others[step % len(others)], -1, 1.0) + risk(some, -1, -prior)
        if negative < 0:
            grad *= -1.0
        else:
            risk(some, 1, prior)
        grad[:-1] += DECAY * share * w[:-1]
        w -= RATE * grad / np.append(share, 0.25)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - RATE * hold / share, 0.0)
        if step >= STEPS // 2:
            total += w
    return w if bound else total / (STEPS - STEPS // 2)


def train(pos: np.ndarray, unl: np.ndarray, prior: float, seed: int = 7) -> np.ndarray:
    """Weights of the columns and the bias.  A first descent finds the words that matter beyond chance, a second one
    fits those alone."""
    rng = np.random.default_rng(seed)
    words = np.flatnonzero(_descend(pos, unl, prior, BOUND, rng)[:-1])
    out = np.zeros(pos.shape[1] + 1)
    out[np.append(words, pos.shape[1])] = _descend(pos[:, words], unl[:, words], prior, 0.0, rng)
    return out


def _frequencies(rows: np.ndarray) -> np.ndarray:
    return (rows.sum(0, dtype=np.float64) + 0.5) / (len(rows) + 1)


def estimate_prior(s: Sample) -> float:
    """The share of positives among the unlabelled documents, from positives and unlabelled documents alone.

    No threshold of any score can leave a smaller share of the unlabelled above it than prior x the share of positives
    above it, so the quotient of the two bounds the prior from above, and comes down to it where only positives are left.
    Scores sum the log ratios of words that one half of the documents shows to be telling; the quotient is taken in
    the other half, at the scores that given shares of the positives reach.  Both ways round are averaged before the least of the
    quotients, each with a standard error added, is taken, so that chance isn't picked out.  A half has the same
    documents on both sides.  Without a bound below 0.95 nothing is known, and 0.5 is the answer.
    """
    least = 1.0
    cells = [[(x[h == v], cols) for x, h in ((s.pos, s.pos_half), (s.unl, s.unl_half))] for v, cols in enumerate(s.by_half)]
    if min(len(x) for half in cells for x, _ in half) < 2:
        return 0.5
    known = []
    for (pos, cols), (unl, _) in cells:
        p, u = _frequencies(pos[:, cols]), _frequencies(unl[:, cols])
        known.append((cols, np.log(p / u), (p - u) / np.sqrt((u + p / len(pos)) / len(pos))))
    for beyond in BEYOND:
        quotients, counts = [], 0.0
        for (cols, ratio, errors), test in zip(known, cells[::-1], strict=True):
            use = errors > beyond
            at_p, at_u = (np.sort(x[:, cols[use]].astype(np.float32) @ ratio[use].astype(np.float32)) for x, _ in test)
            cuts = np.quantile(at_p, 1 - REACHED, method="lower")
            above_p, above_u = (1 - np.searchsorted(x, cuts) / len(x) for x in (at_p, at_u))
            quotients.append(above_u / above_p)
            counts = counts + above_u * len(at_u)
        least = min(least, float((np.mean(quotients, 0) * (1 + 1 / np.sqrt(np.maximum(1, counts)))).min()))
    return max(1e-4, least) if least < 0.95 else 0.5


def sample(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Sample | None:
    """The words that a classifier may use, and which of them each sampled document holds.

    Documents are dealt into two halves by a hash of the id; beside the words for the whole sample, those that each half
    alone would choose are told.  None if there are no positives, no unlabelled documents or no words.
    """
    small_batches(docs.sparkSession)
    known = labels.filter("doc_id is not null and toxic = 1").select("doc_id").distinct()
    n_known, total = known.count(), docs.count()
    if not n_known or not total:
        return None
    million = 1_000_000
    toxic_ids = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < million * min(1.0, positives / n_known))
    half = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2)), F.lit(0)).cast("int").alias("half")
    texts = docs.select("doc_id", "text").filter("text is not null")
    picked = texts.join(F.broadcast(toxic_ids), "doc_id").select("text", F.lit(1).alias("kind"), half)
    other = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(million)) < million * min(1.0, unlabelled / total)
    picked = picked.union(texts.filter(other).select("text", F.lit(0).alias("kind"), half))

    def work(batches):
        for batch in batches:
            for a, b, data, bounds in tb.slices(batch.column(0)):
                idx, at = _features(data, bounds)
                held = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(idx, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), held], names=["kind", "half", "words"])

    rows = stash(picked.mapInArrow(work, "kind int, half int, words array<int>"), "toxicity-sample")
    sizes = {(r.kind, r.half): r.n for r in rows.groupBy("kind", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = [(kind, h) for kind in (0, 1) for h in (0, 1)]
    if not any(sizes.get((0, h)) for h in (0, 1)) or not any(sizes.get((1, h)) for h in (0, 1)):
        return None
    each = rows.select("kind", "half", F.explode("words").alias("word"))
    tally = each.groupBy("word").agg(*[F.count(F.when((F.col("kind") == k) & (F.col("half") == h), 1)).alias(f"n{k}{h}") for k, h in cells])
    tally = stash(tally, "toxicity-words")

    def telling(halves: tuple[int, ...]) -> np.ndarray:
        """The words whose share among the positives is farthest from that among the unlabelled, in standard errors of chance."""
        p, u = (sum((F.col(f"n{k}{h}") for h in halves), F.lit(0)) for k in (1, 0))
        n_p, n_u = (float(sum(sizes.get((k, h), 0) for h in halves)) for k in (1, 0))
        if not n_p or not n_u:
            return np.zeros(0, np.int64)
        share = (p + u + 1) / (n_p + n_u + 1)
        apart = F.abs(p / n_p - u / n_u) / F.sqrt(share / n_p)
        best = tally.filter(p + u >= LEAST_DOCS).orderBy(apart.desc(), "word").limit(WORDS)
        return np.sort(np.array([r.word for r in best.select("word").collect()], np.int64))

    chosen = [telling(halves) for halves in ((0, 1), (0,), (1,))]
    if not len(chosen[0]):
        return None
    words = np.unique(np.concatenate(chosen))

    def bits(batches):
        for batch in batches:
            held = np.asarray(batch.column(2).values)
            at = np.asarray(batch.column(2).offsets)
            for s, e, kind, h in zip(at[:-1].tolist(), at[1:].tolist(), batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                dense = np.zeros(len(words), np.uint8)
                place = np.searchsorted(words, held[s:e])
                place = place[(place < len(words)) & (words[np.minimum(place, len(words) - 1)] == held[s:e])]
                dense[place] = 1
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([bytes([h]) + np.packbits(dense).tobytes()], pa.binary())], names=["kind", "bits"])

    got: tuple[list, list] = ([], [])
    for r in rows.mapInArrow(bits, "kind int, bits binary").toLocalIterator():  # 3 WORDS bits at most for each of the sample's documents
        got[r.kind].append(bytes(r.bits))
    # In an order that doesn't depend on how Spark has cut the sample.
    raw = [np.frombuffer(b"".join(sorted(x)), np.uint8).reshape(len(x), -1) for x in got]
    unl, pos = (np.unpackbits(x[:, 1:], axis=1)[:, : len(words)] for x in raw)
    whole, *by_half = (np.searchsorted(words, x) for x in chosen)
    return Sample(words, whole, tuple(by_half), pos, raw[1][:, 0], unl, raw[0][:, 0])


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> tuple[np.ndarray, float]:
    """Weights over BUCKETS hashed words and the bias, from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), both
    of training rows only.

    A document counts as confirmed toxic if any of its label rows says so; labels of 0 are not used.  ``prior`` is the
    share of toxic documents; without it, it is estimated from the confirmed and the unlabelled documents.  Words are
    counted in the sample by Spark, and the driver gets WORDS bits a sampled document, whatever its length.  Without
    positives or documents the classifier scores everything near 0.
    """
    got = sample(docs, labels, positives, unlabelled)
    if got is None:
        return np.zeros(BUCKETS, np.float32), -5.0
    w = train(got.pos[:, got.whole], got.unl[:, got.whole], estimate_prior(got) if prior is None else prior)
    out = np.zeros(BUCKETS, np.float32)
    out[got.words[got.whole]] = w[:-1]
    return out, float(w[-1])


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, score in 0..1, predicted (1 from 0.5 on).

    A null or wordless text scores by the bias alone.  Every input row gives one row, repeated and null ids
    included; other columns are not read; an empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast((weights, bias))

    def work(batches):
        w, b0 = model.value
        for batch in batches:
            for a, b, data, bounds in tb.slices(batch.column(1)):
                idx, at = _features(data, bounds)
                s = _sigmoid(np.bincount(np.repeat(np.arange(b - a), np.diff(at)), w[idx], minlength=b - a) + b0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"]
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, score double, predicted int")


def held_out(id_col: str = "doc_id"):
    """Rows whose labels training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
