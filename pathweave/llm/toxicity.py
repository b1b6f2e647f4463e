"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

The features of a text are the distinct buckets of its words, of its adjacent words, of its words one apart and, so that
forms of a word not seen in learning count too, of the words' stems of a few lengths. Learning runs over a bounded sample of labelled documents in one task: each coordinate has its own rate, which falls with the
squares of its gradients, and L1 keeps coordinates at zero unless evidence adds up. What is left is a short table of
weights that every task gets; scoring reads all documents and whole texts.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pathweave.llm.workers import each_text, reachable
from pathweave.session import settle

#: Buckets of features; the place behind them is the intercept.
BUCKETS = 1 << 20
#: Labelled documents of each class that are learnt from at most, those with the smallest hash of their key, and the
#: longest text, in characters, that is learnt from.
SAMPLE_PER_CLASS = 8_192
SAMPLE_CHARS = 65_536
#: Bytes of a word that make a stem.
STEMS = (4, 5, 6)
#: Learning: rate, smoothing of rates, L1 and L2; passes, and more of them over a small sample up to so many steps.
ALPHA, BETA, L1, L2 = 0.6, 1.0, 8.0, 1.0
PASSES, MOST_PASSES, STEPS = 3, 20, 30_000
#: Score from which a document counts as toxic.
THRESHOLD = 0.3

# A-Z to lower case; ASCII punctuation and symbols part words
_PLAIN = bytes(ord(" ") if 33 <= b < 127 and not chr(b).isalnum() else b for b in bytes(range(256)).lower())


def buckets_of(text: bytes | None) -> np.ndarray:
    """Buckets of a text's features, with repeats."""
    words = (text or b"").translate(_PLAIN).split()
    crc = zlib.crc32
    h = np.fromiter(map(crc, words), np.uint32, len(words)).astype(np.uint64)
    stems = [np.fromiter([crc(w[:n], n) for w in words if len(w) > n], np.uint32).astype(np.uint64) + np.uint64(n << 32) for n in STEMS]
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + np.uint64(1)
    skips = h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] + np.uint64(2)
    mixed = np.concatenate((h, pairs, skips, *stems))
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(44)).astype(np.int64)


def fit(texts: Iterable[bytes | None], labels: list[float], weights: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights that are not zero, after the passes over the texts in the given order.

    ``weights`` tell how many documents of its class a text stands for. Gradients see them relative to the mean of the
    class only, so that L1 and rates mean the same at any number of labels; how much more common one class is than in the
    sample goes into the intercept afterwards, as log-odds. Texts are read once; what stays are their features, one after
    the other in one array.
    """
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    l1 = np.full(BUCKETS + 1, L1)
    l1[BUCKETS] = 0.0
    features, ends = array("i"), [0]
    for t in texts:
        features.frombytes(np.append(np.unique(buckets_of(t)), BUCKETS).astype(np.int32).tobytes())
        ends.append(len(features))
    places = np.frombuffer(features, np.int32)
    rows = list(zip(ends, ends[1:]))
    toxic, stands_for = np.array(labels) == 1.0, np.array(weights, np.float64)
    means = [stands_for[c].mean() if c.any() else None for c in (toxic, ~toxic)]
    prior = math.log(means[0] / means[1]) if None not in means else 0.0
    relative = [w / means[0 if t else 1] for t, w in zip(toxic.tolist(), stands_for.tolist())]

    def weight(at):
        zi, li = z[at], l1[at]
        return np.where(np.abs(zi) <= li, 0.0, -(zi - np.sign(zi) * li) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(max(PASSES, min(MOST_PASSES, STEPS // max(1, len(rows))))):
        for (begin, end), y, importance in zip(rows, labels, relative):
            at = places[begin:end]
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * importance
            ni = n[at]
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    w = weight(np.arange(BUCKETS + 1))
    w[BUCKETS] += prior
    at = np.flatnonzero(w)
    return at, w[at]


def _fit_task(batches):
    """All batches of the one task that learns: ``(text, label, weight)`` rows in, places and weights in one row out."""
    labels, weights = [], []

    def texts():
        for batch in batches:
            labels.extend(batch.column(1).to_pylist())
            weights.extend(batch.column(2).to_pylist())
            yield from each_text(batch.column(0))

    at, w = fit(texts(), labels, weights)
    if labels:
        lists = [pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([w.tolist()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(lists, names=["places", "weights"])


def held_out(key: str = "doc_id") -> Column:
    """Rows never learnt from: CRC-32 of the key as text has remainder 2 of 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """The model: places and weights, at most ``BUCKETS`` + 1 of them, and a few thousand under L1.

    Labels of one key are averaged; null labels, null keys, keys that are held out and keys without a document are not
    used, so that these take no places of the sample. Labelled documents of a class beyond the sample count through the
    intercept. Of a key's texts the one with the smallest hash is learnt from; keys of equal hash come in their order.
    Texts above ``SAMPLE_CHARS`` are scored, but not learnt from. Without labels the model is empty.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    known = known.groupBy(F.col(key).alias("k")).agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    present = docs.select(F.col(key).alias("k")).where(F.col("k").isNotNull()).distinct()
    known, _ = settle(known.join(present, "k", "left_semi"))
    # keys only: at most SAMPLE_PER_CLASS rows of two numbers from either class
    firsts = [known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(SAMPLE_PER_CLASS) for y in (1.0, 0.0)]
    totals = known.groupBy("y").agg(F.greatest(F.lit(1.0), F.count(F.lit(1)) / SAMPLE_PER_CLASS).alias("w"))
    chosen = firsts[0].unionByName(firsts[1]).join(F.broadcast(totals), "y")
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).where(F.coalesce(F.length("t"), F.lit(0)) <= SAMPLE_CHARS)
    # one text of each key, so that repeated keys don't make the sample larger; combined before the shuffle
    sample = texts.join(F.broadcast(chosen), F.col("id") == F.col("k")).groupBy("k", "y", "w").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))
    sample = sample.select("t", "y", "w", F.xxhash64("k", F.lit(1)).alias("o"))
    one = sample.repartition(1).sortWithinPartitions("o", "t").select("t", "y", "w")
    rows = reachable(one).mapInArrow(_fit_task, "places array<long>, weights array<double>").collect()  # one row
    return (np.array(rows[0][0], np.int64), np.array(rows[0][1])) if rows else (np.zeros(0, np.int64), np.zeros(0))


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of a text to be toxic; 0 for all from an empty model. Null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        places, weights = shared.value
        dense = np.zeros(BUCKETS + 1)
        dense[places] = weights
        out = []
        for t in each_text(texts):
            at = buckets_of(t)
            at = at[dense[at] != 0]
            out.append(dense[np.unique(at)].sum() + dense[BUCKETS] if len(places) else -np.inf)
        return pa.array(1 / (1 + np.exp(-np.array(out))), pa.float64())

    return reachable(docs).withColumn(name, score(F.col(text)))


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``held_out``, ``score`` and ``predicted``, 1 from ``threshold`` on.

    Repeated rows get the same score. The score sees the text alone, a very long one whole; a null one counts as empty.
    Other columns are not read. Empty tables give empty ones.
    """
    own = docs.select(F.col(key).alias(key), F.col(text).alias("_text"))
    out = scored(own, train(docs, labels, text=text, key=key), "_text")
    return out.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    # rows go along as one structure, so that none of their columns can clash with the score
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    return scored(rows, train(docs, labels, text=text, key=key), "text").where(F.col("score") < threshold).select("row.*")
