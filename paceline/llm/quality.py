"""Document quality from supervised subword embeddings.

Features of a text are its words, word pairs, n-grams of three and four bytes, and the
event that a word repeats one of the eight before it, all hashed into one table of
learned vectors.  A document is the mean of its features' vectors; a softmax over two
classes is trained with the vectors by stochastic gradient descent in numpy, on a
bounded sample of labelled rows.  Since the output is linear in the mean, the trained
table shrinks to one number per bucket, and scoring a whole text is a gather and a sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext
from .shipping import ship, worker
from .training import classes, held_out, sample

BITS, WIDTH, EPOCHS, RATE = 18, 8, 6, 0.5
PER_CLASS, LONGEST = 2500, 20_000
REPEATS = 8
_SHIFT = np.uint64(64 - BITS)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _features(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, document bounds among them) for each kind of feature."""
    h, per_doc = vectext.word_hashes(data, bounds, vectext.NOT_SPACE, fold=False)
    yield (h >> _SHIFT).astype(np.int64), per_doc
    # Pairs and byte n-grams end with their document.
    inner = np.ones(len(h), bool)
    inner[per_doc[1:][np.diff(per_doc) > 0] - 1] = False
    at = np.flatnonzero(inner)
    yield (vectext.gram_hashes(h, 2)[at] >> _SHIFT).astype(np.int64), np.searchsorted(at, per_doc)
    # Only a repeat is a feature; its bucket says how far back.
    first = np.repeat(per_doc[:-1], np.diff(per_doc))
    lag = np.zeros(len(h), np.int64)
    for k in range(REPEATS, 0, -1):
        same = np.flatnonzero(h[k:] == h[:-k]) + k
        lag[same[same - k >= first[same]]] = k
    at = np.flatnonzero(lag)
    yield lag[at], np.searchsorted(at, per_doc)
    wide = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint64)
    three = wide[:-3] | wide[1:-2] << np.uint64(8) | wide[2:-1] << np.uint64(16)
    four = three | wide[3:] << np.uint64(24)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(data))
    for n, grams, salt in ((3, three, 1), (4, four, 1 << 40)):
        at = np.flatnonzero(left >= n)
        yield ((grams[at] + np.uint64(salt)) * _ODD >> _SHIFT).astype(np.int64), np.searchsorted(at, bounds)


def _rows(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each document and their shares."""
    kinds = list(_features(data, bounds))
    for d in range(len(bounds) - 1):
        index = np.concatenate([f[b[d] : b[d + 1]] for f, b in kinds])
        index, n = np.unique(index, return_counts=True)
        yield index, (n / max(1, n.sum())).astype(np.float32)


def train(texts: list[str], labels: list[int], seed: int = 5) -> tuple[np.ndarray, float]:
    """One weight per bucket and a bias: the log odds of label 1 are their mean plus it."""
    rng = np.random.default_rng(seed)
    vectors = (rng.random((1 << BITS, WIDTH), np.float32) - 0.5) * 0.2
    out, bias = rng.normal(0, 0.3, (2, WIDTH)).astype(np.float32), np.zeros(2, np.float32)
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:  # nothing to tell apart
        return np.zeros(1 << BITS, np.float32), float(2.0 * y.mean() - 1.0) if len(y) else 0.0
    rows = []
    for i in range(0, len(texts), 200):
        data, bounds = vectext.flatten(pa.array(texts[i : i + 200], pa.large_string()))
        rows += _rows(data, bounds)
    weight = len(y) / (2.0 * np.bincount(y, minlength=2))
    for epoch in range(EPOCHS):
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        for d in rng.permutation(len(rows)):
            index, share = rows[d]
            near = vectors[index]
            mean = share @ near * 10
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[d]] -= 1
            p *= np.float32(weight[y[d]]) * rate
            vectors[index] = near - np.minimum(share * 100, 1)[:, None] * (p @ out)
            out -= np.outer(p, mean)
            bias -= p
    return vectors @ (out[1] - out[0]) * 10, float(bias[1] - bias[0])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = model.value
        for batch in batches:
            for first, last, data, bounds in vectext.text_blocks(batch.column(1)):
                total, n = np.zeros(last - first), np.zeros(last - first)
                for index, per_doc in _features(data, bounds):
                    some = np.flatnonzero(np.diff(per_doc))
                    if len(some):  # each text's own sum, whatever its neighbours
                        total[some] += np.add.reduceat(table[index].astype(np.float64), per_doc[some])
                    n += np.diff(per_doc)
                z = np.clip(total / np.maximum(n, 1) + bias, -30, 30)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"]
                )

    return run


def quality(
    documents: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1, per_class: int = PER_CLASS
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    ``score`` estimates the chance of ``labels.quality`` = 1.  Training takes up to
    ``per_class`` rows of each label, outside the held-out part, with texts of up to
    ``LONGEST`` characters; a text is the only input of its score, which reads all of
    it.  Null and empty texts have no features and get the bias alone; without labels
    every score is 0.5.  Null labels are skipped, a null ``doc_id`` is scored and counts
    as held out, repeated rows are each scored, other columns are ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(~held_out(parts, part) & F.col("quality").isin(0, 1)).distinct()
    texts, y = sample(docs, classes(known, "quality", per_class), "quality", LONGEST)
    model = spark.sparkContext.broadcast(train(texts, y))  # one number per bucket: 1 MB
    scored = docs.mapInArrow(worker(_score(model)), "doc_id long, score double")
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", held_out(parts, part).alias("held_out"), "score", predicted)
