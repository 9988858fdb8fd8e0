"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

The kernel of two strings sums, over every three- and four-symbol subsequence both
contain, the product of its weights; an occurrence that spans ``n`` symbols weighs
``DECAY ** n``, so insults with gaps or inserted characters still match, at a discount,
up to ``SPAN`` symbols (one less for four).  Strings are windows of ``WINDOW`` folded symbols: letters without case,
digits and signs that pass for letters, blanks, and the rest as one symbol each.

Landmarks are substrings that are frequent in toxic training texts and rare in others,
and windows of other texts.  A window's features are its kernel values with the
landmarks times the inverse root of the landmarks' own kernel matrix (Nyström); the
SVM is trained in numpy on one window per training text, the one that scores highest,
chosen anew in a few rounds since labels mark texts and not the sentence that is toxic.

The trained function is linear in a window's subsequence weights, so it shrinks to one
number per subsequence (2^15 and 2^20 of them), exactly; a text's score is its best
window's.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext
from .shipping import ship, worker
from .training import classes, held_out, sample

SPAN, WINDOW, DECAY = 7, 14, 0.6
SYMBOLS = 32
LANDMARKS, GRAM, ROUNDS = 224, 5, 4
PER_CLASS, LONGEST = 1500, 20_000
_BLANK, _OTHER, _SIGN = 0, 27, 28

# Signs and digits written for letters.
_PASSING = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def _fold() -> np.ndarray:
    table = np.full(256, _SIGN, np.int32)
    table[0x80:] = _OTHER
    table[[0x20, *range(0x09, 0x0E)]] = _BLANK
    for k in range(26):
        table[[0x41 + k, 0x61 + k]] = k + 1
    for sign, letter in _PASSING.items():
        table[ord(sign)] = ord(letter) - 0x60
    return table


FOLD = _fold()
#: Steps between the symbols of a subsequence, by how many it has.
STEPS = [s for s in product(range(1, SPAN), repeat=2) if sum(s) < SPAN]
STEPS += [s for s in product(range(1, SPAN), repeat=3) if sum(s) < SPAN - 1]
THREE = SYMBOLS**3
CODES = THREE + SYMBOLS**4  # codes of three symbols, then codes of four


def symbols(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded texts with ``WINDOW`` blanks before each; and the new bounds.

    No subsequence reaches from one text into the next, and an empty text still has
    windows, of blanks.
    """
    size = np.diff(bounds)
    new = bounds + WINDOW * np.arange(len(bounds))
    out = np.full(new[-1] + WINDOW, _BLANK, np.int32)
    out[np.arange(len(data)) + np.repeat(new[:-1] + WINDOW - bounds[:-1], size)] = FOLD[data]
    return out[: new[-1]], new


def window_scores(sym: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """For each position, the sum over subsequences that end in the window closed by it."""
    two, one = sym << 10, sym << 5
    three = sym << 15
    ends = np.zeros(len(sym), np.float32)
    weights = DECAY ** np.arange(SPAN + 1, dtype=np.float32)
    for steps in STEPS:
        cut, n = sum(steps), len(sym)
        if len(steps) == 2:
            at, table = two[: n - cut] + one[steps[0] : n - steps[1]], numbers[:THREE]
        else:
            at = three[: n - cut] + two[steps[0] : n - cut + steps[0]]
            at += one[cut - steps[2] : n - steps[2]]
            table = numbers[THREE:]
        at += sym[cut:]
        ends[cut:] += table[at] * weights[cut + 1]
    sums = np.concatenate((np.zeros(WINDOW), np.cumsum(ends, dtype=np.float64)))
    return sums[WINDOW:] - sums[:-WINDOW]


def subsequences(windows: np.ndarray, tail: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All subsequence codes of windows (rows of symbols), and the weight of each column.

    With ``tail``, only those that end in the last ``tail`` symbols.
    """
    codes, weights = [], []
    n = windows.shape[1]
    for steps in (s for s in STEPS if sum(s) < n):
        cut = sum(steps)
        first = max(0, n - tail - cut) if tail else 0
        code, at = np.zeros((len(windows), n - cut - first), np.int64), first
        for step in (0, *steps):
            at += step
            code = code << 5 | windows[:, at : at + code.shape[1]]
        codes.append(code + THREE * (len(steps) == 3))
        weights.append(np.full(code.shape[1], DECAY ** (cut + 1), np.float32))
    return np.concatenate(codes, 1), np.concatenate(weights)


def _landmark_matrix(landmarks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised weights, subsequences x landmarks; the codes of its rows; the row of each code.

    Row 0 stands for every subsequence that no landmark has.
    """
    found = [subsequences(s[None]) for s in landmarks]
    codes = np.unique(np.concatenate([c[0] for c, _ in found]))
    row = np.zeros(CODES, np.int32)
    row[codes] = np.arange(1, len(codes) + 1)
    out = np.zeros((len(codes) + 1, len(landmarks)), np.float32)
    for c, (code, weights) in enumerate(found):
        np.add.at(out[:, c], row[code[0]], weights)
    return out / np.maximum(np.linalg.norm(out, axis=0), 1e-9), codes, row


def _grams(sym: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the ``GRAM``-symbol substrings of a batch, and the document of each."""
    code = np.zeros(len(sym) - GRAM + 1, np.int64)
    for i in range(GRAM):
        code = code << 5 | sym[i : len(sym) - GRAM + 1 + i]
    doc = np.searchsorted(new, np.arange(len(code)), "right") - 1
    inside = np.arange(len(code)) + GRAM <= new[doc + 1]
    return code[inside], doc[inside]


def _telling(blocks: list, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Substrings by how much more toxic than other texts hold them (a G statistic)."""
    held = []
    for first, sym, new in blocks:
        code, doc = _grams(sym, new)
        pair = np.unique(code << 24 | doc)
        kinds, where = np.unique(pair >> 24, return_inverse=True)
        held.append((kinds, np.bincount(where, y[first + (pair & 0xFFFFFF)]), np.bincount(where)))
    kinds, where = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
    toxic, every = (np.bincount(where, np.concatenate([h[k] for h in held])) for k in (1, 2))
    share, total = y.mean(), every + 1.0
    rate = (toxic + share) / total
    g = total * (rate * np.log(rate / share) + (1 - rate) * np.log(np.maximum(1 - rate, 1e-9) / (1 - share)))
    g[rate <= share] = 0
    return kinds, g


def _svm(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear SVM by averaged stochastic sub-gradient steps; y in -1, 1; classes balanced."""
    w, b = np.zeros(x.shape[1]), 0.0
    mean_w, mean_b, seen = w.copy(), 0.0, 0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    for epoch in range(30):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 32):
            part = order[i : i + 32]
            miss = y[part] * (x[part] @ w + b) < 1
            g = (weight[part] * y[part] * miss) / len(part)
            rate = 4.0 / (1 + 0.02 * seen**0.75)
            w += rate * (g @ x[part] - penalty * w)
            b += rate * g.sum()
            seen += 1
            if epoch >= 15:
                k = seen - 15 * -(-len(y) // 32)
                mean_w += (w - mean_w) / k
                mean_b += (b - mean_b) / k
    return mean_w, mean_b


def _logistic(v: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn a score into the chance of label 1."""
    middle, scale = v.mean(), v.std() + 1e-9
    x = np.stack([(v - middle) / scale, np.ones(len(v))])
    t = np.where(y > 0, 1 - 1 / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        h = (x * (p * (1 - p))) @ x.T + 1e-4 * np.eye(2)
        theta += np.linalg.solve(h, x @ (t - p) - 1e-4 * theta)
    slope = max(theta[0], 1e-6) / scale
    return float(slope), float(theta[1] - slope * middle)


def train(texts: list[str], labels: list[int], seed: int = 9) -> tuple[np.ndarray, float, float]:
    """A number per subsequence, and slope and offset of the score."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:  # nothing to tell apart
        return np.zeros(CODES, np.float32), 1.0, (4.0 * float(y[0]) - 2.0) if len(y) else -0.1
    rng = np.random.default_rng(seed)
    data, bounds = vectext.flatten(pa.array(texts, pa.large_string()))
    blocks = [
        (i, *symbols(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])) for i, j in vectext.blocks(bounds, 500_000)
    ]
    kinds, g = _telling(blocks, y.astype(float))
    best = np.argsort(-g, kind="stable")[: LANDMARKS * 2 // 3]
    best = best[g[best] > 0]
    marks = [np.array([kinds[c] >> 5 * (GRAM - 1 - i) & 31 for i in range(GRAM)], np.int64) for c in best]

    def other(room: int) -> list[np.ndarray]:
        """A random window, and the ``room`` symbols up to its end, of each text with label 0."""
        out = []
        for first, sym, new in blocks:
            for d in np.flatnonzero(y[first : first + len(new) - 1] == 0).tolist():
                end = int(rng.integers(new[d] + WINDOW, new[d + 1] + 1))
                out.append(np.concatenate((np.zeros(room, np.int64), sym[max(0, end - room) : end]))[-room:])
        return out

    wide = WINDOW + SPAN - 1
    clean = other(wide)
    more = LANDMARKS - len(marks)
    marks += [clean[i][-WINDOW:] for i in rng.choice(len(clean), min(more, len(clean)), replace=False)]
    phi, codes, row = _landmark_matrix(marks)
    value, vector = np.linalg.eigh((phi.T @ phi).astype(np.float64))
    root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T

    def kernels(windows: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(windows), len(marks)))
        for i in range(0, len(windows), 64):
            # Subsequences that begin before the window but end in it count, as in scoring.
            code, weights = subsequences(np.stack(windows[i : i + 64]), WINDOW)
            some = phi[row[code].ravel()].reshape(*code.shape, -1)
            out[i : i + len(code)] = np.matmul(weights, some)
        return out @ root

    def spread(of_rows: np.ndarray) -> np.ndarray:
        numbers = np.zeros(CODES, np.float32)
        numbers[codes] = of_rows[1:]
        return numbers

    def tops(numbers: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each text's best score, and the symbols up to the end of its best window."""
        value, windows = [], []
        for _, sym, new in blocks:
            score = window_scores(sym, numbers)
            for a, b in zip(new[:-1].tolist(), new[1:].tolist(), strict=True):
                end = a + int(score[a:b].argmax()) + 1
                value.append(score[end - 1])
                windows.append(np.concatenate((np.zeros(wide, np.int64), sym[max(0, end - wide) : end]))[-wide:])
        return np.array(value), windows

    # First choice: the windows richest in telling substrings.
    numbers = spread(phi[:, : len(best)] @ np.sqrt(g[best] / (g.max() + 1e-9)))
    others = kernels(clean)
    for _ in range(ROUNDS):
        chosen = kernels(tops(numbers)[1])
        x = np.concatenate((chosen[y > 0], chosen[y == 0], others))
        sign = np.where(np.arange(len(x)) < (y > 0).sum(), 1.0, -1.0)
        scale = np.linalg.norm(x, axis=1).mean() + 1e-9
        w, _ = _svm(x / scale, sign, rng)
        numbers = spread(phi @ (root @ w) / scale)
        others = np.concatenate((others, chosen[y == 0]))  # windows of other texts stay
    return (numbers, *_logistic(tops(numbers)[0], y))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, slope, offset = model.value
        for batch in batches:
            flat, limits = vectext.flatten(batch.column(1))
            for first, last in vectext.blocks(limits, 500_000):
                bounds = limits[first : last + 1] - limits[first]
                sym, new = symbols(flat[limits[first] : limits[last]], bounds)
                top = np.maximum.reduceat(window_scores(sym, numbers), new[:-1])
                p = 1 / (1 + np.exp(-np.clip(slope * top + offset, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(p)], names=["doc_id", "score"])

    return run


def toxicity(documents: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    ``score`` estimates the chance of ``labels.toxic`` = 1.  Training takes up to
    ``per_class`` rows of each label outside the held-out part, with texts of up to
    ``LONGEST`` characters; a text is the only input of its score, which reads all of
    it.  Null and empty texts score as blanks; without labels, or with one label only,
    all texts get one score.  Null labels are skipped, a null ``doc_id`` is scored and
    counts as held out, repeated rows are each scored, other columns are ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(parts, part) & F.col("toxic").isin(0, 1)).distinct()
    texts, y = sample(docs, classes(known, "toxic", per_class), "toxic", LONGEST)
    model = spark.sparkContext.broadcast(train(texts, y))  # one number per subsequence: 4 MB
    scored = docs.mapInArrow(worker(_score(model)), "doc_id long, score double")
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", held_out(parts, part).alias("held_out"), "score", predicted)
