"""Language identification by a byte convolutional network.

Bytes are embedded, filters of widths two, three and four slide over a window of 512
bytes, each filter's largest response is kept, and a softmax over the languages
follows.  The network is trained in numpy (Adam, gradients through the maxima only) on
a bounded sample of labelled documents.  A text of any length is cut into consecutive
windows, the last one padded; the windows' mean log probabilities decide.

Scoring adds, for each filter width, table rows for byte pairs: the tables hold the
filters' responses to an embedded pair, so no text is embedded at all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from . import vectext
from .shipping import ship, worker
from .training import classes, held_out, sample

WINDOW, EMBED, FILTERS, WIDTHS = 512, 8, 8, (2, 3, 4)
PER_LANGUAGE, LONGEST, STEPS, BATCH = 600, 20_000, 700, 48
UNDETERMINED = "und"


def _windows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded windows x bytes, and the n + 1 window bounds of the documents."""
    size = np.diff(bounds)
    n = -(-size // WINDOW)
    per_doc = np.concatenate(([0], np.cumsum(n)))
    # A document's windows are full but for the last: shift it to its first window.
    shift = per_doc[:-1] * WINDOW - bounds[:-1]
    out = np.zeros(per_doc[-1] * WINDOW, np.uint8)
    out[np.arange(len(data)) + np.repeat(shift, size)] = data
    return out.reshape(-1, WINDOW), per_doc


def _forward(windows: np.ndarray, net: dict) -> tuple[np.ndarray, list, np.ndarray]:
    x = np.pad(net["embed"][windows], ((0, 0), (0, max(WIDTHS) - 1), (0, 0)))
    top, at = [], []
    for w in WIDTHS:
        wide = np.lib.stride_tricks.sliding_window_view(x, w, axis=1)[:, :WINDOW]
        wide = wide.transpose(0, 1, 3, 2).reshape(len(x), WINDOW, w * EMBED)
        z = wide @ net[f"w{w}"]
        best = z.argmax(1)
        at.append(best)
        top.append(np.take_along_axis(z, best[:, None], 1)[:, 0])
    h = np.maximum(np.concatenate(top, 1) + net["b"], 0)
    return h, at, x


def train(texts: list[str], labels: list[str], seed: int = 3) -> dict | None:
    """A network over the given labels; None without any text."""
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    raw = [t.encode() for t in texts]
    y = np.array([names.index(k) for k in labels])
    net = {"embed": rng.normal(0, 0.5, (256, EMBED)), "b": np.zeros(FILTERS * len(WIDTHS))}
    net |= {f"w{w}": rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS)) for w in WIDTHS}
    net |= {"out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names))), "c": np.zeros(len(names))}
    net = {k: v.astype(np.float32) for k, v in net.items()}
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    groups = [np.flatnonzero(y == k) for k in range(len(names))]
    for step in range(1, STEPS + 1):
        pick = np.array([rng.choice(groups[i % len(names)]) for i in range(BATCH)])
        rows = np.zeros((BATCH, WINDOW), np.uint8)
        for r, d in enumerate(pick.tolist()):
            n = -(-len(raw[d]) // WINDOW)
            part = raw[d][(k := int(rng.integers(n)) * WINDOW) : k + WINDOW]
            rows[r, : len(part)] = np.frombuffer(part, np.uint8)
        h, at, x = _forward(rows, net)
        z = h @ net["out"] + net["c"]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(BATCH), y[pick]] -= 1
        p /= BATCH
        grad = {"out": h.T @ p, "c": p.sum(0)}
        g = (p @ net["out"].T) * (h > 0)
        grad["b"] = g.sum(0)
        embed = np.zeros_like(net["embed"])
        padded = np.pad(rows, ((0, 0), (0, max(WIDTHS) - 1)))
        for i, w in enumerate(WIDTHS):
            mine, best = g[:, i * FILTERS : (i + 1) * FILTERS], at[i]
            grad[f"w{w}"] = np.zeros_like(net[f"w{w}"])
            for k in range(w):
                seen = x[np.arange(BATCH)[:, None], best + k]  # batch, filter, embed
                part = slice(k * EMBED, (k + 1) * EMBED)
                grad[f"w{w}"][part] = np.einsum("bfe,bf->ef", seen, mine)
                back = mine[:, :, None] * net[f"w{w}"][part].T[None]
                np.add.at(embed, padded[np.arange(BATCH)[:, None], best + k], back)
        embed[0] = 0  # padding stays as it is
        grad["embed"] = embed
        rate = 0.01 * (1 - step / (STEPS + 1))
        for k, v in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.999 * second[k] + 0.001 * v * v
            m, s = first[k] / (1 - 0.9**step), second[k] / (1 - 0.999**step)
            net[k] = (net[k] - rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
    return {"names": names, **net}


def _tables(net: dict) -> dict:
    """Responses of each width's filters to single bytes and byte pairs."""
    one = {(w, k): net["embed"] @ net[f"w{w}"][k * EMBED : (k + 1) * EMBED] for w in WIDTHS for k in range(w)}
    pair = lambda w, k: (one[w, k][:, None] + one[w, k + 1][None]).reshape(1 << 16, FILTERS)
    return {2: [(0, True, pair(2, 0))], 3: [(0, True, pair(3, 0)), (2, False, one[3, 2])], 4: [(0, True, pair(4, 0)), (2, True, pair(4, 2))]}


def log_probabilities(windows: np.ndarray, net: dict, tables: dict) -> np.ndarray:
    out = np.empty((len(windows), len(net["names"])))
    for i in range(0, len(windows), 128):
        part = windows[i : i + 128]
        x = np.pad(part, ((0, 0), (0, max(WIDTHS)))).astype(np.intp)
        pairs = x[:, :-1] << 8 | x[:, 1:]
        top = []
        for w in WIDTHS:
            z = None
            for k, paired, table in tables[w]:
                one = np.take(table, (pairs if paired else x)[:, k : k + WINDOW], axis=0)
                z = one if z is None else z + one
            top.append(z.max(1))
        h = np.maximum(np.concatenate(top, 1) + net["b"], 0)
        z = (h @ net["out"] + net["c"]).astype(np.float64)
        z -= z.max(1, keepdims=True)
        out[i : i + 128] = z - np.log(np.exp(z).sum(1, keepdims=True))
    return out


_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _has_letter(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    count = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[bounds])
    out = count(_LETTER[data]) > 0
    for d in np.flatnonzero(~out & (count(data >= 0x80) > 0)).tolist():
        text = data[bounds[d] : bounds[d + 1]].tobytes().decode(errors="replace")
        out[d] = any(c.isalpha() for c in text)
    return out


def _predict(model, carry: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        tables = _tables(net) if net else None
        for batch in batches:
            for first, last, data, bounds in vectext.text_blocks(batch.column(1)):
                n = last - first
                name, score = np.full(n, UNDETERMINED, object), np.zeros(n)
                known = _has_letter(data, bounds)
                if net and known.any():
                    windows, per_doc = _windows(data, bounds)
                    sums = np.cumsum(log_probabilities(windows, net, tables), axis=0)
                    sums = np.concatenate((np.zeros((1, sums.shape[1])), sums))
                    of = np.flatnonzero(known)
                    z = sums[per_doc[of + 1]] - sums[per_doc[of]]
                    z /= (per_doc[of + 1] - per_doc[of])[:, None]
                    p = np.exp(z - z.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    name[of] = np.array(net["names"], object)[p.argmax(1)]
                    score[of] = p.max(1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n), pa.array(name, pa.string()), pa.array(score),
                        *(batch.column(c).slice(first, n) for c in carry),
                    ],
                    names=["doc_id", "lang_pred", "score", *carry],
                )

    return run


def identify(documents: DataFrame, parts: int = 5, part: int = 0, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document.

    Learns from up to ``per_language`` documents of each non-null ``lang`` outside the
    held-out part, with texts of up to ``LONGEST`` characters; the text is the only
    input of a prediction, which reads all of it.  A null text, or one without a letter,
    gets ``und`` and score 0, as does every text when there is nothing to learn from.
    A null ``doc_id`` is predicted and counts as held out; repeated rows are each
    predicted; other columns are ignored.
    """
    return predict(documents, learn(documents, parts, part, per_language), parts, part)


def learn(documents: DataFrame, parts: int = 5, part: int = 0, per_language: int = PER_LANGUAGE) -> dict | None:
    """A network trained on a bounded sample; None where no document is labelled."""
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    )
    known = docs.where(~held_out(parts, part) & (F.length("text") <= LONGEST))
    return train(*sample(docs, classes(known, "lang", per_language).distinct(), "lang", LONGEST))


def predict(
    documents: DataFrame, net: dict | None, parts: int = 5, part: int = 0, carry: Sequence[str] = ()
) -> DataFrame:
    """Apply a trained network (a few tens of kilobytes) to every whole text.

    Columns named in ``carry``, the text too, stay with their rows.
    """
    ship(documents.sparkSession)
    model = documents.sparkSession.sparkContext.broadcast(net)
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c for c in carry if c != "text")
    )
    schema = _parse_datatype_string("doc_id long, lang_pred string, score double")
    for name in carry:
        schema = schema.add(docs.schema[name])
    scored = docs.mapInArrow(worker(_predict(model, tuple(carry))), schema)
    return scored.select("doc_id", held_out(parts, part).alias("held_out"), "lang_pred", "score", *carry)
