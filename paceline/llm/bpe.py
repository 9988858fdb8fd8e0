"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A piece (one pre-token) starts as single-byte symbols.  Leaf ``p`` of a segment
tree holds the merge rank of symbol ``p`` and its right neighbour, so the root is
the leftmost pair of lowest rank.  A merge changes three leaves, each by one walk
to the root; merging ends when the root holds no rank.  Short pieces run through
their trees side by side as numpy arrays, a long piece through a tree of its own.

Texts are cut into units that no token crosses, and every distinct unit is encoded
once while it stays in the worker's memo; the memo is bounded and only saves time.  Whole texts are processed, of any length.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext
from .shipping import ship, worker
from .units import Memo, spread

LOCKSTEP = 64  # symbols up to which pieces run side by side
_NONE = np.int64(1) << np.int64(40)
_loaded: dict[str, Vocabulary] = {}


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A lower-casing byte-level BPE with word ends, from a tokenizer file's text."""

    def __init__(self, source: str) -> None:
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(source)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in (vocab | self.special).items()}
        text = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.name_bytes = np.frombuffer(b"".join(text), np.uint8)
        self.name_size = np.array([len(t) for t in text])
        self.name_start = np.cumsum(self.name_size) - self.name_size
        alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self.inner = np.array([vocab[c] for c in alphabet], np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in alphabet], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        self.rule = {(a, b): (r, m) for r, (a, b, m) in enumerate(pairs)}
        key = np.array([a << 32 | b for a, b, _ in pairs], np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.merged = np.array([m for *_, m in pairs], np.int64)
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        library = Tokenizer.from_str(source)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # Characters whose normal form is their lower case, one for one.
        self.plain = re.compile(r"[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-įı-ž]*")
        self.memo = Memo(self.encode)

    def pieces(self, chunk: str) -> list[bytes | int]:
        """Pre-tokens of a chunk without blanks, as bytes; special tokens as ids."""
        if self.cut is not None and "<" in chunk:
            parts = self.cut.split(chunk)
            if len(parts) > 1:
                return [
                    y for i, x in enumerate(parts) if x
                    for y in ([self.special[x]] if i % 2 else self.pieces(x))
                ]
        if self.plain.fullmatch(chunk):
            low = chunk.lower()
            if low.isalpha():
                return [low.encode()]
            return [x.encode() for x in self.pattern.findall(low)]
        low = self.normalizer.normalize_str(chunk)
        found = self.pre_tokenizer.pre_tokenize_str(low)
        return [bytes(map(self.byte_of.__getitem__, x)) for x, _ in found]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.ranks[at], _NONE)

    def lockstep(self, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge pieces of at most ``size`` bytes (a power of two) side by side."""
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        at = np.arange(size)
        sym = np.where(at < lengths[:, None], self.inner[raw], -1)
        rows = np.arange(n)
        sym[rows, lengths - 1] = self.final[raw[rows, lengths - 1]]
        right = np.full((n, size), -1)
        right[:, :-1] = sym[:, 1:]
        # Links hold positions; the column ``size`` is a dummy for "none".
        sym = np.pad(sym, ((0, 0), (0, 1)), constant_values=-1).ravel()
        after = np.where(at + 1 < lengths[:, None], at + 1, size)
        after = np.pad(after, ((0, 0), (0, 1)), constant_values=size).ravel()
        before = np.pad(np.tile(np.where(at > 0, at - 1, size), (n, 1)), ((0, 0), (0, 1)), constant_values=size).ravel()
        # The rank of a pair, then its position: the least value is the leftmost best.
        ranks = self.rank(sym.reshape(n, -1)[:, :-1], right)
        tree = np.full((n, 2 * size), _NONE)
        tree[:, size:] = np.where(ranks < _NONE, ranks * size + at, _NONE)
        width = size
        while width > 1:
            level = tree[:, width : 2 * width]
            width //= 2
            tree[:, width : 2 * width] = np.minimum(level[:, ::2], level[:, 1::2])
        tree = tree.ravel()

        def update(base: np.ndarray, pos: np.ndarray, value: np.ndarray) -> None:
            node = pos + size
            tree[base + node] = value
            while size > 1:
                node = node >> 1
                child = base + 2 * node
                tree[base + node] = np.minimum(tree[child], tree[child + 1])
                if node[0] == 1:
                    return

        live = rows
        while len(live):
            root = tree[live * 2 * size + 1]
            live, root = live[root < _NONE], root[root < _NONE]
            if not len(live):
                break
            base, line = live * 2 * size, live * (size + 1)
            p = root % size
            q = after[line + p]
            new = self.merged[root // size]
            sym[line + p], sym[line + q] = new, -1
            nxt, prv = after[line + q], before[line + p]
            after[line + p] = nxt
            some = nxt < size
            before[(line + nxt)[some]] = p[some]
            update(base, q, np.full(len(live), _NONE))
            r = self.rank(new, sym[line + nxt])
            update(base, p, np.where(r < _NONE, r * size + p, _NONE))
            some = prv < size
            if some.any():
                b, left = base[some], prv[some]
                r = self.rank(sym[line[some] + left], new[some])
                update(b, left, np.where(r < _NONE, r * size + left, _NONE))
        sym = sym.reshape(n, -1)[:, :-1]
        alive = sym >= 0
        return sym[alive], alive.sum(1)

    def single(self, piece: bytes) -> np.ndarray:
        """The same tree for one long piece."""
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        sym = self.inner[np.frombuffer(piece, np.uint8)].tolist()
        sym[-1] = int(self.final[piece[-1]])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = int(_NONE)
        leaf = lambda i, j: r[0] * size + i if (r := self.rule.get((sym[i], sym[j]))) else none
        tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = leaf(i, i + 1)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def update(pos: int, value: int) -> None:
            k = pos + size
            tree[k] = value
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        while tree[1] < none:
            p = tree[1] % size
            q = after[p]
            sym[p] = self.rule[sym[p], sym[q]][1]
            sym[q] = -1
            nxt = after[p] = after[q]
            update(q, none)
            if nxt < n:
                before[nxt] = p
            update(p, leaf(p, nxt) if nxt < n else none)
            if before[p] >= 0:
                update(before[p], leaf(before[p], p))
        return np.array([s for s in sym if s >= 0])

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in the order of the pieces, and each piece's number of ids."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts, done = np.zeros(len(pieces), np.int64), []
        size, low = 4, 0
        while size <= LOCKSTEP:
            of = np.flatnonzero((lengths > low) & (lengths <= size))
            for k in range(0, len(of), 50_000):
                part = of[k : k + 50_000]
                ids, counts[part] = self.lockstep([pieces[i] for i in part.tolist()], size)
                done.append((part, ids))
            low, size = size, 2 * size
        for i in np.flatnonzero(lengths > LOCKSTEP).tolist():
            ids = self.single(pieces[i])
            counts[i] = len(ids)
            done.append((np.array([i]), ids))
        starts = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        for part, ids in done:
            n = counts[part]
            inside = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(starts[part], n) + inside] = ids
        return out, counts

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in order, and each unit's number of ids."""
        todo: list[bytes] = []
        ends, special = [], []
        for unit in units:
            if unit.isascii() and unit.isalpha():
                todo.append(unit.lower().encode())
            else:
                for piece in self.pieces(unit):
                    if isinstance(piece, int):
                        special.append((len(todo), piece))
                        piece = b"x"  # holds the place
                    todo.append(piece)
            ends.append(len(todo))
        ids, counts = self.encode_pieces(todo)
        first = np.concatenate(([0], np.cumsum(counts)))
        for at, name in special:
            ids[first[at]] = name
        return ids, np.diff(first[np.array([0, *ends])])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Texts of runs of ids, each token followed by a blank; and their byte bounds."""
        size = self.name_size[ids]
        ends = np.concatenate(([0], np.cumsum(size)))[bounds]
        return self.name_bytes[spread(self.name_start[ids], size)].tobytes(), ends


def vocabulary(source: str) -> Vocabulary:
    key = hashlib.sha1(source.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Vocabulary(source)
    return _loaded[key]


def _run(source, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(source.value)
        for batch in batches:
            for i, j, data, bounds in vectext.text_blocks(batch.column(1)):
                ids, at = v.memo.texts(data, bounds)
                text, ends = v.decode(ids, at)
                raw = memoryview(ids.astype("<u4").tobytes())
                runs = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                # A text's last token has no blank after it.
                parts = [(a, max(a, b - 1)) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                view = memoryview(text)
                columns = {"doc_id": batch.column(0).slice(i, j - i), "n_tokens": pa.array(np.diff(at))}
                if with_ids:
                    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                    columns |= {"ids": lists, "decoded": pa.array([text[a:b].decode() for a, b in parts], pa.string())}
                columns |= {
                    "ids_sha256": pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in runs], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in parts], pa.string()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return run


def encode_decode(documents: DataFrame, vocabulary_path: str, with_ids: bool = True) -> DataFrame:
    """Token ids of each text, and the text decoded from them.

    ``doc_id, n_tokens, [ids, decoded,] ids_sha256, decoded_sha256``, one row for each
    row of ``documents``.  ``vocabulary_path`` is read on the driver (a fixed couple of
    megabytes) and sent to the workers.  No special token is added; those written out
    in a text become their ids.  Decoding joins the tokens with spaces, as a
    vocabulary without a decoder does.  A null text counts as empty: no ids, empty
    decoded text.  Null, repeated or negative ``doc_id`` are carried through; other
    columns are ignored.  One pass, no shuffle.
    """
    ship(documents.sparkSession)
    with open(vocabulary_path, encoding="utf-8") as file:
        source = documents.sparkSession.sparkContext.broadcast(file.read())
    schema = "doc_id long, n_tokens long, " + "ids array<int>, decoded string, " * with_ids
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(worker(_run(source, with_ids)), schema + "ids_sha256 string, decoded_sha256 string")
