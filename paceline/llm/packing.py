"""Best-fit packing of token sequences, improved by exchanges between underfull bins.

Every text is encoded once and cut into pieces; pieces are written with a number of
their own.  Packing then works on numbers and lengths alone: pieces are dealt by hash
into groups of bounded size, a group is packed best fit, longest first, and its
underfull bins are improved by local search.  A step moves a document to another bin,
or exchanges one for one or two for one, always so that the sum of squared fills
grows: full bins get fuller, the emptiest ones empty, and an empty bin is gone.  Some
of each group's emptiest bins are dealt into larger unions of groups, level by level,
so that what is left over in many groups is put together as well.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import materialize
from .bpe import byte_alphabet
from .shipping import ship, worker

GROUP = 20_000  # pieces packed together by one task
FAN = 16  # groups whose emptiest bins are improved together on the next level
CARRIED = 48  # emptiest bins that a group hands to the next level
SCANNED = 256  # bins looked at for an exchange of one document
_PART_BITS = 33
_PLACED = "uid long, length int, bin long, offset long, open boolean"
# How byte-level vocabularies of this kind split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Texts with other characters, special tokens or very long runs go through the library.
_ODD = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-ſ]")
_LONG = 100_000  # characters from which on a text's runs are looked at
_loaded: dict[str, ByteEncoder] = {}


class ByteEncoder:
    """Ids of whole texts as the tokenizers library gives them.

    A byte-level vocabulary whose ids follow its merges is also loaded as ranks, which
    encode plain texts several times faster; all other texts take the library itself.
    """

    def __init__(self, source: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.ranks = self._ranks(json.loads(source))

    @staticmethod
    def _ranks(spec: dict):
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if model.get("type", "BPE") != "BPE" or not plain or spec.get("normalizer") or model.get("ignore_merges"):
            return None
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")):
            return None
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        special = {t["content"] for t in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [model["vocab"].get(a + b, -1) for a, b in merges]
        if made != sorted(set(made)) or (made and made[0] < 256):
            return None
        import tiktoken

        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _odd(self, text: str) -> bool:
        if self.ranks is None or "<|" in text or _ODD.search(text):
            return True
        return len(text) > _LONG and re.search(r"\S{400}|\s{400}", text) is not None

    def encode(self, texts: list[str]) -> list[list[int]]:
        odd = [self._odd(t) for t in texts]
        out = [[] if o else self.ranks.encode_ordinary(t) for t, o in zip(texts, odd, strict=True)]
        rest = [i for i, o in enumerate(odd) if o]
        for i, e in zip(rest, self.library.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out


def _cut(source, end: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.sha1(source.value.encode()).hexdigest()
        if key not in _loaded:
            _loaded[key] = ByteEncoder(source.value)
        uid = TaskContext.get().partitionId() << _PART_BITS
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, ids_of = [], []
                encoded = _loaded[key].encode([t or "" for t in part.column(1).to_pylist()])
                for doc, ids in zip(part.column(0).to_pylist(), encoded, strict=True):
                    ids = np.array([*ids, end], "<u4")
                    first = (len(ids) - 1) % capacity + 1
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        rows.append((uid, doc, n, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                        uid += 1
                        if with_ids:
                            ids_of.append(ids[a:b].astype(np.int32))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids_of, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


class Bins:
    """Bins of one group: documents, fills, and the underfull ones by their room."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.length, self.capacity = lengths, capacity
        self.held: list[list[int]] = []
        self.fill: list[int] = []
        self.by_room: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self.rooms = 0  # bit r: some bin has room r

    def _list(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if room and self.fill[b]:
            self.by_room[room][b] = None
            self.rooms |= 1 << room

    def _unlist(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if b in self.by_room[room]:
            del self.by_room[room][b]
            if not self.by_room[room]:
                self.rooms &= ~(1 << room)

    def open(self, docs: list[int]) -> int:
        self.held.append(list(docs))
        self.fill.append(sum(self.length[d] for d in docs))
        self._list(len(self.fill) - 1)
        return len(self.fill) - 1

    def swap(self, a: int, out: list[int], b: int, back: list[int]) -> None:
        """Documents ``out`` of bin ``a`` go to ``b``, ``back`` comes from there."""
        self._unlist(a)
        self._unlist(b)
        for d in out:
            self.held[a].remove(d)
        for d in back:
            self.held[b].remove(d)
        self.held[a] += back
        self.held[b] += out
        grown = sum(self.length[d] for d in out) - sum(self.length[d] for d in back)
        self.fill[a] -= grown
        self.fill[b] += grown
        self._list(a)
        self._list(b)

    def tightest(self, need: int, but: int = -1) -> int:
        """The bin with the least room of at least ``need``, or -1."""
        rest = self.rooms >> need
        while rest:
            room = need + (rest & -rest).bit_length() - 1
            for b in self.by_room[room]:
                if b != but:
                    return b
            rest = (self.rooms >> (room + 1)) << (room + 1 - need)
        return -1

    def best_fit(self) -> None:
        for d in sorted(range(len(self.length)), key=lambda d: (-self.length[d], d)):
            b = self.tightest(self.length[d])
            if b < 0:
                self.open([d])
            else:
                self._unlist(b)
                self.held[b].append(d)
                self.fill[b] += self.length[d]
                self._list(b)

    def _roomy(self, but: int) -> Iterator[int]:
        """Underfull bins, those with most room first."""
        rest, seen = self.rooms, 0
        while rest:
            room = rest.bit_length() - 1
            rest ^= 1 << room
            for b in self.by_room[room]:
                if b != but:
                    yield b
                    seen += 1
                    if seen == SCANNED:
                        return

    def _exchange(self, a: int) -> tuple[int, list[int], int, list[int]] | None:
        """The exchange of bin ``a``'s documents that raises the squared fill most."""
        size, best, found = self.length, 0, None
        mine = sorted(self.held[a], key=lambda d: -size[d])[:32]
        pairs = [(x, y) for i, x in enumerate(mine[:8]) for y in mine[i + 1 : 8]]
        give = [([x], size[x]) for x in mine] + [([x, y], size[x] + size[y]) for x, y in pairs]
        for b in self._roomy(a):
            room, ahead = self.capacity - self.fill[b], self.fill[b] - self.fill[a]
            theirs = sorted(self.held[b], key=lambda d: -size[d])[:16]
            take = [([y], size[y]) for y in theirs]
            take += [([x, y], size[x] + size[y]) for i, x in enumerate(theirs[:6]) for y in theirs[i + 1 : 6]]
            for out, more in give:
                for back, less in take:
                    grown = more - less
                    if 0 < grown <= room and len(out) + len(back) < 4:
                        gain = 2 * grown * (ahead + grown)
                        if gain > best:
                            best, found = gain, (a, out, b, back)
        return found

    def improve(self, steps: int) -> None:
        """Empty the emptiest bins while fewer bins could hold all documents."""
        bound = -(-sum(self.fill) // self.capacity)
        live = sum(map(bool, self.fill))
        heap = [(f, b) for b, f in enumerate(self.fill) if 0 < f < self.capacity]
        heapq.heapify(heap)
        while heap and live > bound and steps > 0:
            f, a = heapq.heappop(heap)
            if self.fill[a] != f:
                continue
            changed = []
            for d in sorted(self.held[a], key=lambda d: -self.length[d]):
                b = self.tightest(self.length[d], a)
                if b >= 0 and self.fill[b] + self.length[d] > self.fill[a]:
                    self.swap(a, [d], b, [])
                    changed.append(b)
            if not changed:
                found = self._exchange(a)
                if found:
                    self.swap(*found)
                    changed.append(found[2])
            steps -= 1
            if changed and self.fill[a] == 0:
                live -= 1
            elif changed:
                changed.append(a)
            for b in changed:
                if 0 < self.fill[b] < self.capacity:
                    heapq.heappush(heap, (self.fill[b], b))


def pack_group(lengths: list[int], bins: list[list[int]] | None, capacity: int) -> Bins:
    """Pack one group: best fit unless ``bins`` are given, then local search."""
    out = Bins(lengths, capacity)
    if bins is None:
        out.best_fit()
    else:
        for docs in bins:
            out.open(docs)
    out.improve(4 * len(out.fill) + 100)
    return out


def _level(capacity: int, carried: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        uid, length = table.column("uid").to_pylist(), table.column("length").to_pylist()
        given: dict[int, list[int]] = {}
        for i, b in enumerate(table.column("bin").to_pylist()):
            if b is not None:
                given.setdefault(b, []).append(i)
        packed = pack_group(length, list(given.values()) or None, capacity)
        live = [b for b, f in enumerate(packed.fill) if f]
        underfull = [(packed.fill[b], b) for b in live if packed.fill[b] < capacity]
        open_bins = {b for _, b in heapq.nsmallest(carried, underfull)}
        rows = []
        for b in live:
            docs = sorted(packed.held[b])
            offset, name = 0, uid[docs[0]]
            for d in docs:
                rows.append((uid[d], length[d], name, offset, b in open_bins))
                offset += length[d]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.Table.from_arrays(columns, names=["uid", "length", "bin", "offset", "open"])

    return run


def pack_lengths(pieces: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """``uid, sequence_id, offset`` for pieces (``uid``: unique, ``length``: 1 to ``capacity``).

    ``sequence_id`` is the smallest ``uid`` in the sequence.  Full pieces are sequences
    of their own.  The others are dealt by hash of ``uid`` into groups of about ``group``
    pieces; each level writes its table, and only the emptiest bins of a group, a bounded
    number, are dealt again.  No pieces: no rows.
    """
    full = pieces.where(F.col("length") == capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity).select("uid", F.col("length").cast("int").alias("length"), F.lit(None).cast("long").alias("bin"))
    groups, out, key = max(1, math.ceil(rest.count() / group)), full, "uid"
    while True:
        dealt = rest.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups)))
        kept = CARRIED if groups > 1 else 0
        level = materialize(dealt.groupBy("_group").applyInArrow(_level(capacity, kept), _PLACED), "packed")
        out = out.union(level.where("NOT open").select("uid", F.col("bin").alias("sequence_id"), "offset"))
        if groups == 1:
            return out
        groups, key = math.ceil(groups / FAN), "bin"
        rest = level.where("open").select("uid", "length", "bin")


def pack(
    documents: DataFrame, vocabulary_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """Pack the ids of all texts into sequences of at most ``capacity`` tokens.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``
    (and ``ids`` with ``with_ids``).  A document's tokens are its text's ids and
    ``end_id``; longer ones than ``capacity`` are cut into full pieces but for the first.
    A null text counts as empty: one piece of the end id alone.  Rows that repeat a
    ``doc_id``, null included, are documents of their own; other columns are ignored; an
    empty table gives no rows.  The text is read once and never shuffled.
    """
    spark = documents.sparkSession
    ship(spark)
    with open(vocabulary_path, encoding="utf-8") as file:
        source = spark.sparkContext.broadcast(file.read())
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "uid long, doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = materialize(rows.mapInArrow(worker(_cut(source, end_id, capacity, with_ids)), schema), "pieces")
    placed = pack_lengths(pieces, capacity)
    return pieces.join(placed, "uid").drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids`` of rows packed ``with_ids``; at most one sequence a row."""
    whole = packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_parts"), F.sum("length").alias("n_tokens")
    )
    return whole.select("sequence_id", "n_tokens", F.flatten(F.transform("_parts", lambda p: p["ids"])).alias("ids"))
