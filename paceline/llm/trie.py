"""Prefix trie of conversations: adaptive radix trees over fixed-width turn ids.

A turn's id is the first 16 bytes of the SHA-256 of its role and text; a conversation's
key is its ids one after another.  Keys are range-sorted with their conversation's id, so
any number of copies spreads over tasks.  Each block of sorted keys is put into a radix
tree whose nodes grow from 4 to 16, 48 and 256 children and swallow unbranched paths;
only byte depths at whole turns emit trie nodes.  A node all of whose members lie in its
block is finished there.  Those on the path of a block's first or last key may go on in
its neighbours: they are emitted as parts, a few per block, and put together by Spark.

Keys are cut into slabs of ``SLAB`` turns, so that no task holds a long conversation
whole.  A slab shared by several conversations is a tree of its own, below the slab
before; a slab of one conversation alone needs no tree.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import ordered_index
from ..plans.skew import spread_join
from ..plans.tables import materialize
from .shipping import ship, worker

WIDTH = 16
SLAB = 512  # turns
BLOCK = 100_000  # turns put into one radix tree
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_BELOW = ["b_children", "b_leaves", "b_saved", "b_ends"]
_NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, parent binary, prefix string, path array<binary>, words long, "
    "ends string, block long, b_children long, b_leaves long, b_saved long, b_ends string"
)
_ARROW = [
    (c.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}[c.split()[1]])
    for c in _NODE.split(", ")
]
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


class Listed:
    """Up to 4, then up to 16 children: sorted bytes beside their nodes."""

    def __init__(self, room: int = 4) -> None:
        self.room, self.bytes, self.nodes = room, bytearray(), []

    def get(self, byte: int) -> Node | None:
        at = self.bytes.find(byte)
        return self.nodes[at] if at >= 0 else None

    def put(self, byte: int, node: Node) -> Listed | Indexed:
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.bytes) == self.room:
            grown = Listed(16) if self.room == 4 else Indexed()
            for b, n in zip(self.bytes, self.nodes, strict=True):
                grown = grown.put(b, n)
            return grown.put(byte, node)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def all(self) -> list[Node]:
        return self.nodes


class Indexed:
    """Up to 48 children: a byte's entry is its node's place, from 1."""

    def __init__(self) -> None:
        self.places, self.nodes = bytearray(256), []

    def get(self, byte: int) -> Node | None:
        return self.nodes[self.places[byte] - 1] if self.places[byte] else None

    def put(self, byte: int, node: Node) -> Indexed | Direct:
        if self.places[byte]:
            self.nodes[self.places[byte] - 1] = node
            return self
        if len(self.nodes) == 48:
            grown = Direct()
            for b in range(256):
                if self.places[b]:
                    grown.put(b, self.nodes[self.places[b] - 1])
            return grown.put(byte, node)
        self.nodes.append(node)
        self.places[byte] = len(self.nodes)
        return self

    def all(self) -> list[Node]:
        return [self.nodes[p - 1] for p in self.places if p]


class Direct:
    """Up to 256 children, one place for each byte."""

    def __init__(self) -> None:
        self.nodes: list[Node | None] = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> Direct:
        self.nodes[byte] = node
        return self

    def all(self) -> list[Node]:
        return [n for n in self.nodes if n is not None]


class Run:
    """Conversations of one block that have the same key in this slab."""

    __slots__ = ("key", "words", "ids", "below")

    def __init__(self, key: bytes, words: list[int], below: tuple | None) -> None:
        self.key, self.words, self.ids, self.below = key, words, [], below


class Node:
    """A path of bytes after the parent's branch, and what hangs below its end."""

    __slots__ = ("path", "children", "run", "some")

    def __init__(self, path: bytes, run: Run | None, some: Run) -> None:
        self.path, self.children, self.run, self.some = path, None, run, some

    def put(self, byte: int, node: Node) -> None:
        self.children = (self.children or Listed()).put(byte, node)


def _shared(a: bytes, b: bytes, at: int) -> int:
    """How many bytes of ``a`` also follow in ``b`` from ``at``."""
    if b.startswith(a, at):
        return len(a)
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) >> 1
        if b.startswith(a[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


def insert(root: Node, run: Run) -> None:
    """Put a key into the tree; a path that it leaves midway is split there."""
    node, above, at, key = root, None, 0, run.key
    while True:
        n = _shared(node.path, key, at)
        if n < len(node.path):
            top = Node(node.path[:n], None, node.some)
            top.put(node.path[n], node)
            node.path = node.path[n + 1 :]
            above[0].put(above[1], top)
            node = top
        at += n
        if at == len(key):
            node.run = run
            return
        child = node.children.get(key[at]) if node.children else None
        if child is None:
            node.put(key[at], Node(key[at + 1 :], run, run))
            return
        above, node, at = (node, key[at]), child, at + 1


def _path_ids(prefix: str, key: bytes) -> list[bytes]:
    """A name for each whole-turn prefix of a key, the empty one included."""
    state = hashlib.sha256(f"{prefix}:".encode())
    out = [state.digest()[:WIDTH]]
    for at in range(0, len(key), WIDTH):
        state.update(key[at : at + WIDTH])
        out.append(state.copy().digest()[:WIDTH])
    return out


class Block:
    """Trie nodes of one group of keys within one block, as rows."""

    def __init__(self, prefix: str, runs: list[Run], number: int) -> None:
        self.prefix, self.number, self.rows = prefix, number, []
        self.edges = [(r.key, _path_ids(prefix, r.key)) for r in {id(r): r for r in (runs[0], runs[-1])}.values()]
        root = Node(b"", None, runs[0])
        for run in runs:
            insert(root, run)
        self._emit(root)

    def _open(self, key: bytes, depth: int) -> list[bytes] | None:
        """Names down to this node if it may have members in other blocks."""
        for edge, names in self.edges:
            if edge.startswith(key[: depth * WIDTH]) and len(edge) >= depth * WIDTH:
                return names[: depth + 1]
        return None

    def _emit(self, root: Node) -> None:
        # Children before parents; an entry is a node and its byte depths.
        order, todo = [], [(root, 0, 0)]
        while todo:
            node, first, _ = entry = todo.pop()
            end = first + len(node.path)
            order.append((node, first, end))
            if node.children:
                todo += [(child, end + 1, 0) for child in node.children.all()]
        found: dict[int, list] = {}  # per node: members, smallest, finished tops, leaves, saved
        for node, first, end in reversed(order):
            members, least, tops, leaves, saved = 0, None, [], 0, 0
            for child in node.children.all() if node.children else ():
                m, c, t, x, s = found.pop(id(child))
                members, leaves, saved = members + m, leaves + x, saved + s
                least = c if least is None else min(least, c)
                tops, t = (tops, t) if len(tops) >= len(t) else (t, tops)
                tops.extend(t)
            if node.run:
                members += len(node.run.ids)
                least = node.run.ids[0] if least is None else min(least, node.run.ids[0])
            state = [members, least, tops, leaves, saved]
            for depth in range(end // WIDTH, (first + WIDTH - 1) // WIDTH - 1, -1):
                self._row(node, depth, state, node.run if depth * WIDTH == end else None)
            found[id(node)] = state

    def _row(self, node: Node, depth: int, state: list, run: Run | None) -> None:
        members, least, tops, leaves, saved = state
        key, words = node.some.key, node.some.words[depth - 1] if depth else 0
        below = run.below if run else None
        names = self._open(key, depth)
        if names:
            for row in tops:
                self.rows[row][8] = names[-1]
            text = ",".join(map(str, run.ids)) if run and not below else None
            self.rows.append(
                [least, depth, None, members, len(tops), leaves, saved, None, None, self.prefix, names, words, text,
                 self.number, *(below or (0, 0, 0, None))]
            )
            state[2:] = [], 0, 0
            return
        for row in tops:
            self.rows[row][2] = least
        n_children, ends = len(tops), _NO_ENDS
        if below:
            n_children, ends = below[0], below[3]
            leaves, saved = below[1], below[2]
        elif run:
            ends = hashlib.sha256(",".join(map(str, run.ids)).encode()).hexdigest()
        leaves, saved = leaves or 1, saved + (members - 1) * words
        self.rows.append([least, depth, None, members, n_children, leaves, saved, ends, *[None] * 10])
        state[2:] = [len(self.rows) - 1], leaves, saved


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, held, turns = TaskContext.get().partitionId() << 33, [], 0

    def rows() -> Iterator[pa.RecordBatch]:
        groups: dict[str, list[Run]] = {}
        for prefix, key, words, conv, below in held:
            runs = groups.setdefault(prefix, [])
            if not runs or runs[-1].key != key:
                runs.append(Run(key, words, below))
            runs[-1].ids.append(conv)
        for prefix, runs in groups.items():
            out = Block(prefix, runs, number).rows
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), _ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[c for c, _ in _ARROW])

    for batch in batches:
        for row in batch.to_pylist():
            below = tuple(row[c] for c in _BELOW) if row["b_leaves"] is not None else None
            held.append((row["prefix"], b"".join(row["ids"]), row["words"], row["conv_id"], below))
            turns += len(row["ids"]) + 1
            if turns >= BLOCK:
                yield from rows()
                number, held, turns = number + 1, [], 0
    if held:
        yield from rows()


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, one after another, without joining them."""
    name, state = None, None
    for batch in batches:
        done = []
        for node, text in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if node != name:
                if state is not None:
                    done.append((name, state.hexdigest()))
                name, state = node, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        yield pa.RecordBatch.from_pydict(
            {"node": pa.array([n for n, _ in done], pa.binary()), "hashed": pa.array([h for _, h in done], pa.string())}
        )
    if state is not None:
        yield pa.RecordBatch.from_pydict({"node": pa.array([name], pa.binary()), "hashed": [state.hexdigest()]})


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, id, words, total``: rebuilt turns, numbered from 1; turnless ones have ``pos`` 0."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.substring(F.unhex(F.sha2(named, 256)), 1, WIDTH).alias("id"),
        F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long").alias("words"),
    )
    numbered = ordered_index(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("id")], "pos").drop("turn")
    numbered = materialize(numbered, "turns")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    base = F.col("conv_id") - F.col("conv_id") % 20
    convs = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    bases = convs.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.withColumns({"head": head, "base": base}).join(bases, "base", "left")
    used = F.least("head", F.coalesce("base_n", F.lit(0)))
    convs = convs.withColumn("used", used).withColumn("total", F.col("used") + F.greatest(F.col("n") - F.col("head"), F.lit(0)))
    convs = materialize(convs.select("conv_id", "base", "head", "used", "total"), "conversations")
    own = spread_join(numbered.where(F.col("pos") > head), convs.select("conv_id", "head", "used", "total"), ["conv_id"], F.col("pos"))
    own = own.select("conv_id", (F.col("pos") - F.col("head") + F.col("used")).alias("pos"), "id", "words", "total")
    first = numbered.where("conv_id % 20 = 0 AND pos < 4").withColumnRenamed("conv_id", "base")
    first = first.join(convs, "base").where("pos <= head").select("conv_id", "pos", "id", "words", "total")
    none = convs.where("total = 0").select(
        "conv_id", F.lit(0).cast("long"), F.lit(None).cast("binary"), F.lit(0).cast("long"), "total"
    )
    return own.union(first).union(none)


def _slabs(turns: DataFrame, width: int) -> DataFrame:
    """``conv_id, slab, ids, words, total``; one more, empty, where turns end with a slab."""
    slab = F.when(F.col("pos") > 0, F.floor((F.col("pos") - 1) / width)).otherwise(0).cast("long")
    some = F.when(F.col("pos") > 0, F.struct("pos", "id", "words"))
    slabs = turns.groupBy("conv_id", slab.alias("slab")).agg(F.sort_array(F.collect_list(some)).alias("t"), F.max("total").alias("total"))
    slabs = slabs.select("conv_id", "slab", F.col("t.id").alias("ids"), F.col("t.words").alias("words"), "total")
    ended = slabs.where((F.size("ids") == width) & (F.col("total") == (F.col("slab") + 1) * width))
    empty = ended.select("conv_id", F.col("slab") + 1, F.slice("ids", 1, 0), F.slice("words", 1, 0), "total")
    return slabs.union(empty)


def _prefixes(slabs: DataFrame, width: int) -> DataFrame:
    """Name what comes before each slab: sums of 60-bit digests of the slabs and their places."""
    long = slabs.where(F.col("total") >= width)
    hexed = F.sha2(F.concat(F.col("slab").cast("string"), F.array_join(F.transform("ids", F.hex), ",")), 256)
    part = lambda at: F.conv(F.substring(hexed, at, 15), 16, 10).cast("decimal(38,0)")
    earlier = Window.partitionBy("conv_id").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.sum(part(at)).over(earlier).cast("string") for at in (1, 16)]
    names = long.select("conv_id", "slab", F.concat(F.lit("s"), F.col("slab").cast("string"), F.lit("-"), sums[0], F.lit("-"), sums[1]).alias("prefix"))
    return names.where("slab > 0")


def _tree(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the groups ``prefix``, and their roots as what hangs below the slab before."""
    order = ["prefix", "ids", "conv_id"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = materialize(ordered.mapInArrow(worker(_grow), _NODE), "nodes")
    node, parent = F.element_at("path", -1), F.try_element_at("path", F.lit(-2))
    # Parts of nodes that several blocks may share: two paths a block at most.
    parts = found.where("path IS NOT NULL").withColumn("node", node)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    same = [F.max(c).alias(c) for c in ("prefix", "depth", "words", "path", *_BELOW)]
    merged = materialize(parts.groupBy("node").agg(F.min("conv_id").alias("conv_id"), *sums, *same), "parts")
    kin = merged.select(parent.alias("node")).where("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("kin"))
    children = F.col("n_children") + F.coalesce("kin", F.lit(0)) + F.col("b_children")
    own = merged.join(kin, "node", "left").withColumn("n_children", children)
    no_child = F.when((F.col("n_children") == 0) & (F.col("b_leaves") == 0), 1).otherwise(0)
    own = own.withColumns(
        {
            "own_leaves": F.col("n_leaves") + F.col("b_leaves") + no_child,
            "own_saved": F.col("saved_tokens") + F.col("b_saved") + (F.col("n_convs") - 1) * F.col("words"),
        }
    )
    totals = own.select(F.explode("path").alias("node"), "own_leaves", "own_saved").groupBy("node")
    totals = totals.agg(F.sum("own_leaves").alias("n_leaves"), F.sum("own_saved").alias("saved_tokens"))
    pieces = parts.where("ends IS NOT NULL").select("node", "block", "ends")
    pieces = pieces.repartition("node").sortWithinPartitions("node", "block")
    ends = pieces.mapInArrow(worker(_hash_ends), "node binary, hashed string")
    ends_sha = F.coalesce("b_ends", "hashed", F.lit(_NO_ENDS)).alias("ends_sha256")
    whole = own.drop("n_leaves", "saved_tokens").join(totals, "node").join(ends, "node", "left")
    whole = whole.select("node", parent.alias("parent"), "prefix", *[c for c in COLUMNS if c not in ("parent_conv_id", "ends_sha256")], ends_sha)
    whole = materialize(whole, "shared")
    named = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("_parent"))
    inner = found.where("path IS NULL").join(named, "parent", "left")
    inner = inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent")).select(*COLUMNS)
    outer = whole.join(named, "parent", "left").withColumnRenamed("_parent", "parent_conv_id").select(*COLUMNS)
    roots = whole.where("depth = 0").select(
        "prefix", F.col("n_children").alias("b_children"), F.col("n_leaves").alias("b_leaves"),
        F.col("saved_tokens").alias("b_saved"), F.col("ends_sha256").alias("b_ends"),
    )
    return inner.union(outer), roots


def _alone(slabs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of slabs that one conversation has for itself, and what hangs below the slab before."""
    sha = F.sha2(F.col("conv_id").cast("string"), 256)
    lit = lambda v: F.lit(v).cast("long")
    first = F.col("slab") * width
    depths = F.explode(F.sequence(first + 1, first + F.size("ids"))).alias("depth")
    nodes = slabs.where(F.size("ids") > 0).select("conv_id", "total", depths).select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), lit(1).alias("n_convs"),
        (F.col("depth") < F.col("total")).cast("long").alias("n_children"), lit(1).alias("n_leaves"), lit(0).alias("saved_tokens"),
        F.when(F.col("depth") == F.col("total"), sha).otherwise(F.lit(_NO_ENDS)).alias("ends_sha256"),
    )
    below = slabs.select(
        "conv_id", "slab", (F.col("total") > first).cast("long").alias("b_children"), lit(1).alias("b_leaves"),
        lit(0).alias("b_saved"), F.when(F.col("total") == first, sha).otherwise(F.lit(_NO_ENDS)).alias("b_ends"),
    )
    return nodes, below


def prefix_trie(conversations: DataFrame, width: int = SLAB) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, the root included.

    Turns are ordered by ``turn``, null first, equal ones by the SHA-256 of role and
    text.  Null role or text counts as empty.  Rows without ``conv_id`` belong to no
    conversation and are left out; other columns are ignored; an empty table has no
    members and gives no rows.  ``width`` is the number of turns of a slab: rounds grow
    with the slabs that conversations share, not with the longest conversation.
    """
    ship(conversations.sparkSession)
    slabs = materialize(_slabs(rebuilt(conversations), width), "slabs")
    longest = slabs.agg(F.max("total").alias("m")).first()["m"]
    if longest is None:
        return slabs.select(*[F.lit(None).cast("string" if "sha" in c else "long").alias(c) for c in COLUMNS])
    first = slabs.where("slab = 0").withColumn("prefix", F.lit(""))
    lower = [F.lit(None).cast("string" if c == "b_ends" else "long").alias(c) for c in _BELOW]
    if longest < width:
        return _tree(first.select("prefix", "ids", "conv_id", "words", *lower))[0]
    names = materialize(_prefixes(slabs, width), "prefixes")
    sizes = names.groupBy("prefix").agg(F.count(F.lit(1)).alias("members"), F.max("slab").alias("slab"))
    many = materialize(sizes.where("members > 1").select("prefix", "slab"), "many")
    deepest = many.agg(F.max("slab").alias("m")).first()["m"] or 0
    later = slabs.join(names, ["conv_id", "slab"])
    nodes, below = _alone(later.join(many.select("prefix"), "prefix", "left_anti"), width)
    shared = materialize(later.join(many.select("prefix"), "prefix", "left_semi"), "later")
    under = below
    for slab in range(deepest, -1, -1):
        rows = first if slab == 0 else shared.where(F.col("slab") == slab)
        lower = under.where(F.col("slab") == slab + 1).drop("slab")
        tree, roots = _tree(rows.join(lower, "conv_id", "left").select("prefix", "ids", "conv_id", "words", *_BELOW))
        if slab:
            tree = tree.where("depth > 0").withColumn("depth", F.col("depth") + slab * width)
            mine = shared.where(F.col("slab") == slab).select("conv_id", "slab", "prefix").join(roots, "prefix").drop("prefix")
            under = materialize(below.where(F.col("slab") == slab).unionByName(mine), "under")
        nodes = nodes.union(tree)
    return nodes
