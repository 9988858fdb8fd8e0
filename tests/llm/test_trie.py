import hashlib
import random
import zlib

import pytest

from paceline.llm import catalog, trie

from .helpers import same_as_sql

SCHEMA = "conv_id long, turn long, role string, text string, path string, node int, n_convs string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "x") for r in rows], SCHEMA).repartition(3)


def plain(rows):
    """Nodes by the definition, from whole sequences."""
    own = {}
    name = lambda r: hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, name(r))):
        if r[0] is not None:
            own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    whole = {}
    for c, turns in own.items():
        base, h = (abs(c) - abs(c) % 20) * (1 if c >= 0 else -1), zlib.crc32(str(c).encode()) % 4
        whole[c] = (*own.get(base, [])[:h], *turns[h:])
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    kids, leaves, saved = ({p: 0 for p in nodes} for _ in range(3))
    for p in sorted(nodes, key=len, reverse=True):
        if p:
            kids[p[:-1]] += 1
        leaves[p] += kids[p] == 0
        words = len(p[-1][1].split()) if p else 0
        saved[p] += (len(nodes[p]) - 1) * words
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return {
        (min(m), len(p)): (
            min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if whole[c] == p).encode()).hexdigest(),
        )
        for p, m in nodes.items()
    }


def found(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): tuple(r[c] for c in trie.COLUMNS if c not in ("conv_id", "depth")) for r in rows}
    assert len(out) == len(rows)
    return out


def random_rows(seed, convs=120, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 400), convs):
        stem = rng.randrange(4)
        for t in range(rng.randrange(1, longest)):
            text = f"stem {stem} {t}" if rng.random() < 0.8 else f"own {c} {t}"
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None]), rng.choice([text, text, None])))
    return rows


@pytest.mark.parametrize("width", [512, 1, 3])
def test_against_definition(spark, width, monkeypatch):
    rows = random_rows(width)
    rows += [(None, 1, "user", "lost"), (400, None, None, None), (401, 1, "user", "x"), (401, 1, "user", "x"), (401, 1, "a", "\t\n")]
    assert found(trie.prefix_trie(conversations(spark, rows), width)) == plain(rows)


def test_blocks_and_copies(spark, monkeypatch):
    """Small blocks: copies and shared prefixes go over many of them."""
    rows = [(20 * c, t, "user", f"same turn {t}") for c in range(60) for t in range(6)]
    rows += [(20 * c, t, "user", f"same turn {t}" if t < 3 else f"own {c} {t}") for c in range(60, 90) for t in range(5)]
    df = conversations(spark, rows)
    monkeypatch.setattr(trie, "BLOCK", 20)
    for width in (512, 2):
        assert found(trie.prefix_trie(df, width)) == plain(rows)


def test_turnless_and_empty(spark):
    turnless = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(turnless, 1, "user", "dropped"), (turnless + 20, 1, "user", "dropped too")]
    assert found(trie.prefix_trie(conversations(spark, rows))) == plain(rows)
    assert trie.prefix_trie(conversations(spark, rows).where("false")).count() == 0


def test_long_conversations(spark):
    rows = [(c, t, "user", f"t{t}" if t < 900 or c == 40 else f"x{t}") for c in (20, 40) for t in range(1300)]
    assert found(trie.prefix_trie(conversations(spark, rows))) == plain(rows)


def test_node_layouts():
    """Nodes grow through all four layouts, split paths, and give children in byte order."""
    rng = random.Random(6)
    keys = {bytes([b, *[7] * 15]) for b in range(0, 256, 1)} | {bytes([3] * 15 + [b]) for b in range(20)}
    keys |= {k + bytes([rng.randrange(256)] * 16) for k in rng.sample(sorted(keys), 30)}
    for size in (3, 5, 17, 49, len(keys)):
        some = rng.sample(sorted(keys), size)
        root = trie.Node(b"", None, None)
        for k in some:
            trie.insert(root, trie.Run(k, [], None))
        out, todo = [], [root]
        while todo:
            node = todo.pop()
            out += [node.run.key] if node.run else []
            todo += reversed(node.children.all()) if node.children else ()
        assert sorted(out) == sorted(some)
        if all(len(k) == 16 for k in some):
            assert out == sorted(some)
    assert isinstance(root.children, trie.Direct)


def test_query_matches_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, "op13_conversation_trie")


def test_registered():
    assert "op13_conversation_trie" in catalog.SQL
