import random
import re

from paceline.llm import minhash
from paceline.llm.components import components

from .helpers import collected, documents, same_as_sql, sentences


def brute(rows, k, percent):
    def items(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}

    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = items(t)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, rows, k=4):
    out = collected(minhash.near_duplicates(documents(spark, rows), shingle=k))
    assert len(out) == len(rows)
    want = brute(rows, k, 80)
    for r in out:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
        else:
            assert r["kept"]


def test_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, "op1_minhash_forest")


def test_edges(spark):
    from .helpers import TEXTS

    check(spark, TEXTS)


def test_empty(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_large_group_of_near_copies(spark):
    """More copies than a region holds, each with edits of its own, and chains of edits."""
    rng, base = random.Random(4), sentences(1, 120).split()
    rows = [(1000 + i, sentences(100 + i, 60)) for i in range(40)]
    for i in range(200):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    for i in range(12):  # each is close to the next one only
        base[i * 8] = f"chain{i}"
        rows.append((300 + i, " ".join(base)))
    check(spark, rows)


def test_star_larger_than_a_region(spark):
    """Copies that are close to the original, but not to each other."""
    rng, base = random.Random(5), sentences(1, 200).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 3001):
        w = list(base)
        for k in range(4):  # four edits a copy, 16 of 197 shingles
            w[20 + 45 * k + rng.randrange(30)] = f"edit{i}x{k}"
        rows.append((i, " ".join(w)))
    a, b = brute(rows[:2], 4, 80), brute(rows[1:3], 4, 80)
    assert a[1][1] == 0 and b[2][1] == 2  # a copy links to the original, two copies do not
    out = collected(minhash.near_duplicates(documents(spark, rows), shingle=4))
    assert [r["doc_id"] for r in out if r["component_id"] != 0] == []


def test_pairs_tried_in_a_group_of_unlinked_rows(spark, monkeypatch):
    """Rows alike enough to be candidates but not linked: pairs are not tried one row each."""
    rng, base = random.Random(6), sentences(1, 200).split()
    rows = []
    for i in range(400):
        w = list(base)
        for k in range(5):  # five edits a row, 20 of 197 shingles
            w[5 + 39 * k + rng.randrange(30)] = f"edit{i}x{k}"
        rows.append((i, " ".join(w)))
    rows.append((400, rows[399][1] + " end"))
    tried, write = [], minhash.materialize

    def counted(df, name):
        out = write(df, name)
        if name == "confirmed":
            tried.append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    check(spark, rows)
    assert sum(tried) < minhash.REGION * len(rows)


def test_rounds_without_a_link_leave_components(spark, monkeypatch):
    rows = []
    for i in range(6):
        rows += [(2 * i, sentences(30 + i, 60)), (2 * i + 1, sentences(30 + i, 60) + " end")]
    calls, real = [], minhash.components
    monkeypatch.setattr(minhash, "components", lambda edges: calls.append(1) or real(edges))
    check(spark, rows)
    assert len(calls) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 100), (7, 7), (300, 100)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 200: 100, 300: 100}


def test_texts_of_one_id(spark):
    """Texts that share an id share their links, whichever text is looked at."""
    a, b, c = (sentences(s, 60).split() for s in (21, 22, 23))
    near = lambda w: " ".join(w[:-1] + ["other"])
    rows = [(1, " ".join(a)), (2, near(a)), (1, " ".join(b)), (4, near(b)), (5, " ".join(c)), (3, near(c)), (3, near(b)), (9, "alone"), (9, "")]
    out = collected(minhash.near_duplicates(documents(spark, rows), shingle=4))
    assert [(r["doc_id"], r["component_id"]) for r in out] == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (4, 1), (5, 1), (9, 9), (9, 9)]
    rows = [(8, " ".join(a)), (8, " ".join(a)), (8, " ".join(b)), (7, near(a)), (6, near(b))]
    out = collected(minhash.near_duplicates(documents(spark, rows), shingle=4))
    assert {r["component_id"] for r in out} == {6} and [r["kept"] for r in out] == [True, False, False, False, False]
