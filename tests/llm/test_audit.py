import random
import re
from itertools import permutations

import numpy as np

from paceline.llm import audit

from .helpers import TEXTS, documents, same_as_sql


def plain(rows, labels):
    """The audit by its definition, one document after another."""
    first, out = {}, {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    fails = []
    for doc_id, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc_id is not None and doc_id > first[t],
        }
        known = [(q, x) for i, q, x in labels if i is not None and i == doc_id]
        fails.append((lang or "", bad, any(q == 1 for q, _ in known), any(x == 1 for _, x in known)))
    for part in {f[0] for f in fails}:
        mine, taken = [f for f in fails if f[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                lost = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                taken[f] += len(lost)
                unique = sum(x[1][f] and sum(x[1].values()) == 1 for x in mine)
                redundant = sum(x[1][f] for x in mine) - len(lost)
                out[part, "".join(order), step] = [len(left), len(lost), redundant, unique, sum(x[2] for x in lost), sum(x[3] for x in lost), f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = taken[row[-1]]
    return out


def audited(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in df.collect()}


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, n string, good string")


def test_edges(spark):
    labels = [(4, 1, 0, "x", "y"), (4, 0, 1, "x", "y"), (5, 1, None, "x", "y"), (None, 1, 1, "x", "y"), (99, 1, 1, "x", "y")]
    got = audited(audit.filter_audit(documents(spark), labelled(spark, labels)))
    rows = [(i, t, "en" if i and i % 2 else None) for i, t in TEXTS]
    assert got == plain(rows, [x[:3] for x in labels])
    empty = documents(spark).where("false")
    assert audit.filter_audit(empty, labelled(spark, labels)).count() == 0


def test_many_records_of_one_id(spark):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(150)] + ["ABCDE", "#"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([5, 120, 400]))) for _ in range(60)]
    rows = [(rng.choice([7, 7, 7, i, None]), rng.choice([t, texts[0]])) for i, t in enumerate(texts * 4)]
    got = audited(audit.filter_audit(documents(spark, rows, extra=False), labelled(spark, [(7, 1, 1, "", "")])))
    assert got == plain([(i, t, "en" if i and i % 2 else None) for i, t in rows], [(7, 1, 1)])


def test_galloping():
    rng = np.random.default_rng(5)
    for sizes in ((0, 5), (5, 0), (1, 1000), (1000, 1), (3000, 3000), (70, 20000)):
        a, b, c = (np.unique(rng.integers(0, 30000, n)).astype(np.int32) for n in (*sizes, 500))
        assert (audit.gallop(a, b) == np.searchsorted(a, b)).all()
        assert audit.union([a, b, c]).tolist() == sorted({*a.tolist(), *b.tolist(), *c.tolist()})
        assert audit.difference(a, b).tolist() == sorted({*a.tolist()} - {*b.tolist()})
        assert audit.common(a, b).tolist() == sorted({*a.tolist()} & {*b.tolist()})
    assert audit.union([]).tolist() == []


def test_query_matches_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, "op12_filter_audit")
