"""Trained operators: held-out accuracy, and what they do with odd rows."""

import random
import zlib

import pytest

from paceline.llm import langid, quality, toxicity

from .helpers import TEXTS, documents

SYLLABLES = {"en": "the and ing ed sh th er".split(), "fr": "eau ou ez é que les".split(), "de": "sch ung ß ei der ver".split()}
INSULTS = ["moronic", "scumbag", "stupid", "vequtas"]


def prose(rng, lang="en", n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."


def held(i, parts, part):
    return zlib.crc32(str(i).encode()) % parts == part


@pytest.fixture(scope="module")
def toxic():
    rng, rows, labels = random.Random(1), [], []
    for i in range(700):
        text, bad = prose(rng, rng.choice(list(SYLLABLES))), i % 4 == 0
        if bad:
            w = text.split()
            word = rng.choice(INSULTS)
            if i % 8 == 0:  # with a sign put in
                k = rng.randrange(2, 5)
                word = word[:k] + rng.choice("-.*") + word[k:]
            w.insert(rng.randrange(len(w)), word)
            text = " ".join(w)
        rows.append((i, text))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark, toxic):
    rows, labels = toxic
    known = spark.createDataFrame([(i, 1, y, "x") for i, y in labels], "doc_id long, quality int, toxic int, text string")
    out = {r["doc_id"]: r for r in toxicity.toxicity(documents(spark, rows), known).collect()}
    test = [(i, y) for i, y in labels if held(i, 5, 0)]
    assert all(out[i]["held_out"] == held(i, 5, 0) for i, _ in labels)
    assert sum(out[i]["predicted"] == y for i, y in test) / len(test) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())


def test_toxicity_looks_at_whole_texts(spark, toxic):
    rows, labels = toxic
    known = spark.createDataFrame([(i, y) for i, y in labels], "doc_id long, toxic int")
    rng = random.Random(2)
    clean = " ".join(prose(rng) for _ in range(400))
    more = [(10_000, clean), (10_001, clean + " st-upid moronic.")]
    out = {r["doc_id"]: r["score"] for r in toxicity.toxicity(documents(spark, rows + more), known).collect()}
    assert out[10_001] > 0.5 > out[10_000]


def test_quality_held_out(spark):
    rng, rows, labels = random.Random(3), [], []
    for i in range(500):
        text = prose(rng, rng.choice(list(SYLLABLES)))
        if i % 3 == 0:
            text = text.upper().replace(" ", "!! ") if i % 2 else " ".join(w for w in text.split()[:8] for _ in range(8))
        rows.append((i, text))
        labels.append((i, int(i % 3 != 0)))
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.quality(documents(spark, rows), known).collect()}
    test = [(i, y) for i, y in labels if held(i, 3, 1)]
    assert all(out[i]["held_out"] == held(i, 3, 1) for i, _ in labels)
    assert sum(out[i]["predicted"] == y for i, y in test) / len(test) > 0.95


def test_language_held_out(spark):
    rng, rows = random.Random(4), []
    for i in range(400):
        lang = list(SYLLABLES)[i % 3]
        rows.append((i, prose(rng, lang, rng.randrange(20, 300)), lang, "s", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in langid.identify(df).collect()}
    test = [r for r in rows if held(r[0], 5, 0)]
    assert sum(out[r[0]]["lang_pred"] == r[2] for r in test) / len(test) > 0.95


def test_odd_rows(spark):
    df = documents(spark)
    found = langid.identify(df).collect()
    assert len(found) == len(TEXTS)
    for r in found:
        if r["doc_id"] in (1, 2, 3, -3, 10):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    known = spark.createDataFrame([(5, 1, 1), (5, 1, 1), (6, 0, 0), (7, None, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    for op in (quality.quality, toxicity.toxicity):
        out = op(df, known).collect()
        assert len(out) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in out)
        assert all(r["held_out"] for r in out if r["doc_id"] is None)


@pytest.mark.parametrize("op", [quality.quality, toxicity.toxicity])
def test_nothing_to_learn_from(spark, op):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len({r["score"] for r in op(documents(spark), none).collect()}) == 1
    assert op(documents(spark, []), none).count() == 0
    assert langid.identify(documents(spark, [])).count() == 0
