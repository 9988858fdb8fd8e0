import hashlib
import re

from paceline.llm import decontam

from .helpers import TEXTS, collected, documents, same_as_sql, sentences


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, window=13):
    w, hit, found = words(text), set(), set()
    for item, passage in items:
        v = words(passage)
        n = min(window, len(v))
        for p in range(len(v) - n + 1) if v and item is not None else ():
            for q in range(len(w) - n + 1):
                if w[q : q + n] == v[p : p + n]:
                    hit.update(range(q, q + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


PASSAGE = sentences(1, 30)
ITEMS = [(1, PASSAGE), (1, PASSAGE), (2, sentences(2, 13)), (3, "Word"), (4, None), (5, ""), (6, "--- ..."), (None, sentences(3, 14)), (10, PASSAGE.upper()), (7, "same same same same same same same same same same same same same same")]
DOCS = [
    *TEXTS[:7], (20, PASSAGE), (21, "x " * 200 + PASSAGE + " y" * 2000), (22, sentences(2, 13) + "é"),
    (23, sentences(2, 13).replace(" ", "--")), (24, "same " * 30), (25, PASSAGE[:100] + " zz " + PASSAGE[100:]), (26, sentences(3, 14)),
]


def check(spark):
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    out = collected(decontam.contamination(documents(spark, DOCS), benchmark))
    want = sorted([(i, *brute(t, ITEMS)) for i, t in DOCS], key=lambda r: (r[0], str(r)))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out]
    return sorted(got, key=lambda r: (r[0], str(r))), want, out


def test_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, "op6_decontamination")


def test_edges(spark):
    got, want, out = check(spark)
    assert got == want
    assert next(r for r in out if r["doc_id"] == 21)["spans"] == [(200, 230)]


def test_blocks_of_windows(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 8)
    got, want, _ = check(spark)
    assert got == want


def test_blocks_keep_rows_of_one_id_apart(spark, monkeypatch):
    """Several blocks return what one block does, for repeated and null ids too."""
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 8)
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    clean = sentences(9, 30)
    rows = [(i, t) for i in (1, None) for t in (PASSAGE, clean, clean)]
    want = sorted((str(i), *brute(t, ITEMS)) for i, t in rows)

    out = collected(decontam.contamination(documents(spark, rows), benchmark))
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in out) == want


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(documents(spark, []), none).count() == 0
    out = decontam.contamination(documents(spark), none).collect()
    assert len(out) == len(TEXTS) and not any(r["n_hit"] or r["contaminated"] for r in out)
