import hashlib
import random

from paceline.llm import suffixes

from .helpers import TEXTS, collected, documents, same_as_sql, sentences


def brute(rows, length=100):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        b = (t or "").encode()
        keep = bytearray(b"\1" * len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                keep[p : p + length] = bytes(length)
            seen.add(w)
        kept = bytes(x for x, f in zip(b, keep, strict=True) if f)
        spans = sum(1 for j in range(len(b)) if not keep[j] and (j == 0 or keep[j - 1]))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, **options):
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in collected(suffixes.repeated_spans(documents(spark, rows), **options))]
    order = lambda r: (r[0] is not None, r[0] or 0, r)
    assert sorted(got, key=order) == sorted(brute(rows, options.get("length", 100)), key=order)


def test_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, "op10_suffix_dedup")


def test_edges(spark):
    rows = [r for r in TEXTS if r[1] is None or len(r[1]) < 1000]
    check(spark, [*rows, (30, "x" * 1000), (31, "x" * 101), (32, "é" * 80), (33, "aé" * 70), (34, "x" * 99), (35, "x" * 100)])


def test_passages_at_all_offsets(spark):
    rng, rows, passages = random.Random(5), [], [sentences(s, 40) for s in range(4)]
    for i in range(160):
        parts = [sentences(1000 + i, rng.randrange(20))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(60)
            parts += [p[a : a + rng.randrange(90, 220)], sentences(rng.randrange(10**6), rng.randrange(6))]
        rows.append((rng.randrange(10**6), " ".join(parts)))
    check(spark, rows)


def test_few_symbols_and_another_length(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab") for _ in range(60)) * rng.randrange(1, 5)) for i in range(60)]
    check(spark, rows, length=64)


def test_carried_columns_and_text(spark):
    rows = [(1, "é" * 120), (2, "a" + "é" * 120), (3, None)]
    df = suffixes.repeated_spans(documents(spark, rows), with_text=True, carry=["lang", "source"])
    got = {r["doc_id"]: r for r in df.collect()}
    assert [got[i]["lang"] for i in (1, 2, 3)] == ["en", None, "en"]
    assert got[2]["kept"] == "a" and got[3]["kept"] == ""


def test_cover_is_a_difference_cover():
    differences = {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER}
    assert differences == set(range(suffixes.PERIOD))


def test_empty(spark):
    assert suffixes.repeated_spans(documents(spark, [])).count() == 0
