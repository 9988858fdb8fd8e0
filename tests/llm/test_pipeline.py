import hashlib
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from paceline.llm import decontam

from .helpers import EXTRA, documents, sentences
from .test_decontam import brute as windows
from .test_minhash import brute as groups


def cut(rows):
    seen, out = set(), []
    for i, t in sorted(rows):
        b = t.encode()
        keep = np.ones(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                keep[p : p + 100] = False
            seen.add(b[p : p + 100])
        out.append((i, np.frombuffer(b, np.uint8)[keep].tobytes().decode(errors="ignore")))
    return out


def test_stages_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    root = groups(rows, 5, 80)
    rows = cut([r for r in rows if root[r[0]][1] == r[0]])
    flat = " ".join(t for _, t in items)
    rows = [r for r in rows if not windows(r[1], items)[4]] if flat else rows
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def test_stages_take_odd_rows(spark, sf_dir):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        if name != "encoding":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(rows, out.schema)
        for c in EXTRA[:3]:
            docs = docs.selectExpr("*", f"1 AS {c}") if c not in docs.columns else docs
    ids = [r["doc_id"] for r in rows]
    assert 4 in ids and 9 in ids and 1 not in ids and 10 not in ids


def test_stages_take_empty_tables(spark, sf_dir):
    docs = documents(spark, [], extra=False)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_rows_of_one_id_are_judged_alone(spark, sf_dir, monkeypatch):
    """Repeated and null ids: a row goes or stays for its own text, one row stays of a group."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 200").first()["text"]
    clean, none = sentences(7, 40), "..."
    left = lambda stage, rows: sorted(map(str, ((r["doc_id"], r["text"]) for r in stage(spark, documents(spark, rows), sf_dir).collect())))
    rows = [(i, t) for i in (1, None) for t in (clean, none)]
    good = sorted(map(str, [(1, clean), (None, clean)]))
    assert left(corpus_pipeline.language_id, rows) == good
    rows = [(i, t) for i in (1, None) for t in (clean, item)]
    assert left(corpus_pipeline.decontamination, rows) == good
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 40)
    assert left(corpus_pipeline.decontamination, rows) == good
    rows = [(1, clean), (1, clean), (2, clean), (3, item), (None, clean), (None, clean), (1, " ")]
    want = [(1, clean), (3, item), (None, clean), (None, clean), (1, " ")]
    assert left(corpus_pipeline.near_duplicates, rows) == sorted(map(str, want))


def test_texts_without_labels_stay(spark, sf_dir):
    docs = spark.createDataFrame([(1, "a clean text", None, None, None), (2, "..", None, None, None)], documents(spark, [], extra=False).schema)
    out = corpus_pipeline.language_id(spark, docs, sf_dir).collect()
    assert [r["doc_id"] for r in out] == [1]


