import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from paceline.llm import catalog, packing

from .helpers import TEXTS, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(rows, ids_of, capacity):
    """Pieces give back every document, and sequences are gapless and within capacity."""
    docs, bins = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    want = sorted(
        (doc, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
        for doc, ids in ids_of
        for cuts in [[0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]]
        for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
    )
    assert sorted((-(10**9) if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    return len(bins)


@pytest.mark.parametrize("capacity", [2048, 16])
def test_pieces_and_places(spark, library, capacity):
    rows = packing.pack(documents(spark), PATH, capacity).collect()
    ids = [(d if d is not None else -10**9, library.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in TEXTS]
    n = check(rows, ids, capacity)
    assert n <= -(-sum(len(x) for _, x in ids) // capacity) + 1


def test_encoder_matches_the_library(library):
    with open(PATH, encoding="utf-8") as file:
        encoder = packing.ByteEncoder(file.read())
    assert encoder.ranks is not None
    rng = random.Random(1)
    letters = [*map(chr, range(32, 127)), *"\t\n\r  éèçüß×÷ñſĀ"]
    texts = ["".join(rng.choice(letters) for _ in range(80)) for _ in range(3000)] + [t or "" for _, t in TEXTS]
    texts += [f"a{c}b {c} {c}{c}  {c}1'{c}s" for c in map(chr, range(1, 0x250))]
    texts += ["a" * 5000, " " * 5000 + "x", "ab " * 40_000, "ab" * 60_000, " \n" * 60_000 + "x", "<|endoftext|>", "'S'll I'LL", "日本 ½² x", "x­x"]
    assert encoder.encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_search_empties_bins():
    """Exchanges get below best fit where it is far from the bound, and lose nothing."""
    for seed, low, high, most in ((1, 300, 1200, 0.5), (2, 600, 900, 0.95), (3, 500, 1100, 0.8)):
        rng = random.Random(seed)
        lengths = [rng.randrange(low, high) for _ in range(1500)]
        first = packing.Bins(lengths, 2048)
        first.best_fit()
        squares, before = sum(f * f for f in first.fill), len(first.fill)
        bound = -(-sum(lengths) // 2048)
        first.improve(10_000)
        after = sum(map(bool, first.fill))
        assert sum(f * f for f in first.fill) > squares and after - bound <= most * (before - bound)
        assert sorted(d for h in first.held for d in h) == list(range(1500))
        assert all(sum(lengths[d] for d in h) == f <= 2048 for h, f in zip(first.held, first.fill, strict=True))


def test_levels(spark):
    """Bins of many groups are put together level by level; no piece is lost."""
    rng = random.Random(4)
    lengths = [rng.choice([64, rng.randrange(1, 64), rng.randrange(20, 40)]) for _ in range(4000)]
    pieces = spark.createDataFrame([(i << 20, n) for i, n in enumerate(lengths)], "uid long, length int")
    rows = packing.pack_lengths(pieces, capacity=64, group=150).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], lengths[r["uid"] >> 20]))
    assert sorted(r["uid"] >> 20 for r in rows) == list(range(4000))
    for places in bins.values():
        ends = [0]
        for offset, n in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + n)
        assert ends[-1] <= 64
    assert len(bins) <= 1.01 * sum(lengths) / 64 + 1


def test_sequences_and_query(spark, sf_dir, library):
    packed = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), PATH, with_ids=True)
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    assert all(len(r["ids"]) == r["n_tokens"] <= 2048 for r in whole.values())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids_of = [(d, library.encode(t, add_special_tokens=False).ids + [0]) for d, t in texts.items()]
    by_doc = dict(ids_of)
    for r in packed.collect():
        want = by_doc[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == want == whole[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]]
    rows = catalog.QUERIES["op11_best_fit_packing"](spark, sf_dir).collect()
    n = check(rows, ids_of, 2048)
    assert n <= -(-sum(len(x) for _, x in ids_of) // 2048) + 1


def test_empty(spark):
    assert packing.pack(documents(spark).where("false"), PATH).count() == 0
