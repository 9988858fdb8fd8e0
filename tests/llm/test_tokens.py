import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from paceline.llm import bpe, tokenfile, vectext

from .helpers import TEXTS, collected, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Vocabulary(file.read())


def random_texts():
    rng = random.Random(2)
    kinds = [lambda: rng.randrange(32, 127), lambda: rng.randrange(0xA0, 0x250), lambda: rng.randrange(0x250, 0xD800), lambda: rng.randrange(0xE000, 0x20000)]
    texts = ["".join(chr(rng.choice(kinds)()) for _ in range(25)) for _ in range(1500)]
    return texts + [t or "" for _, t in TEXTS] + ["a" * 300, "ab" * 4000, "<|ENDOFTEXT|> a<|endoftext|>b", "É×÷é İ ſ"]


def test_units_and_trees_match_the_library(library, vocabulary):
    with open(PATH, encoding="utf-8") as file:
        encoder = tokenfile.Encoder(file.read())
    texts = random_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for memo in (vocabulary.memo, encoder.memo):
        for _ in range(2):  # from the encoder, then from the memo
            got = []
            for _, _, data, bounds in vectext.text_blocks(pa.array(texts)):
                ids, at = memo.texts(data, bounds)
                got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
            assert got == want


def test_long_and_short_pieces_agree(vocabulary):
    """The tree of one piece and the trees side by side merge alike."""
    rng = random.Random(3)
    pieces = ["".join(rng.choice("theinaro") for _ in range(rng.randrange(1, 64))).encode() for _ in range(300)]
    ids, counts = vocabulary.encode_pieces(pieces)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert all(p.tolist() == vocabulary.single(x).tolist() for p, x in zip(parts, pieces, strict=True))


def test_encode_decode_rows(spark, library):
    out = collected(bpe.encode_decode(documents(spark), PATH))
    assert len(out) == len(TEXTS)
    want = sorted(
        ((i, *_digests(library, t or "")) for i, t in TEXTS), key=lambda r: (r[0] is not None, r[0] or 0, r[1:])
    )
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out]
    assert sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, r[1:])) == want
    for r in out:
        assert library.decode(r["ids"], skip_special_tokens=False) == r["decoded"]


def _digests(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    plain = library.decode(ids, skip_special_tokens=False)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(plain.encode())


def test_token_file_round_trip(spark, library, tmp_path):
    tokenfile.write_tokens(documents(spark), f"{tmp_path}/t", PATH)
    rows = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(tuple(r) for r in tokenfile.digests(tokenfile.read_tokens(spark, f"{tmp_path}/t")).collect() if r["doc_id"] is not None)
    assert got == sorted(w for w in want if w[0] is not None)
    some = tokenfile.read_tokens(spark, f"{tmp_path}/t", [4, 9]).collect()
    assert {(r["doc_id"], r["start"], r["n_tokens"]) for r in some} == {w[:3] for w in want if w[0] in (4, 9)}
    plan = tokenfile.read_tokens(spark, f"{tmp_path}/t", [4]).select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_empty(spark, tmp_path):
    assert bpe.encode_decode(documents(spark, []), PATH).count() == 0
    tokenfile.write_tokens(documents(spark, []), f"{tmp_path}/t", PATH)
    assert tokenfile.read_tokens(spark, f"{tmp_path}/t").count() == 0
