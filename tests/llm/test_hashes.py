"""Words of repeating structure must not be taken for one another."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from paceline.llm import bpe, decontam, minhash, quality, suffixes, tokenfile, vectext

from .helpers import collected, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def doubling(n, a="a", b="b"):
    """The sequence of n letters that doubles itself with its letters exchanged, and its other half."""
    one, other = a, b
    while len(one) < n:
        one, other = one + other, other + one
    return one, other


PAIRS = [doubling(n) for n in (8, 16, 64, 128, 1024, 2048, 4096)]


def test_spans_and_windows():
    words = [w for pair in PAIRS for w in pair]
    words += [w[:-1] + c for w in words for c in "ab"] + ["a" * n for n in range(1, 200)]
    words = sorted(set(words))
    data, bounds = vectext.flatten(pa.array(words))
    h = vectext.span_hash(data, bounds[:-1], bounds[1:])
    assert len(set(h.tolist())) == len(words)
    for size in (8, 9, 44, 64, 100, 128):
        text = np.frombuffer("".join(words).encode(), np.uint8)
        at = np.arange(len(text) - size + 1)
        names = vectext.window_hash(text, at, size)
        raw = text.tobytes()
        by_text = {}
        for i, name in zip(at.tolist(), names.tolist(), strict=True):
            assert by_text.setdefault(raw[i : i + size], name) == name
        assert len(set(by_text.values())) == len(by_text)


def test_operators_tell_them_apart(spark):
    for one, other in PAIRS[3:]:
        rows = [(1, f"{one} x y z"), (2, f"{other} x y z")]
        df = documents(spark, rows).coalesce(1)
        near = collected(minhash.near_duplicates(df, shingle=4))
        assert [r["component_id"] for r in near] == [1, 2]
        items = spark.createDataFrame([(7, one)], "item_id long, text string")
        assert [r["n_hit"] for r in collected(decontam.contamination(df, items))] == [1, 0]
        library = Tokenizer.from_file(PATH)
        want = [library.encode(t, add_special_tokens=False).ids for _, t in rows]
        assert [r["ids"] for r in collected(bpe.encode_decode(df, PATH))] == want


def test_token_files(spark, tmp_path):
    one, other = PAIRS[4]
    tokenfile.write_tokens(documents(spark, [(1, one), (2, other)]).coalesce(1), f"{tmp_path}/t", PATH)
    library = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: r["ids"] for r in tokenfile.read_tokens(spark, f"{tmp_path}/t").collect()}
    assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in ((1, one), (2, other))}


def test_removed_bytes(spark):
    one, other = PAIRS[4]
    out = collected(suffixes.repeated_spans(documents(spark, [(1, one), (2, other)])))
    seen, want = set(), []
    for text in (one, other):
        keep = [True] * len(text)
        for p in range(len(text) - 99):
            if text[p : p + 100] in seen:
                keep[p : p + 100] = [False] * 100
            seen.add(text[p : p + 100])
        want.append(hashlib.sha256("".join(c for c, k in zip(text, keep, strict=True) if k).encode()).hexdigest())
    assert [r["kept_sha256"] for r in out] == want


def test_quality_features_end_with_their_text():
    """A text has the same features whatever its neighbours are."""
    rng = random.Random(1)
    texts = ["", "a", "ab", "abc", "a b", "the the cat", "x" * 70] + ["".join(rng.choice("ab \n") for _ in range(rng.randrange(9))) for _ in range(60)]

    def features(some):
        data, bounds = vectext.flatten(pa.array(some))
        kinds = list(quality._features(data, bounds))
        return [tuple(tuple(f[b[d] : b[d + 1]].tolist()) for f, b in kinds) for d in range(len(some))]

    alone = {t: features([t])[0] for t in texts}
    for _ in range(20):
        rng.shuffle(texts)
        assert features(texts) == [alone[t] for t in texts]


def test_quality_features_by_loops():
    text = "the cat the  cat sat"
    data, bounds = vectext.flatten(pa.array([text]))
    words, pairs, repeats, threes, fours = (f[b[0] : b[1]] for f, b in quality._features(data, bounds))
    own = text.split()
    assert len(words) == 5 and len(pairs) == 4 and words[0] == words[2] and words[1] == words[3] and pairs[0] == pairs[2]
    assert repeats.tolist() == [next(k for k in range(1, 9) if own[i] == own[i - k]) for i in range(5) if own[i] in own[:i]]
    raw = text.encode()
    for n, found, salt in ((3, threes, 1), (4, fours, 1 << 40)):
        grams = [int.from_bytes(raw[i : i + n], "little") for i in range(len(raw) - n + 1)]
        assert found.tolist() == [((g + salt) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - quality.BITS) for g in grams]
