import numpy as np

from paceline.llm import vectors

from .helpers import collected, same_as_sql

SCHEMA = "vec_id long, embedding array<float>, label int, unit string, cells int, links int, rep int"


def brute(rows, cosine=0.98):
    ok = [(i, e, k) for i, e, k in rows if i is not None and k is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    n, root = {}, {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, (i, a, k) in enumerate(ok):
        for j, b, m in ok[p + 1 :]:
            if k == m and len(a) == len(b):
                u, v = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= cosine:
                    n[i], n[j] = n.get(i, 0) + 1, n.get(j, 0) + 1
                    r, s = sorted((find(i), find(j)))
                    root[s] = r
    return {i: (n.get(i, 0), find(i)) for i, *_ in rows}


def check(spark, rows):
    df = spark.createDataFrame([(i, e, k, "x", 1, 2, 3) for i, e, k in rows], SCHEMA)
    out = collected(vectors.near_vectors(df), "vec_id")
    want = brute([r for r in rows if r[0] is not None])
    assert len(out) == len(rows)
    for r in out:
        if r["vec_id"] is None:
            assert r["n_links"] == 0 and r["kept"]
        else:
            assert (r["n_links"], r["component_id"]) == want[r["vec_id"]]


def test_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, "op9_vector_near_dedup")


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0, 0.0], 1),
        (9, [1.0, None, 3.0], 1), (10, [float("nan"), 2.0, 3.0], 1), (11, [float("inf"), 2.0, 3.0], 1), (12, [1.0, 2.0], 1),
        (13, [-1.0, -2.0, -3.0], 1), (None, v, 1), (14, [1e-30, 2e-30, 3e-30], 1), (15, [1e30, 2e30, 3e30], 1),
    ]
    check(spark, rows)


def test_clusters_around_the_limit(spark):
    rng, rows = np.random.default_rng(8), []
    for c in range(12):
        centre = rng.normal(size=32)
        for k in range(40):
            v = centre + rng.normal(size=32) * rng.choice([0.02, 0.1, 0.14, 0.2])
            rows.append((c * 40 + k, [float(x) for x in v.astype(np.float32)], c % 3))
    check(spark, rows)


def test_blocks(spark, monkeypatch):
    """A cell dealt in many blocks gives the same links."""
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in (np.ones(16) + rng.normal(size=16) * 0.15).astype(np.float32)], 1) for i in range(120)]
    check(spark, rows)


def test_count_is_calibrated():
    """At the cosine limit, the chance to miss the needed count is what was asked for."""
    from math import comb, erf, sqrt

    chance = erf(vectors.WIDTH / sqrt(2))
    need = vectors.collisions_needed(chance, vectors.PROJECTIONS, vectors.MISS)
    miss = sum(comb(16, k) * chance**k * (1 - chance) ** (16 - k) for k in range(need))
    assert miss <= vectors.MISS < miss + comb(16, need) * chance**need * (1 - chance) ** (16 - need)


def test_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
