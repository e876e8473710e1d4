import math
from fractions import Fraction

import numpy as np
import pytest

from skein.llm import topk


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, queries, k=5):
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, x in ok:
        if q in queries:
            s = sorted((-int(x @ y), i) for i, y in ok if i != q and len(y) == len(x))[:k]
            out |= {(q, r + 1, i, -v) for r, (v, i) in enumerate(s)}
    return out


@pytest.mark.parametrize("seed,dim,n", [(0, 16, 300), (1, 64, 120), (2, 3, 500), (3, 1, 40), (4, 8, 4)])
def test_against_brute_force(spark, monkeypatch, seed, dim, n):
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, dim)) * (r.random((n, dim)) < 0.5)
    v[n // 2 :] = v[r.integers(0, 3, n - n // 2)]  # many copies
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(n)]
    df = vectors(spark, rows)
    got = {(x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df, df.filter("vec_id % 10 = 0")).collect()}
    assert got == brute(rows, {i for i in range(0, n, 10)})


def test_unfit_vectors_take_no_part(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 1.0], None), (2, None, 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [], 1), (7, [1.0], 1), (8, [-1.0, 0.5], 1), (None, [1.0, 1.0], 1)]
    df = vectors(spark, rows).selectExpr("*", "1 AS dim", "2 AS block")
    got = {(x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df, df.filter("vec_id IN (0, 2, 4, 7)")).collect()}
    assert got == brute(rows, {0, 2, 4, 7})
    assert topk.top_k(vectors(spark, []), vectors(spark, [])).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(0, [1e12, 3.0], 0), (1, [1e12, 1.0], 0), (2, [-1e12, 5.0], 0), (3, [7.0, 1.0], 0)]
    want = [[int(np.floor(256 * np.float64(np.float32(x)))) for x in v] for _, v, _ in rows]
    small = [(i, v, s) for i, v, s in rows if i != 9]
    v = topk.whole_numbers(np.array([x for _, x, _ in small], np.float32).astype(np.float64))
    assert [[int(a) for a in x] for x in v] == want
    s = topk.Shard(np.arange(4), v)
    assert s.search(v[3], 3, 2) == sorted(((sum(a * b for a, b in zip(want[3], want[i])), i) for i in range(3)), key=lambda x: (-x[0], x[1]))[:2]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_large_components_through_top_k(spark, kind):
    top = 3e38 if kind == "float" else 1.7e308
    rows = [(0, [1e12, 3.0], 0), (1, [1e12, 1.0], 0), (2, [-1e12, 5.0], 0), (3, [7.0, 1.0], 0), (4, [1e30, 0.0], 0), (5, [top, -top], 0), (6, [1e6 + 0.5, 2.0], 0)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    whole = {i: [math.floor(Fraction(float(np.float32(x)) if kind == "float" else x) * 256) for x in v] for i, v, _ in rows}
    want = set()
    for q in whole:
        s = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole[q], whole[i])))), i) for i in whole if i != q]
        want |= {(q, n + 1, i, s) for n, (s, i) in enumerate(sorted(s, key=lambda x: (-x[0], x[1]))[:3])}
    assert {(x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df, df, 3).collect()} == want


def test_empty_vectors_and_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 8)
    monkeypatch.setattr(topk, "QUERY_BYTES", 100)
    rows = [(0, [], 1), (1, [], 1), (2, [1.0], 1)] + [(7, [1.0], 1)] * 40 + [(i, [float(i)], 1) for i in range(10, 20)]
    df = vectors(spark, rows)
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df, df.filter("vec_id IN (0, 2, 7)"), 2).collect())
    assert got == [(0, 1, 1, 0), (2, 1, 19, 256 * 256 * 19), (2, 2, 18, 256 * 256 * 18), (7, 1, 19, 256 * 256 * 19), (7, 2, 18, 256 * 256 * 18)]
