import numpy as np
import pytest

from skein.llm import embed


def brute(rows):
    ok = {}
    for n, (i, v, label) in enumerate(rows):
        if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float32).astype(np.float64)
            ok[n] = (a / np.sqrt(a @ a), label)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in ok:
        for q in ok:
            if p != q and ok[p][1] == ok[q][1] and len(ok[p][0]) == len(ok[q][0]) and ok[p][0] @ ok[q][0] >= 0.93:
                links[p] += 1
                a, b = sorted((find(p), find(q)))
                root[b] = a
    least = {}
    for n, (i, _, _) in enumerate(rows):
        least[find(n)] = min(least.get(find(n), 1 << 62), i if i is not None else 1 << 62)
    return sorted((i if i is not None else -1, links[n], least[find(n)] if least[find(n)] < 1 << 62 else -1) for n, (i, _, _) in enumerate(rows))


def result(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "2 AS copies")
    out = embed.near_vectors(df).collect()
    assert all(x.kept == (x.vec_id is not None and x.vec_id == x.component_id) for x in out)
    return sorted((x.vec_id if x.vec_id is not None else -1, x.n_links, x.component_id if x.component_id is not None else -1) for x in out)


@pytest.mark.parametrize("tile", [1024, 16])
def test_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embed, "TILE_ROWS", tile)
    monkeypatch.setattr(embed, "WINDOW", 12)
    r = np.random.default_rng(3)
    centers = r.normal(size=(12, 24))
    v = [c + r.normal(size=24) * s for c in centers for s in [0.02] * 12 + [0.25] * 8] + list(r.normal(size=(100, 24)))
    v += [v[0]] * 60  # a large group of copies
    rows = [(int(i), [float(x) for x in a], int(i) % 2 if i < 240 and i % 20 > 15 else 1) for i, a in zip(r.permutation(len(v)), v)]
    want, got = brute(rows), result(spark, rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert found <= there and found >= 0.9 * there
    assert sum(a == b for a, b in zip(got, want)) >= 0.95 * len(want)


def test_unfit_vectors_link_with_nothing(spark):
    rows = [(5, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [1.0, None], 1), (9, [float("nan"), 1.0], 1), (10, [1.0, 0.0], 2), (None, [1.0, 0.01], 1), (11, [1.0], 1), (12, [], 1), (5, [1.0, 0.0], 1)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, [(None, [1.0], 1), (None, [1.0], 1)]) == [(-1, 1, -1), (-1, 1, -1)]
    assert embed.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("shared", [0.0, 0.7])
def test_recall_in_a_large_label(spark, monkeypatch, shared):
    """Isolated pairs just at the threshold among vectors of one label that have a direction in common."""
    monkeypatch.setattr(embed, "PROBES", 300)
    monkeypatch.setattr(embed, "WINDOW", 16)
    r = np.random.default_rng(5)
    n, dim = 6_000, 32
    x = r.normal(size=(n, dim)) / np.sqrt(dim)
    x = np.sqrt(1 - shared) * x / np.linalg.norm(x, axis=1, keepdims=True) + np.sqrt(shared) * np.eye(dim)[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = r.normal(size=(600, dim))
    u -= (u * x[:600]).sum(1, keepdims=True) * x[:600]
    near = 0.935 * x[:600] + np.sqrt(1 - 0.935**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    v = np.concatenate([x, near]).astype(np.float32)
    df = spark.createDataFrame([(i, a, 1) for i, a in enumerate(v.tolist())], "vec_id long, embedding array<float>, label int")
    w = v.astype(np.float64)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    links = (w @ w.T >= 0.93).sum(1) - 1
    got = np.zeros(len(v), int)
    for row in embed.near_vectors(df).collect():
        got[row.vec_id] = row.n_links
    assert (got <= links).all() and got.sum() >= 0.97 * links.sum() >= 0.97 * 1200


def test_a_long_chain_of_different_vectors(spark, monkeypatch):
    monkeypatch.setattr(embed, "TILE_ROWS", 16)
    angle = [i * 0.3 for i in range(20)]  # neighbours are linked, others are not
    rows = [(100 - i, [float(np.cos(a)), float(np.sin(a)), 0.0], 4) for i, a in enumerate(angle)]
    assert result(spark, rows) == brute(rows)
