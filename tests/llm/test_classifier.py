import random

import numpy as np
import xxhash

from skein.llm import classifier as C
from skein.llm.classifier import LABELLERS, Shapes, classify, describe, estimate, keep_good, votes


def prose(r, n=80):
    return " ".join(r.choice(["the", "of", "and", "riverbank", "lantern", "walked", "morning", "to", "a", "garden,", "window."]) for _ in range(n))


def corpus(r):
    good = [prose(r) for _ in range(60)]
    junk = [" ".join(w + r.choice(["%%%", "$$$", "***"]) for w in prose(r).split()) for _ in range(8)]
    junk += [" ".join(w.upper() + "!!" for w in prose(r).split()) for _ in range(6)] + ["spam " * 90] * 3 + [" | ".join(prose(r).split()) for _ in range(4)]
    return good, junk


def test_separates_junk_and_learns_from_all(documents):
    good, junk = corpus(random.Random(3))
    out = {x.doc_id: x for x in classify(documents(good + junk, key=1, score=2, keep=3)).collect()}
    assert all(out[i].keep and out[i].posterior > 0.5 for i in range(60))
    assert not any(out[60 + i].keep for i in range(len(junk)))
    assert {x.doc_id for x in keep_good(documents(good + junk)).collect()} == set(range(60))


def test_nulls_empty_repeats(documents):
    assert classify(documents([])).count() == 0 and keep_good(documents([])).count() == 0
    good, junk = corpus(random.Random(5))
    rows = list(enumerate(good + junk)) + [(None, good[0]), (900, None), (901, ""), (902, " \n"), (0, good[0])]
    out = classify(documents(rows)).collect()
    assert len(out) == len(rows)
    assert [x.keep for x in out if x.doc_id is None] == [True] and [x.keep for x in out if x.doc_id == 0] == [True, True]
    assert all(x.score is None and not x.keep for x in out if x.doc_id is not None and x.doc_id >= 900)


def test_em_recovers_accuracies():
    r = random.Random(1)
    accuracy = [0.95, 0.9, 0.8, 0.75, 0.7, 0.9, 0.85, 0.6]
    patterns, truth = {}, {}
    for _ in range(20_000):
        good = r.random() < 0.7
        p = sum((2 if good == (r.random() < a) else 1) * 3**i for i, a in enumerate(accuracy))
        patterns[p] = patterns.get(p, 0) + 1
        truth.setdefault(p, []).append(good)
    post, found = estimate(patterns)
    assert len(found) == LABELLERS
    for (bad, good), a in zip(found, accuracy):
        assert abs(bad - a) < 0.04 and abs(good - a) < 0.04
    right = sum(sum(g == (post[p] > 0.5) for g in gs) for p, gs in truth.items())
    assert right / 20_000 > 0.96
    assert estimate({})[0] == {} and estimate({0: 5})[0][0] > 0


def test_pieces_count_like_the_whole():
    text = (b"word word other " * 90_000)[:-1]
    a, b = Shapes(), Shapes()
    no, count, again = describe(a, text)
    assert count.sum() == 270_000 and again == 90_000
    assert votes(a, no, count, again) == votes(b, *describe(b, b"word word other " * 100))


def plain_traits(word):
    """Shape and traits of a word, sign by sign."""
    shape = bytearray()
    for c in word:
        c = ord("0") if 48 <= c <= 57 else ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else c
        if not (len(shape) >= 2 and shape[-1] == c == shape[-2]):
            shape.append(c)
    letters = any(c in b"aA" for c in shape)
    return bytes(shape), [
        any(x == y and x not in b"aA0" for x, y in zip(shape, shape[1:])), letters and 97 not in shape, not letters and 48 not in shape,
        len(shape) > 1 and shape[-1] in b".!?," and shape[-2] == 97, letters and len(word) <= 4, len(word),
    ]


def plain(text):
    """Votes, and features by name, of a text as UTF-8."""
    w = text.encode().split()
    if not w:
        return 0, {}
    seen = [plain_traits(x) for x in w]
    signs, upper, bare, ends, short, length = (sum(t[i] for _, t in seen) / len(w) for i in range(6))
    repeat = sum(a == b for a, b in zip(w, w[1:])) / len(w)
    pick = lambda x, high, low: 1 if x > high else 2 if x < low else 0
    if len(w) < 5:
        say = [int(signs > 0.5), 0, int(bare > 0.5), 0, 0, 0, 0, 0]
    else:
        most = max(signs, upper, bare, repeat)
        say = [
            pick(signs, 0.2, 0.05), pick(upper, 0.5, 0.2), pick(bare, 0.2, 0.05), pick(repeat, 0.2, 0.05), 2 if 0.005 < ends < 0.4 else int(len(w) >= 40),
            2 if 0.1 < short < 0.85 else int(short <= 0.02 or short >= 0.97), 2 if 2.5 <= length <= 12 else int(length < 1.5 or length > 20),
            2 if len(w) >= 20 and most < 0.1 else int(most > 0.4),
        ]
    f = {}
    for shape, _ in seen:
        at = xxhash.xxh32_intdigest(shape) % C.SHAPES
        f[at] = f.get(at, 0) + 1 / len(w)
    for i, x in enumerate([signs, upper, bare, ends, short, length, repeat]):
        steps = (1.5, 2.5, 8, 12, 20) if i == 5 else (0.02, 0.1, 0.25, 0.5)
        f[C.SHAPES + 8 * i + sum(x > s for s in steps)] = 1.0
    return sum(v * 3**i for i, v in enumerate(say)), f


def mixed(r):
    good, junk = corpus(r)
    long = "x" * 33 + " " + "Y" * 63 + " " + "ab1" * 5_000 + "%%%" * 3_000 + " " + "漢字" * 400 + " end, of it."
    return good + junk + [long, "A" * 200 + "!!" * 100, "", None, "...", "one two", "12 34 56 78 90"]


def test_against_brute_force(documents):
    texts = mixed(random.Random(12))
    want = [plain(t or "") for t in texts]
    rows = {x.doc_id: x for x in C.described(documents(texts, at=1, pattern=2)).collect()}
    for i, (vote, f) in enumerate(want):
        assert rows[i].pattern == vote, texts[i]
        assert rows[i].at == sorted(f) and np.allclose(rows[i].x, [f[k] for k in sorted(f)], atol=1e-7)
    seen = {}
    for v, _ in want:
        seen[v] = seen.get(v, 0) + 1
    post, _ = estimate(seen)
    x = np.zeros((len(texts), C.DIMS + 1))
    for i, (_, f) in enumerate(want):
        x[i, list(f)] = list(f.values())
        x[i, -1] = bool(f)
    y = np.array([post[v] for v, _ in want])
    used, free = x[:, -1] > 0, np.append(np.ones(C.DIMS), 0)

    def loss(w):
        z = x[used] @ w
        g = x[used].T @ (1 / (1 + np.exp(-z)) - y[used]) / len(texts) + C.PENALTY * free * w
        return (np.logaddexp(0, z) - y[used] * z).sum() / len(texts) + C.PENALTY / 2 * free @ (w * w), g

    w = np.random.default_rng(1).normal(size=C.DIMS + 1)
    got = C.gradient(C.described(documents(texts)), post, w)
    full = loss(w)[1] - C.PENALTY * free * w
    assert np.allclose(got[1] / len(texts), full, atol=1e-7)
    w = C.fit(loss, C.DIMS + 1)
    out = {r.doc_id: r for r in classify(documents(texts)).collect()}
    for i in range(len(texts)):
        assert abs(out[i].posterior - y[i]) < 1e-9
        assert (out[i].score is None) == (not used[i]) and (not used[i] or abs(out[i].score - x[i] @ w) < 1e-2)
    least = C.fit(loss, C.DIMS + 1, 2_000)
    assert np.abs(loss(least)[1]).max() < 1e-5 and loss(w)[0] < loss(least)[0] + 0.02


def test_order_and_partitions_change_nothing(documents):
    texts = mixed(random.Random(4))
    rows = [(i, t) for i, t in enumerate(texts)]
    want = None
    for n, order in ((1, rows), (7, rows[::-1]), (200, rows[3:] + rows[:3])):
        df = documents(order).repartition(n)
        got = sorted((x.doc_id, x.posterior, x.score, x.keep) for x in classify(df).select("doc_id", "posterior", "score", "keep").collect())
        want = want or got
        assert got == want and {x.doc_id for x in keep_good(df).collect()} == {i for i, _, _, k in want if k}


def test_junk_behind_any_prefix_counts():
    s = Shapes()
    for word in (b"a" * 30 + b"%%%", b"abc" * 50 + b"$$", b"A1b2" * 500 + b"!!"):
        no, count, again = describe(s, word + b" clean")
        assert sum(s.rows[i][1] for i in no) == 1 and sum(s.rows[i][6] * c for i, c in zip(no, count)) == len(word) + 5


def test_forgetting_shapes_changes_nothing(monkeypatch):
    texts = [t.encode() for t in mixed(random.Random(2)) if t]
    a, want = Shapes(), []
    for t in texts:
        d = describe(a, t)
        want.append((votes(a, *d), *[x.tolist() for x in C.features(a, *d)]))
    monkeypatch.setattr(Shapes, "LIMIT", 3)
    b = Shapes()
    for t, w in zip(texts, want):
        d = describe(b, t)
        assert (votes(b, *d), *[x.tolist() for x in C.features(b, *d)]) == w


def test_clashing_names(documents):
    good, junk = corpus(random.Random(3))
    kept = keep_good(documents(good + junk, at=1, x=2, pattern=3, score=4, good=5))
    assert {x.doc_id for x in kept.collect()} == set(range(60)) and kept.columns[-5:] == ["at", "x", "pattern", "score", "good"]
