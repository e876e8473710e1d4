import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from skein.llm import lm


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def plain_model(train, depth):
    """Counts of every node, block estimates and weights of context-tree weighting, node by node."""
    n = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)

    def steps(text):
        data = bytes(depth) + text + b"\xff"
        for i in range(depth, len(data)):
            node = 1
            for k in range(8):
                bit = data[i] >> (7 - k) & 1
                yield data[i - depth : i], node, bit
                node = node << 1 | bit

    for t in train:
        for ctx, node, bit in steps(t):
            for d in range(depth + 1):
                n[ctx[depth - d :], node][bit] += 1
                if d:
                    kids[ctx[depth - d + 1 :], node].add((ctx[depth - d :], node))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    weighted, ratio = {}, {}
    for key in sorted(n, key=lambda k: -len(k[0])):
        own = kt(*n[key])
        if len(key[0]) == depth:
            weighted[key] = own
            continue
        below = sum(weighted[k] for k in kids[key])
        ratio[key] = own - below
        weighted[key] = math.log(0.5) + np.logaddexp(own, below)

    def score(text):
        out = 0.0
        for ctx, node, bit in steps(text):
            p = None
            for d in range(depth, -1, -1):
                key = (ctx[depth - d :], node)
                if key in n:
                    own = (n[key][bit] + 0.5) / (sum(n[key]) + 1)
                    share = None if p is None else 1 / (1 + math.exp(-max(-700, min(700, ratio[key]))))
                    p = own if p is None else share * own + (1 - share) * p
            out += math.log10(0.5 if p is None else p)
        return out

    return score


@pytest.mark.parametrize("keys", [1 << 21, 20])
def test_against_brute_force(documents, monkeypatch, keys):
    monkeypatch.setattr(lm, "TABLE_KEYS", keys)
    monkeypatch.setattr(lm, "HELD_KEYS", 30)
    monkeypatch.setattr(lm, "BUCKET_GRAMS", 64)
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["The", "the", "cat", "sat.", "on", "mat\n", "é", "x%d" % r.randint(0, 30)]) for _ in range(r.randint(0, 25)))) for i in range(40)]
    rows += [(50, None), (51, ""), (None, "the null id"), (3, rows[3][1])]
    got = lm.score_documents(documents(rows, key=1, n=2, block=3), depth=3).collect()
    assert len(got) == len(rows)
    texts = [(i, (t or "").encode().lower()) for i, t in rows]
    train = [t for i, t in texts if not held(i)]
    c = Counter(w for t in train for w in t.split())
    c[b""] = len(train)
    n, v = sum(c.values()), len(c)
    score = plain_model(train, 3)
    want = sorted(
        (str(i), held(i), len(t.split()) + 1, sum(c[w] > 0 for w in [*t.split(), b""]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*t.split(), b""]), 6), round(score(t), 6)) for i, t in texts
    )
    assert sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6), round(x.score, 6)) for x in got) == want
    assert any(h for _, h, *_ in want) and all(x.bits_per_byte > 0 for x in got)


def test_probabilities_sum_to_one(spark):
    from pyspark.sql import functions as F

    g = np.concatenate([x for t in (b"abcabc", b"abd", b"aaaa") for x in lm.grams(t, 3)])
    u, c = np.unique(g, return_counts=True)
    ctx = int(u[0]) >> 8
    rows = {int(k): int(n) for k, n in zip(u, c)} | {k: 0 for k in (ctx << 8 | b for b in range(256)) if k not in set(u.tolist())}
    out = lm.gram_scores(spark.createDataFrame(list(rows.items()), "gram long, n long"), 3).filter(F.shiftright("gram", 8) == ctx).toPandas()
    assert len(out) == 256 and abs(np.exp(out.logp).sum() - 1) < 1e-9


def test_lgamma():
    x = np.array([0.5, 1, 1.5, 2, 3.5, 10, 1e3 + 0.5, 1e7])
    assert np.allclose(lm._lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_lookup():
    r = np.random.default_rng(0)
    k = r.choice(1 << 40, 5000, replace=False).astype(np.int64)
    t = lm.Lookup(k[:4000], np.arange(4000.0))
    v, hit = t.get(k)
    assert hit[:4000].all() and not hit[4000:].any() and (v[:4000] == np.arange(4000)).all()
    assert not lm.Lookup(k[:0], np.zeros(0)).get(k)[1].any()


def test_empty_and_without_training(documents):
    assert lm.score_documents(documents([])).count() == 0
    i = next(i for i in range(50) if held(i))
    x = lm.score_documents(documents([(i, "ab")])).first()
    assert x.train_tokens == 0 and x.base_score == 0 and abs(x.score - 24 * math.log10(0.5)) < 1e-9


def test_held_out_text_of_the_same_kind_is_cheaper_than_noise(documents):
    r = random.Random(4)
    word = lambda: r.choice(["the", "and", "ing", "tion", "er"]) + r.choice(["the", "and", "ing", "tion", "er"])
    rows = [(i, " ".join(word() for _ in range(60))) for i in range(60)] + [(10_000 + i, "".join(chr(r.randint(97, 122)) for _ in range(400))) for i in range(10)]
    out = lm.score_documents(documents(rows)).filter("held_out").collect()
    good = [x.bits_per_byte for x in out if x.doc_id < 1000]
    bad = [x.bits_per_byte for x in out if x.doc_id >= 10_000]
    assert good and bad and max(good) < min(bad)
    assert all(x.score > -1.5 * len(rows[x.doc_id][1]) for x in out if x.doc_id < 1000)
