import random

import numpy as np
import pytest
import xxhash

from skein.llm.simhash import GrayIndex, drop_near_duplicates, fingerprint, gray_rank, links, near_duplicates, upper_masks


def plain_fingerprint(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)) if h else 0


def plain_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ["", " \n", "One", "ONE two", "a b c", "É è A b\u00a0c d e", "x " * 50, "the same the same the same the same"])
def test_fingerprint(text):
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_long_texts_go_in_pieces():
    r = random.Random(3)
    text = " ".join(r.choice(["aa", "Bb", "ccc"]) + str(r.randint(0, 99)) for _ in range(400_000))
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_gray_rank_orders_gray_codes():
    n = np.arange(1000, dtype=np.uint64)
    assert (gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_masks_meet_every_close_pair():
    first, below = upper_masks()
    u = lambda m: m & (1 << 64) - 1
    r = random.Random(0)
    for _ in range(500):
        d = sum(1 << i for i in r.sample(range(64), 3))
        assert any(u(m) & d == 0 and any(u(x) & d == 0 for x in below[m]) for m in first)


@pytest.mark.parametrize("cross", [False, True])
def test_index_links_what_brute_force_links(cross):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    x = list({b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(12)})
    part = np.array([r.randint(0, 1) for _ in x])
    got = GrayIndex(np.array(x, dtype=np.uint64), 3).link(part if cross else None)
    near = [(i, j) for i in range(len(x)) for j in range(i) if bin(x[i] ^ x[j]).count("1") <= 3 and (not cross or part[i] != part[j])]

    def groups(pairs):
        root = list(range(len(x)))

        def find(a):
            while root[a] != a:
                a = root[a]
            return a

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(a) for a in range(len(x))]

    assert groups(got) == groups(near) and len(got) < len(x)
    assert all(bin(x[i] ^ x[j]).count("1") <= 3 for i, j in got)


def test_hot_nodes_keep_their_links(spark, monkeypatch):
    from skein.llm import simhash

    monkeypatch.setattr(simhash, "NODE_ROWS", 8)
    r = random.Random(7)
    center = r.getrandbits(64)
    fps = {center ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 4))) for _ in range(150)} | {r.getrandbits(64) for _ in range(30)}
    fps = {i: f for i, f in enumerate(sorted(fps))}
    rows = [(int(np.uint64(f).view(np.int64)), i) for i, f in fps.items()]
    pairs = links(spark.createDataFrame(rows, "fp long, node long")).collect()
    root = {i: i for i in fps}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for p in pairs:
        a, b = sorted((find(p.a), find(p.b)))
        root[b] = a
    assert {i: find(i) for i in fps} == plain_components(fps)


def test_against_brute_force(documents):
    r = random.Random(2)
    words = ["w%d" % i for i in range(400)]
    rows = []
    for i in range(60):
        t = [r.choice(words) for _ in range(300)]
        rows.append((3 * i, " ".join(t)))
        for c in range(r.randint(0, 3)):
            v = list(t)
            v[r.randrange(300)] = "changed"
            rows.append((3 * i + 200 + c, " ".join(v).upper() if c == 1 else " ".join(v)))
    rows += [(900, ""), (901, None), (902, "  \n"), (903, "one"), (904, "One")]
    rows = list(dict(rows).items())
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in near_duplicates(documents(rows, fp=1, node=2, mask=3)).collect()}
    fps = {i: plain_fingerprint(t or "") for i, t in rows}
    want = plain_components(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert len({c for _, c in got.values()}) < len(got)


def test_nulls_repeats_and_empty(documents):
    assert near_duplicates(documents([])).count() == 0
    out = near_duplicates(documents([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "only null ids here")])).collect()
    assert sorted((x.doc_id or -1, x.component_id or -1) for x in out) == [(-1, -1), (-1, 5), (5, 5), (5, 5)]
    kept = drop_near_duplicates(documents([(None, "a b c"), (7, "a b c"), (5, "A b c"), (5, "a b c"), (9, "quite another text here")])).collect()
    assert sorted(x.doc_id or -1 for x in kept) == [-1, 5, 9]


def test_stage_drops_texts_of_jaccard_080_beyond_three_bits(documents):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(3000)]
    base = [[r.choice(words) for _ in range(150)] for _ in range(12)]
    near = [b[:60] + [r.choice(words) for _ in range(12)] + b[60:] for b in base]
    far = [b[:75] + [r.choice(words) for _ in range(75)] for b in base]
    texts = [" ".join(t) for t in base + near + far] + ["one two", "three four"]
    bits = [bin(plain_fingerprint(texts[i]) ^ plain_fingerprint(texts[12 + i])).count("1") for i in range(12)]
    assert sum(b > 3 for b in bits) > 6
    assert sorted(x.doc_id for x in drop_near_duplicates(documents(texts)).collect()) == [*range(12), *range(24, 38)]


def test_stage_keeps_other_texts_of_a_repeated_id(documents):
    a, b, c = "a b c d e f g", "quite another text of seven words here", "something else that nobody has said before"
    kept = drop_near_duplicates(documents([(1, a), (2, a), (2, b), (3, c), (3, b), (4, c), (4, c)])).collect()
    assert sorted((x.doc_id, x.text) for x in kept) == [(1, a), (2, b), (3, c)]
