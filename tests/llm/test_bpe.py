import hashlib
import random
import string

import numpy as np
import pytest

tokenizers_of_the_box = pytest.importorskip("public_tokenizers")

from skein.llm import bpe  # noqa: E402

FILE = tokenizers_of_the_box.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", "Hello world, don't!", " \t\n\n  x  ", "a" * 700, "ab" * 300, "the" * 200, "é" * 99 + "!" * 130 + " " * 41, "日本語 テキスト", "<|endoftext|>", "x\u0085y\u00a0z\u2028w", "bcabc" * 40, "12345 6789 ½ ²"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = bpe.load_ranks(open(FILE, "rb").read())
    return tiktoken.Encoding("own", pat_str=tokenizers_of_the_box.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_round_trip(spark, documents, reference):
    rows = list(enumerate(TEXTS)) + [(100, None), (None, "no id"), (3, TEXTS[3])]
    out = bpe.encode_decode(documents(rows, n_tokens=1, start=2), FILE, tokenizers_of_the_box.PATTERN).collect()
    want = []
    for i, t in rows:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        want.append((str(i), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(x.doc_id), x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in out) == sorted(want)
    assert bpe.encode_decode(documents([]), FILE, tokenizers_of_the_box.PATTERN).count() == 0


def test_leftmost_pair_first_where_order_matters():
    import tiktoken

    tokens = [bytes([i]) for i in range(256)] + [b"ca", b"bca", b"bc", b"abc", b"aa", b"aab"]
    ranks = {t: i for i, t in enumerate(tokens)}
    e = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    c = bpe.Codec(ranks, r"\S+|\s+")
    for w in ("bcabc", "abcabcab", "aaab", "aaaaaab", "bcabc" * 30, "ab" * 40 + "c" + "aab" * 30, "a" * 131):
        assert np.frombuffer(c.encode([w])[0], "<u4").tolist() == e.encode_ordinary(w), w


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "PIECE", 20)
    c = bpe.Codec(bpe.load_ranks(open(FILE, "rb").read()), tokenizers_of_the_box.PATTERN)
    a = c.encode(["one two three four five six seven"] * 2 + ["eight nine ten"])
    assert a[0] == a[1] and c.decode(a)[2] == b"eight nine ten"


def test_unbroken_words_of_any_length(reference):
    r = random.Random(5)
    c = bpe.Codec(bpe.load_ranks(open(FILE, "rb").read()), tokenizers_of_the_box.PATTERN)
    words = ["".join(r.choice(string.ascii_letters) for _ in range(12_000)), "".join(r.choice(string.ascii_lowercase) for _ in range(100_000)), "a" * 50_000, "ab" * 50_000, "the" * 30_000 + "qz" * 9_000]
    words += ["".join(r.choice("aàé日本x") for _ in range(20_000)), "".join(r.choice("ab") for _ in range(30_000)), "".join(r.choice(string.ascii_lowercase) for _ in range(1_000_000))]
    for w in words:  # the library splits nothing here, and its whole-text call is not made for such words
        assert np.frombuffer(c.encode([w])[0], "<u4").tolist() == reference._core_bpe.encode_single_piece(w.encode()), w[:9]


@pytest.mark.parametrize("piece", [1_000])
def test_words_beyond_a_piece(reference, monkeypatch, piece):
    monkeypatch.setattr(bpe, "PIECE", piece)
    r = random.Random(6)
    c = bpe.Codec(bpe.load_ranks(open(FILE, "rb").read()), tokenizers_of_the_box.PATTERN)
    for w in ("".join(r.choice(string.ascii_lowercase) for _ in range(2_500)), "a" * 3_000, "xy" + "ab" * 1_500, "".join(r.choice("aab") for _ in range(3_000)), "short words and one " + "".join(r.choice(string.ascii_letters) for _ in range(3_000)) + " more"):
        assert np.frombuffer(c.encode([w])[0], "<u4").tolist() == reference.encode_ordinary(w), w[:9]


def test_many_small_vocabularies():
    """Rank tables in no order of length, on words of few letters, so that every rule about neighbours is met."""
    import tiktoken

    r = random.Random(8)
    for _ in range(40):
        more = list({bytes(r.choice(b"abc") for _ in range(r.randint(2, 5))) for _ in range(r.randint(3, 25))})
        r.shuffle(more)
        ranks = {t: i for i, t in enumerate([bytes([i]) for i in range(256)] + more)}
        e = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        c = bpe.Codec(ranks, r"\S+|\s+")
        for n in (7, 60, 300):
            w = "".join(r.choice("abc") for _ in range(n)) if r.random() < 0.7 else ("abcab"[: r.randint(1, 5)] * n)[:n]
            assert np.frombuffer(c.encode([w])[0], "<u4").tolist() == e.encode_ordinary(w), (w, more)


def test_short_words_take_the_short_recursion(reference, monkeypatch):
    monkeypatch.setattr(bpe, "ENCODE", "not for short words")
    r = random.Random(9)
    c = bpe.Codec(bpe.load_ranks(open(FILE, "rb").read()), tokenizers_of_the_box.PATTERN)
    words = ["".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(1, bpe.SHORT))) for _ in range(500)] + ["a" * bpe.SHORT, "\u00e9" * (bpe.SHORT // 2)]
    for w, ids in zip(words, c.encode(words)):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(w), w


class Counting:
    """A database that notes how many rows are handed to it under each name."""

    def __init__(self, db):
        self.db, self.rows = db, {}

    def register(self, name, table):
        self.rows.setdefault(name, []).append(len(table))
        return self.db.register(name, table)

    def sql(self, query):
        return self.db.sql(query)


def test_each_different_word_goes_through_duckdb_once(reference):
    """A text's words are contracted and decoded once, however often and wherever they stand."""
    c = bpe.Codec(bpe.load_ranks(open(FILE, "rb").read()), tokenizers_of_the_box.PATTERN)
    c.db = Counting(c.db)
    words = [f"qz{a}xv{b}jq" for a in "bcdfg" for b in "hklmn"]
    r = random.Random(10)
    texts = [" ".join(r.choices(words, k=200)) for _ in range(50)]
    ids, back = c.round_trip(texts)
    assert back.to_pylist() == [t.encode() for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.to_pylist()] == [reference.encode_ordinary(t) for t in texts]
    different = {w for t in texts for w in (t.split(" ")[0], *(" " + x for x in t.split(" ")[1:]))}
    once = sum(len(reference.encode_ordinary(w)) for w in different)
    assert c.db.rows["tokens"] == [once] and sum(map(len, ids.to_pylist())) // 4 > 50 * once
    assert sum(c.db.rows["start"]) <= 2 * len(different)


def test_white_space_of_all_kinds(reference):
    r = random.Random(11)
    c = bpe.Codec(bpe.load_ranks(open(FILE, "rb").read()), tokenizers_of_the_box.PATTERN)
    signs = ["a", "the", "Q", "é", "日", "7", "'s", "'", "!", "qzx", " ", " ", " ", " ", "  ", "\n", "\t", "\r\n", " ", " ", "　", "\u0085", "\x1c", "​", "\x00", "\U0001f600"]
    for _ in range(60):
        texts = ["".join(r.choices(signs, k=r.randint(0, 30))) for _ in range(40)]
        ids, back = c.round_trip(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.to_pylist()] == [reference.encode_ordinary(t) for t in texts]
        assert back.to_pylist() == [t.encode() for t in texts]


def test_pattern_that_leaves_spaces_out():
    import tiktoken

    ranks = bpe.load_ranks(open(FILE, "rb").read())
    e = tiktoken.Encoding("letters", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    c = bpe.Codec(ranks, r"\w+")
    texts = ["qzxv jqzk, qzxv", "one", "", "- qzxv -", "a b c a b"]
    assert [np.frombuffer(x, "<u4").tolist() for x in c.encode(texts)] == [e.encode_ordinary(t) for t in texts]


def test_rows_of_several_batches(spark, documents, reference):
    rows = [(i, None if i % 97 == 0 else f"row {i} qzxv{i % 7} " * (i % 5) + "end") for i in range(1500)]
    out = bpe.encode_decode(documents(rows).coalesce(1), FILE, tokenizers_of_the_box.PATTERN).collect()
    want = []
    for i, t in rows:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(tuple(x) for x in out) == want
