import random
import re

import numpy as np
import pytest

from skein.llm import substring as S


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) + r.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture
def r():
    return random.Random(11)


def removed(docs, **kw):
    return {x.doc_id: x.text for x in S.remove_repeats(docs, **kw).collect()}


def test_sections_join_up(monkeypatch):
    monkeypatch.setattr(S, "SECTION", 50)
    for t in (b"", b"x" * 200, b"ab cd\n" * 40, b"a " * 90, b"word " * 30 + b"y" * 100 + b" end"):
        assert b"".join(S.sections(t)) == t


def test_passage_inside_paragraphs_goes_everywhere_but_first(documents, r):
    passage = prose(r, 70)
    own = [prose(r, 120) for _ in range(6)]
    texts = [o[:200] + " " + passage + " " + o[200:] if i < 4 else o for i, o in enumerate(own)]
    out = removed(documents(texts))
    middle = " ".join(passage.split()[15:-15])
    assert middle in out[0] and out[4] == texts[4] and out[5] == texts[5]
    for i in (1, 2, 3):
        assert middle not in out[i]
        assert all(w in out[i].split() for w in own[i][:200].split()[:-2])


def test_similar_paragraphs_by_exact_jaccard(documents, r):
    base = prose(r, 100).split()
    near, far = list(base), list(base)
    near[50] = "changed"
    for i in range(0, 100, 12):
        far[i] = f"x{i}"
    texts = [prose(r, 40) + "\n" + " ".join(base), prose(r, 40) + "\n" + " ".join(near), prose(r, 40) + "\n" + " ".join(far)]
    found = {(x.doc_id, x.kept_doc_id) for x in S.repeats(documents(texts)).collect() if x.paragraph}
    assert found == {(1, 0)}

    def jaccard(a, b):
        s = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        return len(s(a) & s(b)) / len(s(a) | s(b))

    assert jaccard(base, near) >= 0.8 > jaccard(base, far)


def test_links_equal_brute_force(spark, documents, r, monkeypatch):
    monkeypatch.setattr(S, "GROUP_ROWS", 8)
    paragraphs = []
    for _ in range(12):
        base = prose(r, 60).split()
        for _ in range(r.randint(1, 9)):
            v = list(base)
            for _ in range(r.randint(0, 2)):
                v[r.randrange(60)] = "q%d" % r.randint(0, 99)
            paragraphs.append(" ".join(v))
    docs = documents(paragraphs)
    lines = S.units(docs).filter("line")
    pairs = [(x.a, x.b) for x in S.paragraph_links(docs, lines).collect()]
    sets, name = {}, {x.doc_id: x.unit for x in lines.collect()}
    for i, p in enumerate(paragraphs):
        w = p.split()
        sets[name[i]] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}

    def groups(edges):
        root = {u: u for u in sets}

        def find(a):
            while root[a] != a:
                a = root[a]
            return a

        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return {u: find(u) for u in sets}

    want = groups([(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert groups(pairs) == want and len(set(want.values())) < len(want)


def test_copies_keep_one_and_blank_texts_go(documents, r):
    t = prose(r, 80)
    out = removed(documents([(4, t), (2, t), (9, t), (None, t), (5, ""), (6, None), (7, "short text"), (8, "short text")], section=1, start=2, key=3, unit=4))
    assert out == {2: t, None: t, 5: "", 6: None, 7: "short text", 8: "short text"}


def test_repeats_within_one_document_stay(documents, r):
    t = prose(r, 60)
    assert removed(documents([(1, t + "\n" + t), (1, t + "\n" + t)])) == {1: t + "\n" + t}


def test_columns_and_counts(documents, r):
    t = prose(r, 80)
    docs = documents([(1, t), (2, "own words before\n" + t + "\nand after")])
    out = {x.doc_id: x for x in S.remove_repeats(docs).collect()}
    assert S.remove_repeats(docs).columns == docs.columns
    assert out[2].n_chars == len(out[2].text) < 40 and out[1].n_chars == len(t)
    assert S.remove_repeats(documents([])).count() == 0


def test_every_run_of_twenty_words_that_an_earlier_document_has(documents, r, monkeypatch):
    """Word by word what brute force finds, for short passages, ends of passages, overlaps and repetitive text."""
    monkeypatch.setattr(S, "SECTION", 1 << 12)
    texts = [prose(r, 90).split() for _ in range(40)]
    for i in range(1, 40):
        n, j = r.choice([19, 20, 21, 35, 51, 51, 55]), r.randrange(i)
        at = r.randrange(len(texts[j]) - n)
        texts[i][40:40] = texts[j][at : at + n]
    texts += [prose(r, 30).split() + ["ha"] * 60, prose(r, 30).split() + ["ha"] * 45 + prose(r, 30).split(), prose(r, 25).split() + ["la", "li"] * 30, ["li", "la"] * 12 + prose(r, 25).split()]
    got = {}
    for x in S.repeats(documents([" ".join(t) for t in texts])).collect():
        assert x.kept_doc_id < x.doc_id
        if not x.paragraph:
            assert not got.setdefault(x.doc_id, set()) & set(range(x.start, x.stop))
            got[x.doc_id] |= set(range(x.start, x.stop))
    seen, want = set(), {}
    for i, t in enumerate(texts):
        grams = [tuple(w.lower() for w in t[k : k + 20]) for k in range(len(t) - 19)]
        hit = {w for k, g in enumerate(grams) if g in seen for w in range(k, k + 20)}
        if hit:
            want[i] = hit
        seen |= set(grams)
    assert got == want and len(want) > 30


def test_short_paragraphs_and_short_documents_join_too(documents, r):
    short, five, ten = prose(r, 12), prose(r, 5), prose(r, 18)
    near = ten + " more"
    texts = [prose(r, 40) + "\n" + short + "\n" + ten, prose(r, 40) + "\n" + short.upper() + "\n" + near, prose(r, 40) + "\n" + five, five, prose(r, 6), prose(r, 40) + "\none two three four"]
    texts.append(prose(r, 40) + "\none two three four")
    found = {(x.doc_id, x.kept_doc_id, x.stop - x.start) for x in S.repeats(documents(texts)).collect() if x.paragraph}
    assert found == {(1, 0, 12), (1, 0, 19), (3, 2, 5)}
    out = removed(documents(texts))
    assert 3 not in out and out[4] == texts[4] and out[6] == texts[6] and out[1].split() == texts[1].split()[:40]


def test_sections_and_blocks_change_nothing(documents, r, monkeypatch):
    """Texts over several sections, passages and paragraphs across their borders, long lines, and cutting itself."""
    shared = [prose(r, n) for n in (20, 36, 36, 60, 200)]
    texts = []
    for i in range(6):
        t = ""
        for p in r.sample(shared, 3):
            t += prose(r, r.randint(3, 90)) + r.choice([" ", "\n", "\r\n \n"]) + p + r.choice([" ", "\n", "\t \n"])
        texts.append(t + prose(r, 300) + r.choice(["", "\n", "  "]))
    texts += [texts[2], "w" * 400 + " " + shared[4], "\n\n  \n" + shared[3] + "\n" * 120, ""]
    docs = documents(texts)
    columns = ["doc_id", "start", "stop", "kept_doc_id", "paragraph"]
    want = sorted(map(tuple, S.repeats(docs).select(*columns).collect())), removed(docs)
    assert len(want[0]) > 8
    for section, block in ((50, 32), (1, 7)):
        monkeypatch.setattr(S, "SECTION", section)
        monkeypatch.setattr(S, "BLOCK", block)
        assert (sorted(map(tuple, S.repeats(docs).select(*columns).collect())), removed(docs)) == want


def test_cutting_words(r):
    for _ in range(200):
        text = "".join(r.choice(["ab", "c", " ", "\n", "  \t", "é"]) for _ in range(40)).encode()
        n = len(text.split())
        spans = [tuple(sorted((r.randint(0, n), r.randint(0, n)))) for _ in range(r.randint(0, 3))]
        spans = [s for s in spans if s[0] < s[1]]
        at = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)] + [len(text)]
        gone = {i for s, e in spans for i in range(at[s], at[e])}
        want = bytes(c for i, c in enumerate(text) if i not in gone)
        for size in (1, 5, 1 << 20):
            with pytest.MonkeyPatch.context() as m:
                m.setattr(S, "SECTION", size)
                assert S.without(text, spans) == want


def test_a_text_over_a_section_keeps_its_links(documents, r):
    passages = [prose(r, 36) for _ in range(12)]
    words = [prose(r, 5) for _ in range(2_000)]
    long = " ".join(r.choice(words) + " x%d" % i for i in range(45_000))
    at = S.SECTION
    texts = ["\n".join(passages), long[: at - 100] + " " + passages[0] + " " + long[at - 100 :], "y " * 600_000 + " ".join(passages)]
    found = {x.doc_id: 0 for x in []}
    for x in S.repeats(documents(texts)).collect():
        found[x.doc_id] = found.get(x.doc_id, 0) + x.stop - x.start
    assert found[1] >= 36 and found[2] >= 12 * 36


def test_recall_of_similar_paragraphs(documents, r):
    """Pairs just at the threshold are found nearly all."""
    texts, n = [], 0
    for i in range(200):
        base = prose(r, 100).split()
        other = base + prose(r, 24).split()  # 96 of 120 shingles
        texts += [prose(r, 30) + "\n" + " ".join(base), prose(r, 30) + "\n" + " ".join(other)]
    got = {x.doc_id for x in S.repeats(documents(texts)).collect() if x.paragraph}
    assert len(got) >= 0.98 * 200 and all(i % 2 for i in got)
    assert S.bands_for(0.8) == 6 and 1 - (1 - 0.8**S.ROWS) ** S.BANDS >= S.RECALL


def test_one_python_worker_in_a_task_of_the_last_stage(documents, r):
    """The passages are written down before the texts are cut, so no task runs workers for both."""
    shared = prose(r, 30)
    out = S.remove_repeats(documents([prose(r, 30) + " " + shared, prose(r, 40) + " " + shared]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    assert sum(shared in x.text for x in out.collect()) == 1


def test_short_texts_are_worked_on_together(r, monkeypatch):
    """Array operations don't grow with the number of texts; units are those of each text by itself, whatever the grouping."""
    odd = ["", " ", "\n\n", "a b c d e", "\nq w e r t y\n\nu", prose(r, 19), prose(r, 20), "ha " * 90]
    texts = [t.lower().encode() for t in odd + [prose(r, r.randint(1, 60)) + r.choice([" ", "\n"]) + prose(r, r.randint(1, 60)) for _ in range(200)] + odd]
    calls, windows = [], S._windows
    monkeypatch.setattr(S, "_windows", lambda *a: calls.append(a) or windows(*a))
    rows = lambda parts: sorted((*x, b) for p in parts for *x, b in zip(*(y.tolist() for y in p[:5]), [None] * len(p[0]) if p[5] is None else map(tuple, p[5].tolist())))
    got = rows(S.text_units(texts))
    assert len(calls) <= 4
    assert got == sorted((i, *u[1:]) for i, t in enumerate(texts) for u in rows(S.text_units([t])))
    for gather in (1, 70, 1000):
        monkeypatch.setattr(S, "GATHER", gather)
        assert rows(S.text_units(texts)) == got


def test_a_line_has_one_hash_alone_and_among_others(r, monkeypatch):
    h = np.array([r.getrandbits(64) for _ in range(50)], np.uint64)
    for block in (7, 1 << 18):
        monkeypatch.setattr(S, "BLOCK", block)
        assert S._long_hash(h[9:40]) == S._span_hash(h, np.array([9]), np.array([40]))


def test_merged_spans_equal_one_by_one(r):
    """What the earliest span has goes to it; spans that follow on with the same document are one."""
    for _ in range(300):
        spans = [(r.randint(0, 2), a, a + r.randint(1, 9), r.randint(0, 2)) for a in (r.randint(0, 30) for _ in range(r.randint(0, 25)))]
        want = []
        for row, start, stop, kept in sorted(spans, key=lambda x: (x[0], x[1], -x[2], x[3])):
            if want and want[-1][0] == row and start <= want[-1][2]:
                if want[-1][3] == kept:
                    want[-1][2] = max(want[-1][2], stop)
                    continue
                start = want[-1][2]
            if start < stop:
                want.append([row, start, stop, kept])
        got = S.merged(*(np.array([x[i] for x in spans], np.int64) for i in range(4)))
        assert [list(x) for x in zip(*(x.tolist() for x in got))] == want
