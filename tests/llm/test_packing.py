import itertools
import random

import pytest

from skein.llm.packing import boundaries, pack, word_lengths


def padding(histogram, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in histogram)


@pytest.mark.parametrize("seed", range(30))
def test_boundaries_are_optimal(seed):
    r = random.Random(seed)
    h = [(n, r.randint(1, 9)) for n in r.sample(range(1, 60), r.randint(1, 9))]
    k = r.randint(1, 5)
    got = boundaries(h, k)
    lengths = sorted(n for n, _ in h)
    best = min(padding(h, [*c, lengths[-1]]) for i in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], i))
    assert len(got) <= k and padding(h, got) == best


def test_every_row_has_one_slot(spark):
    r = random.Random(1)
    rows = [(i, r.choice([0, 3, 50, 50, 50, r.randint(1, 900)])) for i in range(500)] + [(None, 7), (None, 7), (3, 50), (3, 50), (9, 5000)]
    out = pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), buckets=4, budget=1000).toPandas()
    assert len(out) == len(rows)
    assert not out.duplicated(["bucket", "batch", "slot"]).any()
    assert (out.bucket >= out.n_tokens).all() and out.bucket.nunique() <= 5
    for bucket, g in out[out.bucket > 0].groupby("bucket"):
        room = max(1, 1000 // bucket)
        size = g.groupby("batch").size()
        assert size.max() <= room and (size[:-1] == room).all() and sorted(size.index) == list(range(len(size)))
        assert g.slot.max() < room


def test_empty_null_and_extra_columns(spark, documents):
    assert pack(word_lengths(documents([]))).count() == 0
    out = pack(word_lengths(documents([(1, None), (2, ""), (3, " a\tb\x0bc "), (None, "x")], bucket=5, batch=6, n=1))).toPandas()
    assert dict(zip(out.doc_id.fillna(-1), out.n_tokens)) == {1: 0, 2: 0, 3: 3, -1: 1}
