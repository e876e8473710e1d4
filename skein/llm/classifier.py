"""Quality by weak labels: EM over overlapping heuristic labellers, posteriors train a hashed linear scorer."""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import discard, read, scratch, small_batches, texts, word_pieces

#: Hashed features: word shapes below SHAPES; above, the step on which each of a text's rates stands.
DIMS, SHAPES = 4096, 4032
LABELLERS = 8
#: The scorer's L2 penalty, and how often its loss and gradient are taken over all documents at most.
PENALTY, PASSES = 1e-4, 25
#: Gradients are summed in whole multiples of this, so that the order of documents and partitions changes nothing.
_UNIT = 2.0**-32
_RATE_STEPS, _LENGTH_STEPS = (0.02, 0.1, 0.25, 0.5), (1.5, 2.5, 8, 12, 20)
_TABLE = bytes(
    (0x30 if 0x30 <= i <= 0x39 else 0x41 if 0x41 <= i <= 0x5A else 0x61 if 0x61 <= i <= 0x7A or i >= 0x80 else i) for i in range(256)
)


_RUN = re.compile(rb"(.)\1{2,}", re.S)


class Shapes(dict):
    """word -> number of its row; words of one shape and length share it.

    The shape of a word, however long, has letters as a or A, digits as 0, and runs cut to two signs. What is
    remembered is bounded by `tidy`, long words are not remembered, and neither changes what a row holds.
    """

    LIMIT, LONG = 200_000, 64

    def __init__(self) -> None:
        super().__init__()
        self.known: dict[tuple[bytes, int], int] = {}
        self.rows: list[tuple[int, ...]] = []

    def tidy(self) -> None:
        """Between two texts: forget all numbers given out if they are many."""
        if len(self) + len(self.rows) >= self.LIMIT:
            self.clear()
            self.known.clear()
            self.rows.clear()

    def __missing__(self, word: bytes) -> int:
        shape = _RUN.sub(rb"\1\1", word.translate(_TABLE))
        short = len(word) < self.LONG
        no = self.known.get((shape, len(word))) if short else None
        if no is None:
            no = len(self.rows)
            letters = shape.count(b"a") + shape.count(b"A")
            twice = re.search(rb"([^aA0])\1", shape, re.S) is not None
            self.rows.append(
                (
                    xxhash.xxh32_intdigest(shape) % SHAPES, twice, letters and not shape.count(b"a"), not letters and not shape.count(b"0"),
                    shape[-1:] in (b".", b"!", b"?", b",") and shape[-2:-1] == b"a", letters and len(word) <= 4, len(word),
                )
            )
            if short:
                self.known[shape, len(word)] = no
        if short:
            self[word] = no
        return no


def describe(shapes: Shapes, text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of the shapes of a text, how often each occurs, and how many words repeat the one before."""
    shapes.tidy()
    total: dict[int, int] = {}
    again, last = 0, None
    for words in word_pieces(text):
        if not words:
            continue
        again += sum(map(operator.eq, words, words[1:])) + (words[0] == last)
        last = words[-1]
        number, count = np.unique(np.fromiter(map(shapes.__getitem__, words), np.int64, len(words)), return_counts=True)
        for i, n in zip(number.tolist(), count.tolist()):
            total[i] = total.get(i, 0) + n
    return np.array(list(total), np.int64), np.array(list(total.values()), np.float64), again


def rates(shapes: Shapes, no: np.ndarray, count: np.ndarray, again: int) -> list[float]:
    """Of a text with words: the shares of its words with runs of signs, in capitals, without letters or digits, that
    end a clause, that are short, their mean length, and the share that repeats the word before."""
    n = count.sum()
    traits = np.array([shapes.rows[i] for i in no], dtype=np.float64)
    return [*(count @ traits[:, 1:] / n).tolist(), again / n]


def votes(shapes: Shapes, no: np.ndarray, count: np.ndarray, again: int) -> int:
    """The labellers' votes as digits to base 3: 0 abstains, 1 says bad, 2 says good."""
    n = count.sum()
    if not n:
        return 0
    signs, upper, bare, ends, short, length, repeat = rates(shapes, no, count, again)
    if n < 5:  # too short for rates: only signs and letters are judged
        say = [1 if signs > 0.5 else 0, 0, 1 if bare > 0.5 else 0, 0, 0, 0, 0, 0]
    else:
        say = [
            1 if signs > 0.2 else 2 if signs < 0.05 else 0,
            1 if upper > 0.5 else 2 if upper < 0.2 else 0,
            1 if bare > 0.2 else 2 if bare < 0.05 else 0,
            1 if repeat > 0.2 else 2 if repeat < 0.05 else 0,
            2 if 0.005 < ends < 0.4 else 0 if n < 40 else 1,
            2 if 0.1 < short < 0.85 else 1 if short <= 0.02 or short >= 0.97 else 0,
            2 if 2.5 <= length <= 12 else 1 if length < 1.5 or length > 20 else 0,
            2 if n >= 20 and max(signs, upper, bare, repeat) < 0.1 else 1 if max(signs, bare, repeat, upper) > 0.4 else 0,
        ]
    return sum(v * 3**i for i, v in enumerate(say))


def estimate(patterns: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], list[tuple[float, float]]]:
    """EM over the histogram of vote patterns: P(good) of each pattern, and each labeller's accuracy on bad and good.

    The table of P(vote | class) has three columns, so abstaining is informative too, and has one vote of
    smoothing in every cell. A labeller looks for one kind of junk and the others don't see it, so a single vote
    for bad starts the text off as likely bad. A pattern without votes gets the prior.
    """
    if not patterns:
        return {}, [(0.0, 0.0)] * LABELLERS
    keys = sorted(patterns)
    v = np.array([[k // 3**i % 3 for i in range(LABELLERS)] for k in keys])
    weight = np.array([patterns[k] for k in keys], dtype=np.float64)
    good = np.array([0.9, 0.3, 0.1])[np.minimum((v == 1).sum(1), 2)]
    table = np.zeros((LABELLERS, 2, 3))
    for _ in range(rounds):
        for i in range(LABELLERS):
            for x in range(3):
                hit = weight * (v[:, i] == x)
                table[i, 0, x], table[i, 1, x] = (hit * (1 - good)).sum() + 1, (hit * good).sum() + 1
        table /= table.sum(axis=2, keepdims=True)
        share = ((weight * good).sum() + 1) / (weight.sum() + 2)
        logit = math.log(share / (1 - share)) + sum(np.log(table[i, 1, v[:, i]] / table[i, 0, v[:, i]]) for i in range(LABELLERS))
        new = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            good = new
            break
        good = new
    good = np.where((v > 0).any(1), good, share)
    return dict(zip(keys, good.tolist())), [(float(table[i, 0, 1]), float(table[i, 1, 2])) for i in range(LABELLERS)]


def features(shapes: Shapes, no: np.ndarray, count: np.ndarray, again: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text with words, ascending, and their values: the share of each shape, and 1 for the step of each rate."""
    share = np.bincount([shapes.rows[i][0] for i in no], count, SHAPES)
    at = np.nonzero(share)[0]
    r = rates(shapes, no, count, again)
    steps = [SHAPES + 8 * i + int(np.searchsorted(_LENGTH_STEPS if i == 5 else _RATE_STEPS, x)) for i, x in enumerate(r)]
    return np.concatenate([at, np.array(steps, np.int64)]), np.concatenate([share[at] / count.sum(), np.ones(len(steps))]).astype(np.float32)


_FEATURES = "doc_id long, pattern int, at array<int>, x array<float>"


def described(docs: DataFrame) -> DataFrame:
    """doc_id, pattern, at, x: the votes on each text and its features, none for a text without words."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, none = Shapes(), (np.zeros(0, np.int64), np.zeros(0, np.float32))
        for b in batches:
            pattern, got = [], []
            for t in texts(b):
                d = describe(shapes, t)
                pattern.append(votes(shapes, *d))
                got.append(features(shapes, *d) if len(d[1]) else none)
            ends = pa.array(np.cumsum([0] + [len(at) for at, _ in got]).astype(np.int32))
            flat = [np.concatenate([g[i] for g in got]) for i in (0, 1)]
            cols = [b.column(0), pa.array(pattern, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(flat[0].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(flat[1]))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "pattern", "at", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, _FEATURES)


def _margins(weight: np.ndarray, at: np.ndarray, x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of texts with `size` features each: the sum of their values times weights, and the bias."""
    text = np.repeat(np.arange(len(size)), size)
    return np.bincount(text, weight[at] * x, len(size)) + weight[DIMS]


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, x = b.column(b.schema.get_field_index("at")), b.column(b.schema.get_field_index("x"))
    return at.flatten().to_numpy(), x.flatten().to_numpy().astype(np.float64), at.value_lengths().to_numpy()


def gradient(rows: DataFrame, good: dict[int, float], weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over all texts with words of the logistic loss against the posteriors and of its gradient, the bias last.

    Each task adds up what its texts bring; at most DIMS + 2 sums reach the driver.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS + 2, np.int64)
        for b in batches:
            at, x, size = _flat(b)
            some = size > 0
            y = np.array([good[p] for p in b.column(b.schema.get_field_index("pattern")).to_pylist()])
            z = _margins(weight, at, x, size)
            off = np.where(some, 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y, 0.0)
            loss = np.where(some, np.logaddexp(0, z) - y * z, 0.0)
            whole = lambda v: np.rint(v / _UNIT)
            total[:DIMS] += np.bincount(at, whole(np.repeat(off, size) * x), DIMS).astype(np.int64)
            total[DIMS] += int(whole(off).sum())
            total[DIMS + 1] += int(whole(loss).sum())
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["feature", "x"])

    out = np.zeros(DIMS + 2)
    sums = rows.select("pattern", "at", "x").mapInArrow(each, "feature int, x long").groupBy("feature")
    for r in sums.agg(F.sum(F.col("x").cast("decimal(28,0)")).alias("x")).collect():
        out[r["feature"]] = float(r["x"]) * _UNIT
    return float(out[DIMS + 1]), out[: DIMS + 1]


def fit(loss_of, size: int, passes: int = PASSES) -> np.ndarray:
    """The least of a smooth convex function by limited-memory BFGS; loss_of(w) gives (loss, gradient), at most `passes` times."""
    w = np.zeros(size)
    loss, g = loss_of(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    left = passes - 1
    while left > 0 and np.abs(g).max() > 1e-6:
        d, back = -g, []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            d = d - a * y
            back.append(a)
        if past:
            d = d * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(back)):
            d = d + s * (a - (y @ d) / (s @ y))
        step = 1.0 if past else min(1.0, 1 / np.abs(g).sum()) * 10
        while left > 0:
            left -= 1
            new, ng = loss_of(w + step * d)
            if new <= loss + 1e-4 * step * (g @ d):
                break
            step /= 4
        else:
            break
        if (ng - g) @ d > 1e-12:
            past = [*past, (step * d, ng - g)][-8:]
        w, loss, g = w + step * d, new, ng
    return w


def train(rows: DataFrame) -> tuple[dict[int, float], np.ndarray, list[tuple[float, float]]]:
    """From `described` rows: posteriors by vote pattern, weights of the features and the bias, accuracies of the labellers.

    All documents count. What the driver gets is bounded: at most 3 ** LABELLERS patterns and, for each pass, DIMS + 2
    sums. The scorer is logistic regression on the posteriors as soft labels, with an L2 penalty on all but the bias.
    """
    seen = {r[0]: r[1] for r in rows.groupBy("pattern").count().collect()}
    good, accuracy = estimate(seen)
    n = max(1, sum(seen.values()))
    free = np.append(np.ones(DIMS), 0.0)

    def loss_of(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, g = gradient(rows, good, w)
        return loss / n + PENALTY / 2 * float(free @ (w * w)), g / n + PENALTY * free * w

    return good, np.round(fit(loss_of, DIMS + 1) if seen else np.zeros(DIMS + 1), 6), accuracy


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, posterior, score, keep: the weak labels' posterior and the linear score of each document.

    The score is the sum of a document's features times their weights and the bias; it is kept from 0 on. A text without
    words, null or empty, has the score null and is rejected. Repeated rows and null doc_ids are judged like others; extra
    columns are not read. Whole texts and whole words count, however long. The order and the partitions of the rows change
    nothing. Texts are read once, later passes read their features.
    """
    rows = scratch(described(docs), "features")
    good, weight, _ = train(rows)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x, size = _flat(b)
            z = [round(s, 6) if n else None for s, n in zip(_margins(weight, at, x, size).tolist(), size.tolist())]
            post = pa.array([good[p] for p in b.column(1).to_pylist()], pa.float64())
            cols = [b.column(0), post, pa.array(z, pa.float64()), pa.array([s is not None and s >= 0 for s in z], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "posterior", "score", "keep"])

    return rows.mapInArrow(each, "doc_id long, posterior double, score double, keep boolean")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that `classify` keeps, with the columns they have; extra columns may have any names."""
    rows = scratch(described(docs), "features")
    _, weight, _ = train(rows)
    discard(rows)

    @F.pandas_udf("boolean")
    def good(text):
        import pandas as pd

        shapes, out = Shapes(), []
        for t in text:
            d = describe(shapes, t.encode() if t is not None else b"")
            if len(d[1]):
                at, x = features(shapes, *d)
                out.append(round(float(_margins(weight, at, x.astype(np.float64), np.array([len(at)]))[0]), 6) >= 0)
            else:
                out.append(False)
        return pd.Series(out, dtype=bool)

    return docs.filter(good("text"))


def op7_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"))
