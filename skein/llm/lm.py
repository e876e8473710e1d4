"""Context-tree weighting over bytes: code length of whole texts under a model of the training documents.

Bytes are coded as eight binary decisions. A node of the tree is a context (the last d bytes, d = 0 to
DEPTH) with the bits decided so far; it holds a Krichevsky-Trofimov estimate of the next bit. A node's
weighted probability is half its own estimate's block probability and half the product of those of its
longer contexts, so a prediction mixes the estimates of all depths by the weights that this gives. A
context that training never showed has no say: the longest one seen ends the mixture.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import read, scratch, small_batches, texts, word_pieces

#: Bytes of context.
DEPTH = 5
#: Distinct grams in a task that builds its part of the tree.
BUCKET_GRAMS = 1 << 17
#: Keys of each of the two tables that go to every task: at most 16 MB each.
TABLE_KEYS = 1 << 20
#: Words that a task counts before it hands them on; of grams twice as many.
HELD_KEYS = 400_000
#: A byte that UTF-8 never has ends a text.
END = 0xFF
_PIECE = 1 << 20
_HALF = np.log(0.5)


def grams(low: bytes, depth: int = DEPTH) -> Iterator[np.ndarray]:
    """Each byte of a text and the end, packed with the `depth` bytes before it (zero bytes before the start)."""
    at = 0
    whole = bytes(depth) + low + bytes([END])
    n = len(low) + 1
    while at < n:
        end = min(n, at + _PIECE)
        b = np.frombuffer(whole, np.uint8, end - at + depth, at).astype(np.int64)
        g = b[: end - at].copy()
        for i in range(1, depth + 1):
            g = (g << 8) | b[i : end - at + i]
        yield g
        at = end


def _lgamma_half(n: np.ndarray) -> np.ndarray:
    """ln gamma(n + 1/2)."""
    return _lgamma(n + 0.5)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0: shifted past 12, then Stirling's series."""
    x = np.asarray(x, dtype=np.float64)
    shift, y = np.ones_like(x), x.copy()
    while (low := y < 12).any():
        shift = np.where(low, shift * y, shift)
        y = np.where(low, y + 1, y)
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(shift)


def kt_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma_half(a) + _lgamma_half(b) - _lgamma(a + b + 1) - np.log(np.pi)


class Tree:
    """The nodes of depth `top` and more over some grams, whole below each context of `top` bytes."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, depth: int, top: int):
        self.depth, self.top = depth, top
        sym, ctx = gram & 0xFF, gram >> 8
        bit = np.arange(8)
        self.node = (sym[:, None] >> (8 - bit)) | (1 << bit)
        self.bit = (sym[:, None] >> (7 - bit)) & 1
        self.at: dict[int, np.ndarray] = {}
        self.n: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.key: dict[int, np.ndarray] = {}
        self.weighted: dict[int, np.ndarray] = {}
        self.ratio: dict[int, np.ndarray] = {}
        w = np.repeat(count, 8).astype(np.float64)
        flat_bit = self.bit.ravel()
        for d in range(top, depth + 1):
            key = ((ctx & ((1 << (8 * d)) - 1))[:, None] << 8) | self.node
            self.key[d], at = np.unique(key.ravel(), return_inverse=True)
            self.at[d] = at
            m = len(self.key[d])
            self.n[d] = np.bincount(at, w * (1 - flat_bit), m), np.bincount(at, w * flat_bit, m)
        for d in range(depth, top - 1, -1):
            own = kt_block(*self.n[d])
            if d == depth:
                self.weighted[d], self.ratio[d] = own, np.full(len(own), np.inf)
                continue
            k = self.key[d + 1]
            up = np.searchsorted(self.key[d], (((k >> 8) & ((1 << (8 * d)) - 1)) << 8) | (k & 0xFF))
            below = np.bincount(up, self.weighted[d + 1], len(own))
            self.ratio[d] = own - below
            self.weighted[d] = np.where(sum(self.n[d]) > 0, _HALF + np.logaddexp(own, below), 0.0)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """For each gram and bit: the mixed probability from depth `top` down, and whether that context was seen."""
        flat = self.bit.ravel()
        p, seen = np.full(len(flat), 0.5), np.zeros(len(flat), dtype=bool)
        for d in range(self.depth, self.top - 1, -1):
            zeros, ones = (n[self.at[d]] for n in self.n[d])
            p, seen = mix(p, seen, zeros, ones, self.ratio[d][self.at[d]], flat)
        return p.reshape(-1, 8), seen.reshape(-1, 8)


def mix(p, seen, zeros, ones, ratio, bit):
    """One depth of the mixture: the node's own estimate against p, that of the longer contexts."""
    here = zeros + ones > 0
    own = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1)
    share = 1 / (1 + np.exp(np.clip(-ratio, -700, 700)))
    return np.where(here, np.where(seen, share * own + (1 - share) * p, own), p), seen | here


def _level(nodes: DataFrame, d: int) -> DataFrame:
    """The nodes of depth d from those of depth d + 1: key, zeros, ones, ratio, weighted."""
    key = F.expr(f"(((key >> 8) & {(1 << (8 * d)) - 1}) << 8) | (key & 255)")
    sums = nodes.groupBy(key.alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, o, below = (b.column(i).to_numpy() for i in (1, 2, 3))
            own = kt_block(z, o)
            weighted = np.where(z + o > 0, _HALF + np.logaddexp(own, below), 0.0)
            cols = [b.column(0), b.column(1), b.column(2), pa.array(own - below), pa.array(weighted)]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "zeros", "ones", "ratio", "weighted"])

    kind = "key long, zeros double, ones double, ratio double, weighted double"
    return scratch(sums.mapInArrow(finish, kind), f"depth{d}")


def gram_scores(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """gram, n, logp (natural) for rows (gram, n): n = 0 asks for a gram that training lacks.

    The tree is cut by the three latest bytes of context; contexts are dealt to as many tasks as the grams
    need. What one of these three-byte contexts has below it is one task: at most 256 ** (depth - 2) grams, or 857,000 in
    printable ASCII, which take about 0.6 KB each. The nodes of depth 2 stay in a table of
    which each task gets the ones its contexts end in; those above, at most 255 * 257, go to every task.
    """
    if depth < 3:
        raise ValueError("a depth of at least 3")
    top = 3
    buckets = max(1, -(-counts.count() // BUCKET_GRAMS))
    suffix = F.expr(f"(gram >> 8) & {(1 << (8 * top)) - 1}")
    parts = counts.select("gram", "n", F.pmod(F.xxhash64(suffix), F.lit(buckets)).cast("int").alias("bucket"))

    def nodes(t: pa.Table) -> pa.Table:
        tree = Tree(t.column("gram").to_numpy(), t.column("n").to_numpy(), depth, top)
        z, o = tree.n[top]
        return pa.table({"key": tree.key[top], "zeros": z, "ones": o, "weighted": tree.weighted[top]})

    level = scratch(parts.groupBy("bucket").applyInArrow(nodes, "key long, zeros double, ones double, weighted double"), "nodes")
    second = _level(level, 2)
    first = _level(second, 1)
    above = []
    for d, table in ((1, first), (0, _level(first, 0))):
        rows = table.toArrow().sort_by("key")
        above.append({"depth": d} | {c: rows.column(c).to_numpy() for c in ("key", "zeros", "ones", "ratio")})
    two = F.expr("(gram >> 8) & 65535").alias("two")
    needed = parts.select(F.col("bucket").alias("at"), two).distinct()
    needed = needed.join(second.withColumn("two", F.shiftright("key", 8)), "two").select("at", "key", "zeros", "ones", "ratio")

    def score(t: pa.Table, near: pa.Table) -> pa.Table:
        gram = t.column("gram").to_numpy()
        tree = Tree(gram, t.column("n").to_numpy(), depth, top)
        p, seen = tree.predict()
        near = near.sort_by("key")
        own = {"depth": 2} | {c: near.column(c).to_numpy() for c in ("key", "zeros", "ones", "ratio")}
        for a in [own, *above]:
            key = (((gram >> 8) & ((1 << (8 * a["depth"])) - 1))[:, None] << 8) | tree.node
            at = np.searchsorted(a["key"], key)
            p, seen = mix(p, seen, a["zeros"][at], a["ones"][at], a["ratio"][at], tree.bit)
        return pa.table({"gram": gram, "n": t.column("n"), "logp": np.log(p).sum(axis=1)})

    return parts.groupBy("bucket").cogroup(needed.groupBy("at")).applyInArrow(score, "gram long, n long, logp double")


class Lookup:
    """A hash table of whole numbers in two arrays, asked for many keys at once."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(key)) * 2))))
        self.key, self.full = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, bool)
        self.value = np.zeros(1 << self.bits)
        at, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = left[~self.full[at[left]]]
            self.key[at[free]] = key[free]  # of several for one slot the last one gets it
            self.full[at[free]] = True
            mine = self.key[at[left]] == key[left]
            self.value[at[left[mine]]] = value[left[mine]]
            left = left[~mine]
            at[left] = (at[left] + 1) & (len(self.key) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        h = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 where a key is missing, and which are there."""
        at = self._slot(key)
        hit = self.full[at] & (self.key[at] == key)
        value = np.where(hit, self.value[at], 0.0)
        todo = np.nonzero(~hit & self.full[at])[0]
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.key) - 1)
            a = at[todo]
            got = self.full[a] & (self.key[a] == key[todo])
            hit[todo[got]] = True
            value[todo[got]] = self.value[a[got]]
            todo = todo[~got & self.full[a]]
        return value, hit


def _word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _counts(rows: DataFrame, depth: int) -> DataFrame:
    """word, key, n: occurrences in the texts to learn from of each word (by its XXH64; the end is the empty word)
    and each gram; grams that only other texts have are there with n = 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, int]] = []
        todo = 0

        def fold() -> None:
            nonlocal key, n, todo
            parts, sums = [key], [n]
            for learn in (0, 1):
                if own := [g for g, w in held if w == learn]:
                    u, c = np.unique(np.concatenate(own), return_counts=True)
                    parts.append(u)
                    sums.append(c * learn)
            merged = np.concatenate(parts)
            key, at = np.unique(merged, return_inverse=True)
            n = np.bincount(at, np.concatenate(sums), len(key)).astype(np.int64)
            held.clear()
            todo = 0

        def rows_of(word: bool, k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), word)), pa.array(k), pa.array(c)], names=["word", "key", "n"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal key, n
            fold()
            if words:
                yield rows_of(True, _word_keys(list(words)), np.fromiter(words.values(), np.int64, len(words)))
            yield rows_of(False, key, n)
            words.clear()
            key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        for b in batches:
            for text, out in zip(texts(b), b.column(0).to_pylist()):
                low = text.lower()
                if not out:
                    words[b""] += 1
                    for w in word_pieces(low):
                        words.update(w)
                for g in grams(low, depth):
                    held.append((g, 0 if out else 1))
                    todo += len(g)
                    if todo > 2 * _PIECE:
                        fold()
                if len(words) > HELD_KEYS or len(key) > 2 * HELD_KEYS:
                    yield from flush()
        yield from flush()

    parts = rows.select("held_out", "text").mapInArrow(each, "word boolean, key long, n long")
    return scratch(parts.groupBy("word", "key").agg(F.sum("n").alias("n")), "counts")


def _frequent(table: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The rows (key, n, x) with the largest n, at most `most`, and whether these are all rows."""
    if table.count() <= most:
        return table, True
    least, upto = None, 0
    for n, c in sorted(((r[0], r[1]) for r in table.groupBy("n").count().toLocalIterator()), reverse=True):
        if upto + c > most:
            break
        least, upto = n, upto + c
    return table.filter(F.lit(False) if least is None else F.col("n") >= least), False


def score_documents(docs: DataFrame, held_out: F.Column | None = None, depth: int = DEPTH) -> DataFrame:
    """One row for each document: contract columns of op5 and bits_per_byte.

    held_out: a boolean column of those not to learn from (null: learned from); by default, as op5 says.
    A null text is empty: one token, the end. Without any training document the base gives log10(1) for
    each token and the model one half for each bit. Repeated rows are learned and scored as often as they
    occur; null doc_ids are learned from. Extra columns are not read. Texts of any length are learned and scored whole, a
    piece at a time. Words are told apart by 64-bit hashes.

    What texts need from the model, word counts and gram probabilities, comes from two tables of at most
    TABLE_KEYS of the most frequent keys, which go to every task. What these lack is listed by text and joined
    with the whole model; its keys are rare ones, so no key of that join is large.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if held_out is None:
        held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    rows = docs.select(F.coalesce(held_out, F.lit(False)).alias("held_out"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    counts = _counts(rows, depth)
    word = counts.filter("word AND n > 0").select("key", "n", F.col("n").cast("double").alias("x"))
    total = word.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    big_n, big_v = int(total[0]), int(total[1])
    gram = counts.filter("NOT word").select(F.col("key").alias("gram"), "n")
    logp = scratch(gram_scores(gram, depth).select(F.col("gram").alias("key"), "n", F.col("logp").alias("x")), "model")
    sent, complete = [], []
    for table in (word, logp):
        some, whole = _frequent(table, TABLE_KEYS)
        got = some.select("key", "x").toArrow()  # at most TABLE_KEYS rows
        sent.append(spark.sparkContext.broadcast((got.column("key").to_numpy(), got.column("x").to_numpy())))
        complete.append(whole)
    denominator = big_n + 1 * (big_v + 1)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, model = (Lookup(*x.value) for x in sent)
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            out: list[tuple] = []
            rest: list[tuple[int, bool, np.ndarray, np.ndarray]] = []
            for held, text, doc in zip(b.column(0).to_pylist(), texts(b), b.column(2).to_pylist()):
                low = text.lower()
                n = n_known = 0
                base = s = 0.0
                for i, w in enumerate(word_pieces(low)):
                    c, hit = known.get(_word_keys(w if i else [b"", *w]))
                    n += len(c)
                    if not complete[0] and not hit.all():
                        k = _word_keys(w if i else [b"", *w])[~hit]
                        rest.append((row, True, *np.unique(k, return_counts=True)))
                        c = c[hit]
                    n_known += int((c > 0).sum())
                    base += float(np.log10((c + 1) / denominator).sum())
                for g in grams(low, depth):
                    x, hit = model.get(g)
                    s += float(x.sum())
                    if not complete[1] and not hit.all():
                        rest.append((row, False, *np.unique(g[~hit], return_counts=True)))
                out.append((row, doc, held, n, n_known, base, s, len(low) + 1))
                row += 1
            m, size = len(out), [len(r[2]) for r in rest]
            k = sum(size)
            pick = lambda i, kind: pa.array([o[i] for o in out] + [None] * k, kind)
            tail = lambda x, kind: pa.concat_arrays([pa.nulls(m, kind), pa.array(x, kind)])
            cat = lambda i: np.concatenate([np.zeros(0, np.int64), *[r[i] for r in rest]])
            ids = pa.array([o[0] for o in out] + np.repeat([r[0] for r in rest], size).tolist(), pa.int64())
            cols = [
                ids, pick(1, pa.int64()), pick(2, pa.bool_()), pick(3, pa.int64()), pick(4, pa.int64()), pick(5, pa.float64()), pick(6, pa.float64()), pick(7, pa.int64()),
                tail(np.repeat(np.array([r[1] for r in rest], bool), size), pa.bool_()), tail(cat(2), pa.int64()), tail(cat(3), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=_PART.replace(" long", "").replace(" boolean", "").replace(" double", "").split(", "))

    part = scratch(rows.mapInArrow(each, _PART), "parts")
    rest = part.filter("word IS NOT NULL").select("row", "word", "key", "times")
    by_word = rest.filter("word").join(word.select("key", "n"), "key", "left").select(
        "row", (F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(denominator)))).alias("b"), F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("k"), F.lit(0.0).alias("s")
    )
    by_gram = rest.filter("NOT word").join(logp.select("key", "x"), "key").select("row", F.lit(0.0).alias("b"), F.lit(0).cast("long").alias("k"), (F.col("times") * F.col("x")).alias("s"))
    more = by_word.unionAll(by_gram).groupBy("row").agg(F.sum("b").alias("mb"), F.sum("k").alias("mk"), F.sum("s").alias("ms"))
    whole = part.filter("word IS NULL").join(more, "row", "left")
    s = F.col("s") + F.coalesce("ms", F.lit(0.0))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("mk", F.lit(0))).alias("n_known"), F.lit(big_n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("mb", F.lit(0.0))).alias("base_score"), (s / float(np.log(10))).alias("score"), (-s / float(np.log(2)) / F.col("size")).alias("bits_per_byte"),
    )


_PART = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, s double, size long, word boolean, key long, times long"


def op5_context_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))
