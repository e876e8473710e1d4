"""SimHash near-duplicates by a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import components, find, read, runs, scratch, small_batches, texts, tiles, word_pieces
from skein.llm.substring import paragraph_links, text_bands

#: Rows of a leaf task; a larger node is divided first by longer masks, then in tiles.
NODE_ROWS = 2048
_ALL = (1 << 31) - 1  # past the last word of any text
_NO_ID = 1 << 62  # nodes from here on stand for fingerprints without any doc_id


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text: a bit is 1 if set in over half the shingles' XXH64. No words: 0.

    Fewer words than a shingle has: the whole sequence is the one shingle. Long texts go in pieces.
    """
    ones, n, tail = np.zeros(64, dtype=np.int64), 0, []
    seen_words = 0
    for piece in word_pieces(text.lower()):
        seen_words += len(piece)
        w = tail + piece
        if len(w) >= words:
            got = map(b" ".join, zip(*(w[i:] for i in range(words))))
            h = np.fromiter(map(xxhash.xxh64_intdigest, got, repeat(seed)), np.uint64, len(w) - words + 1)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            n += len(h)
        tail = w[len(w) - min(words - 1, len(w)) :]
    if not n and seen_words:
        return xxhash.xxh64_intdigest(b" ".join(tail), seed)
    return int(sum(1 << i for i in np.nonzero(2 * ones > n)[0].tolist()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long). A null text is an empty one."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in texts(b)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _split(free: list[int]) -> list[list[int]]:
    """Four blocks of the free bits: words that differ in at most three bits agree on one block."""
    return [[int(i) for i in part] for part in np.array_split(np.array(free), 4)]


def upper_masks() -> tuple[list[int], dict[int, list[int]]]:
    """Masks of the index's upper nodes: four of 16 bits; under each, four of 12 more bits."""
    signed = lambda bits: int(np.array([sum(1 << i for i in bits)], dtype=np.uint64).view(np.int64)[0])
    first, below = [], {}
    for block in _split(list(range(63, -1, -1))):
        m = signed(block)
        first.append(m)
        free = [i for i in range(63, -1, -1) if i not in block]
        below[m] = [signed(block + sub) for sub in _split(free)]
    return first, below


class GrayIndex:
    """Fingerprints in Gray order under nodes that hold the bits all below them share.

    Level 0 has leaves of 32 neighbours; each level above joins eight nodes. A pair of nodes is left
    when the differing shared bits, added up from the top, exceed the limit, or when all below both
    are linked already.
    """

    LEAF, FAN = 32, 8

    def __init__(self, x: np.ndarray, limit: int):
        self.order = np.argsort(gray_rank(x), kind="stable")
        self.x, self.limit = x[self.order], limit
        self.parent = list(range(len(x)))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.arange(0, len(x), self.LEAF)
        a, o = np.bitwise_and.reduceat(self.x, at), np.bitwise_or.reduceat(self.x, at)
        self.levels.append((a, o))
        while len(a) > 1:
            at = np.arange(0, len(a), self.FAN)
            a, o = np.bitwise_and.reduceat(a, at), np.bitwise_or.reduceat(o, at)
            self.levels.append((a, o))

    def _root(self, level: int, k: int) -> int:
        """The root that all below a node have, or -1."""
        width = self.LEAF * self.FAN**level
        first = find(self.parent, k * width)
        return first if all(find(self.parent, i) == first for i in range(k * width + 1, min(len(self.x), (k + 1) * width))) else -1

    def link(self, part: np.ndarray | None = None) -> list[tuple[int, int]]:
        """A spanning forest of the links, as places in the input; with part, of links across two parts only."""
        part = None if part is None else part[self.order]
        found: list[tuple[int, int]] = []
        todo = [(len(self.levels) - 1, 0, 0)]
        while todo:
            level, i, j = todo.pop()
            a, o = self.levels[level]
            shared = ~(a[i] ^ o[i]) & ~(a[j] ^ o[j])
            if int(np.bitwise_count((a[i] ^ a[j]) & shared)) > self.limit:
                continue
            if level == 0 and i != j or level and i != j and level < 3:
                r = self._root(level, i)
                if r >= 0 and r == self._root(level, j):
                    continue
            if level:
                kids = len(self.levels[level - 1][0])
                left = range(i * self.FAN, min(kids, (i + 1) * self.FAN))
                right = range(j * self.FAN, min(kids, (j + 1) * self.FAN))
                todo += [(level - 1, p, q) for p in reversed(left) for q in reversed(right) if p <= q]
                continue
            si, sj = slice(i * self.LEAF, (i + 1) * self.LEAF), slice(j * self.LEAF, (j + 1) * self.LEAF)
            near = np.bitwise_count(self.x[si][:, None] ^ self.x[sj][None, :]) <= self.limit
            if part is not None:
                near &= part[si][:, None] != part[sj][None, :]
            for p, q in zip(*np.nonzero(near)):
                u, v = int(p) + i * self.LEAF, int(q) + j * self.LEAF
                if u < v and (ru := find(self.parent, u)) != (rv := find(self.parent, v)):
                    self.parent[max(ru, rv)] = min(ru, rv)
                    found.append((int(self.order[u]), int(self.order[v])))
        return found


def links(fps: DataFrame, limit: int = 3) -> DataFrame:
    """a, b: links that connect whatever distinct fingerprints (node long, fp long) reach each other.

    The shared patterns under `upper_masks` are the index's upper nodes and the unit of work: two
    fingerprints within three bits agree on at least one mask of each level. A node of over
    NODE_ROWS fingerprints is divided by the longer masks below it; what is still larger goes in
    tiles. Inside a task the fingerprints stand in Gray order under a GrayIndex.
    """
    if limit > 3:
        raise ValueError("the upper masks are made for at most three differing bits")
    first, below = upper_masks()
    masked = lambda masks: F.explode(F.array(*[F.lit(m) for m in masks]))
    top = fps.withColumn("mask", masked(first)).withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
    size = top.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    top = top.join(size, ["mask", "pattern"])
    deeper = F.lit(None).cast("array<bigint>")
    for m in first:
        deeper = F.when(F.col("mask") == m, F.array(*[F.lit(x) for x in below[m]])).otherwise(deeper)
    top = top.withColumn("mask", F.explode(F.when(F.col("n") > NODE_ROWS, deeper).otherwise(F.array("mask"))))
    top = top.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask"))).drop("n")
    keys = ["mask", "pattern"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, s in runs(batches, [*keys, "lo", "hi"]):
            x, node = t.column("fp").to_numpy().view(np.uint64), t.column("node").to_numpy()
            part, cross = t.column("part").to_numpy(), t.column("lo").to_numpy() != t.column("hi").to_numpy()
            length = np.diff(s)
            group = np.repeat(np.arange(len(length)), length)
            little = np.repeat(length <= 32, length)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d in range(1, 32):  # small groups: all pairs at once, by their distance in the table
                if d >= len(x):
                    break
                same = (group[d:] == group[:-d]) & little[d:]
                if not same.any():
                    break
                same &= (np.bitwise_count(x[d:] ^ x[:-d]) <= limit) & (~cross[d:] | (part[d:] != part[:-d]))
                i = np.nonzero(same)[0]
                a.append(node[i])
                b.append(node[i + d])
            for g in np.nonzero(length > 32)[0]:
                o, e = int(s[g]), int(s[g + 1])
                got = GrayIndex(x[o:e], limit).link(part[o:e] if cross[o] else None)
                a.append(node[[o + i for i, _ in got]] if got else a[0])
                b.append(node[[o + j for _, j in got]] if got else b[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return tiles(top, keys, "fp", NODE_ROWS).mapInArrow(each, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each document.

    Documents whose fingerprints differ in at most three bits are linked; component_id is the smallest
    doc_id reachable. Null and empty texts have fingerprint zero and link like others. A null doc_id
    keeps its row; if a component has no doc_id at all, its component_id is null. Repeated rows stay
    repeated. An empty table gives an empty one. Extra columns are not read.
    """
    fp = scratch(fingerprints(docs), "fp")
    one = fp.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(_NO_ID) + F.col("fp").bitwiseAND((1 << 61) - 1)).alias("node"))
    one = scratch(one, "distinct")
    comp = components(links(one), "a", "b")
    label = one.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    known = F.when(F.col("component_id") < _NO_ID, F.col("component_id"))
    return fp.join(label, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), known.alias("component_id")
    )


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents with one of each group of near duplicates kept: that with the smallest doc_id.

    Near duplicates are texts whose fingerprints differ in at most three bits, or whose sets of five-word shingles
    have a Jaccard similarity of 0.8 or more, and what is linked over them. It is the texts that are compared, so
    of rows with one doc_id only those near another text go. Of repeated rows of the kept text one stays. Rows with
    a null doc_id have no name to go by and stay.
    """
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = texts(b)
            fp = np.array([fingerprint(t) for t in raw], dtype=np.uint64).view(np.int64)
            bands = [None if x is None else x.view(np.int64) for x in (text_bands(t.lower()) for t in raw)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "fp", "bands"])

    named = docs.filter("doc_id IS NOT NULL")
    at = named.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    at = scratch(at.mapInArrow(each, "doc_id long, key long, fp long, bands array<long>"), "texts")
    whole = at.filter("bands IS NOT NULL").select(F.col("key").alias("unit"), "doc_id", "key", F.lit(0).alias("start"), F.lit(_ALL).alias("stop"), "bands")
    of = at.select("key", "fp").distinct()
    similar = paragraph_links(named, whole).join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    comp = components(links(at.select("fp", F.col("fp").alias("node")).distinct()).unionAll(similar), "a", "b")
    group = at.join(comp.withColumnRenamed("node", "fp"), "fp", "left").groupBy(F.coalesce("component", "fp").alias("component"))
    kept = group.agg(F.min(F.struct("doc_id", "key")).alias("k")).select(F.col("k.doc_id").alias("_skein_id"), F.col("k.key").alias("_skein_key"))
    rows = named.join(kept, (named["doc_id"].cast("long") == F.col("_skein_id")) & (F.xxhash64(named["text"]) == F.col("_skein_key")))
    return rows.dropDuplicates(["_skein_id", "_skein_key"]).select(docs.columns).unionAll(docs.filter("doc_id IS NULL"))
