"""Substring dedup: paragraph MinHash banding with exact Jaccard, and repeated passages inside paragraphs.

Two kinds of unit, so that a passage is caught whether it stands as a paragraph or inside one:
paragraphs (lines), compared by word-shingle Jaccard; and every run of MIN_WORDS words of the running
text, compared for equality. Neighbouring runs that share their least seed are one row until a seed is
found in two documents, so that not every word makes a row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import components, discard, find, read, runs, scratch, small_batches, texts, tiles

SHINGLE, SIMILARITY = 5, 0.8
#: A passage repeated inside paragraphs counts from so many words on.
MIN_WORDS = 20
#: Share of the pairs just at SIMILARITY that are to meet in a band of ROWS rows.
RECALL, ROWS = 0.997, 2


def bands_for(similarity: float, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands in which a pair of this similarity meets at least once with a probability of `recall`."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


BANDS = bands_for(SIMILARITY)
#: Words of a seed. Equal runs of MIN_WORDS words have equal seeds, and so the same least seed.
SEED = 6
#: Paragraphs of one band in a task.
GROUP_ROWS = 1024
#: Bytes of a text whose words are split at a time, words of a text that are worked on at a time, and words from which on
#: no further text joins those that are worked on together; none changes a result.
SECTION, BLOCK, GATHER = 1 << 20, 1 << 18, 1 << 14

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SALT = np.array([xxhash.xxh64_intdigest(str(i), 7) for i in range(BANDS * ROWS)], dtype=np.uint64)
_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def _mix(h: np.ndarray) -> np.ndarray:
    out = h >> np.uint64(31)
    out ^= h
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def _windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` word hashes, in order; put together from runs of 1, 2, 4, ... words."""
    n = len(h) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out, done, part, size = np.zeros(n, np.uint64), 0, h, 1
    while True:
        power = np.uint64(pow(int(_P), size, 1 << 64))
        if width & size:
            out *= power
            out += part[done : done + n]
            done += size
        if done == width:
            return _mix(out)
        part = part[:-size] * power + part[size:]
        size *= 2


def sections(text: bytes) -> Iterator[bytes]:
    """A text in sections of about SECTION bytes that join up to the whole text again."""
    at = 0
    while at < len(text):
        end = min(at + SECTION, len(text))
        if end < len(text):
            nl = text.rfind(b"\n", at, end)
            if nl > at:
                end = nl + 1
            elif m := _BREAK.search(text, end):
                end = m.end()
            else:
                end = len(text)
        yield text[at:end]
        at = end


def read_words(low: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of a lower-cased text: the hashes of its words, and where its lines end (in words)."""
    hashes, ends, n = [np.zeros(0, np.uint64)], [], 0
    for part in sections(low):
        lines = [x.split() for x in part.split(b"\n")]
        size = np.cumsum([len(x) for x in lines], dtype=np.int64)
        ends.append(n + size[:-1])  # the last line may go on in the next section
        hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(lines)), np.uint64, size[-1]))
        n += len(hashes[-1])
    return np.concatenate(hashes), np.concatenate([*ends, [n]]).astype(np.int64)


def stretches(h: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, stop, text and seed of the stretches of texts that stand one after the other, each between two borders.

    A stretch is a sequence of neighbouring runs of MIN_WORDS words of a text that have the same least seed; the last
    one ends with the text."""
    least, width, whole = _windows(h, SEED), 1, MIN_WORDS - SEED + 1
    while width < whole:
        step = min(width, whole - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    text = np.repeat(np.arange(len(borders) - 1), np.diff(borders))[: len(least)]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    starts = np.nonzero(new & (np.arange(MIN_WORDS, len(least) + MIN_WORDS) <= borders[text + 1]))[0]
    text = text[starts]
    goes_on = np.append(text[1:] == text[:-1], False)[: len(text)]
    stops = np.where(goes_on, np.append(starts[1:], 0)[: len(text)] + MIN_WORDS - 1, borders[text + 1])
    return starts, stops, text, least[starts]


def _bands(least: np.ndarray) -> np.ndarray:
    """The bands of MinHash values (..., BANDS * ROWS)."""
    return _mix(least[..., 0::ROWS] * _P + least[..., 1::ROWS] + np.arange(BANDS, dtype=np.uint64))


def _minima(h: np.ndarray) -> np.ndarray:
    """The MinHash values of a run of words of any length, some of its shingles at a time."""
    out = np.full(len(_SALT), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(h) - SHINGLE + 1, BLOCK):
        sh = _windows(h[at : at + BLOCK + SHINGLE - 1], SHINGLE)
        out = np.minimum(out, [_mix(sh ^ c).min() for c in _SALT])
    return out


def text_units(lows: Iterable[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """text (its number), start, stop, unit, span and bands of the texts' stretches (bands None) and of their lines from
    SHINGLE words on.

    Every run of MIN_WORDS words is in one stretch; a stretch that a block's end divides is two with one seed. Texts of up
    to BLOCK words are worked on together, as an array operation costs more than the few hundred words of most texts.
    """
    held, n = [], 0
    for i, low in enumerate(lows):
        h, ends = read_words(low)
        if len(h) > BLOCK:
            for part in _long_units(h, ends):
                yield np.full(len(part[0]), i), *part
            continue
        held.append((i, h, ends))
        n += len(h)
        if n >= GATHER:
            yield from _gathered_units(held)
            held, n = [], 0
    if n:
        yield from _gathered_units(held)


def _gathered_units(held: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
    number, h = np.array([x[0] for x in held]), np.concatenate([x[1] for x in held])
    borders = np.concatenate([[0], np.cumsum([len(x[1]) for x in held])])
    s, e, text, seed = stretches(h, borders)
    ends = np.concatenate([x[2] + at for x, at in zip(held, borders.tolist())])
    of = np.repeat(np.arange(len(held)), [len(x[2]) for x in held])
    first = np.append(0, ends[:-1])  # a text ends with a line, so the next one's first line starts there
    keep = ends - first >= SHINGLE
    ls, le, of = first[keep], ends[keep], of[keep]
    span = _span_hash(h, np.append(s, ls), np.append(e, le))
    if len(s):
        yield number[text], s - borders[text], e - borders[text], seed, span[: len(s)], None
    if len(ls):
        yield number[of], ls - borders[of], le - borders[of], span[len(s) :], span[len(s) :], _bands(_line_minima(h, ls, le))


def _long_units(h: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The units of one text, BLOCK words at a time."""
    for at in range(0, len(h) - MIN_WORDS + 1, BLOCK):
        part = h[at : at + BLOCK + MIN_WORDS - 1]
        s, e, _, seed = stretches(part, np.array([0, len(part)]))
        yield s + at, e + at, seed, _span_hash(part, s, e), None
    first = np.concatenate([[0], ends[:-1]])
    keep = ends - first >= SHINGLE
    ls, le = first[keep], ends[keep]
    i = 0
    while i < len(ls):
        j = max(i + 1, int(np.searchsorted(le, ls[i] + BLOCK, side="right")))
        s, e = ls[i:j], le[i:j]
        if j == i + 1:
            least, unit = _minima(h[s[0] : e[0]])[None, :], _long_hash(h[s[0] : e[0]])
        else:
            part, lo = h[s[0] : e[-1]], s[0]
            least, unit = _line_minima(part, s - lo, e - lo), _span_hash(part, s - lo, e - lo)
        yield s, e, unit, unit, _bands(least)
        i = j


def _line_minima(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The MinHash values of lines of at least SHINGLE words, in order."""
    sh = _windows(h, SHINGLE)
    at = np.stack([start, end - SHINGLE + 1], axis=1).ravel()
    at = at[:-1] if at[-1] >= len(sh) else at
    return np.stack([np.minimum.reduceat(_mix(sh ^ c), at)[::2] for c in _SALT], axis=1)


@lru_cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(n, _P)), np.cumprod(np.full(n, _P_INV))


def _span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the word sequence of each span."""
    power, inverse = _powers(1 << max(14, len(h).bit_length()))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    return _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def _long_hash(h: np.ndarray) -> np.ndarray:
    """What `_span_hash` gives for all words of h, some of them at a time."""
    total, power = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), BLOCK):
            p = power * np.cumprod(np.full(len(h[at : at + BLOCK]), _P))
            total, power = total + (h[at : at + BLOCK] * p).sum(), p[-1]
        return _mix(np.array([total * _P_INV + np.uint64(len(h))], np.uint64))


def _hashed(part: bytes) -> np.ndarray:
    words = part.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def word_hashes(low: bytes) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *map(_hashed, sections(low))])


def text_bands(low: bytes) -> np.ndarray | None:
    """The MinHash bands of a whole text; None if it has no shingle."""
    h = word_hashes(low)
    return _bands(_minima(h)) if len(h) >= SHINGLE else None


_UNIT = "key long, doc_id long, start int, stop int, line boolean, unit long, span long, bands array<long>"
#: Units that a task hands on at a time.
_UNITS = 1 << 20


def units(docs: DataFrame) -> DataFrame:
    """A row for each paragraph of at least SHINGLE words and each stretch of runs of MIN_WORDS words.

    key tells texts of one doc_id apart; start and stop count words in the text. unit is the hash of a
    paragraph's words or the seed of a stretch, whose words have the hash span (null for a paragraph); bands
    has the MinHash bands of a paragraph and is empty for a stretch. Rows with a null doc_id or text have no units.
    """
    small_batches(docs.sparkSession)

    def batch(keys: np.ndarray, ids: np.ndarray, out: list[tuple]) -> pa.RecordBatch:
        row, line = np.concatenate([x[0] for x in out]), np.repeat([x[5] is not None for x in out], [len(x[1]) for x in out])
        flat = np.concatenate([x[5].ravel() for x in out if x[5] is not None] or [np.zeros(0, np.uint64)])
        offsets = np.concatenate([[0], np.cumsum(line * BANDS)]).astype(np.int32)
        cat = lambda i, kind: np.concatenate([x[i] for x in out]).astype(kind, copy=False)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys[row]), pa.array(ids[row]), pa.array(cat(1, np.int32)), pa.array(cat(2, np.int32)), pa.array(line), pa.array(cat(3, np.uint64).view(np.int64)),
                pa.array(cat(4, np.uint64).view(np.int64), mask=line), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64))),
            ],
            names=["key", "doc_id", "start", "stop", "line", "unit", "span", "bands"],
        )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            out, n = [], 0
            for part in text_units(t.lower() for t in texts(b)):
                out.append(part)
                n += len(part[0])
                if n > _UNITS:
                    yield batch(keys, ids, out)
                    out, n = [], 0
            if out:
                yield batch(keys, ids, out)

    named = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return named.select(F.xxhash64("text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, _UNIT)


def fields(lists: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a column of lists of structs without nulls: the lists' lengths, and each field over all lists."""
    return np.diff(lists.offsets.to_numpy()), [x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten()]


def each_of(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers from start to before stop, of one range after the other."""
    n = (stop - start).astype(np.int64)
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


def paragraph_links(docs: DataFrame, lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b: links between distinct paragraphs (by unit) whose shingle sets have Jaccard >= similarity.

    Within a band all pairs are compared that are not linked yet, so that whatever reaches each other
    over colliding paragraphs is connected by the links returned.
    """
    banded = lines.select("unit", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("unit").alias("x"), F.max("unit").alias("y")).filter("x <> y").select("band")
    met = scratch(banded.distinct().join(shared, "band"), "bands")
    place = lines.groupBy("unit").agg(F.min(F.struct("doc_id", "key", "start", "stop")).alias("p"))
    wanted = place.join(met.select("unit").distinct(), "unit").select("unit", "p.*")
    wanted = wanted.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "stop", "unit")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, (start, stop, unit) = fields(b.column(1))
            sets, i = [], 0
            for text, n in zip(texts(b), size.tolist()):
                sh = _windows(word_hashes(text.lower()), SHINGLE)
                for s, e in zip(start[i : i + n].tolist(), stop[i : i + n].tolist()):
                    sets.append(np.unique(sh[s : e - SHINGLE + 1]).tobytes())
                i += n
            yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(sets, pa.binary())], names=["unit", "shingles"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key")).dropDuplicates(["doc_id", "key"])
    sets = scratch(source.join(wanted, ["doc_id", "key"]).select("text", "spans").mapInArrow(cut, "unit long, shingles binary"), "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, ["band", "lo", "hi"]):
            unit = t.column("unit").to_numpy()
            part, cross = t.column("part").to_numpy(), t.column("lo").to_numpy() != t.column("hi").to_numpy()
            raw = t.column("shingles").to_pylist()
            a, b = [], []
            for o, e in zip(at[:-1].tolist(), at[1:].tolist()):
                got = [np.frombuffer(x, np.uint64) for x in raw[o:e]]
                order = sorted(range(e - o), key=lambda i: len(got[i]))
                parent = list(range(e - o))
                for n, i in enumerate(order):
                    for j in order[n + 1 :]:
                        if len(got[i]) < similarity * len(got[j]):
                            break
                        if cross[o] and part[o + i] == part[o + j] or (ri := find(parent, i)) == (rj := find(parent, j)):
                            continue
                        common = len(np.intersect1d(got[i], got[j], assume_unique=True))
                        if common >= similarity * (len(got[i]) + len(got[j]) - common) - 1e-9:
                            parent[ri] = rj
                            a.append(unit[o + i])
                            b.append(unit[o + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found = scratch(tiles(met.join(sets, "unit"), ["band"], "unit", GROUP_ROWS).mapInArrow(verify, "a long, b long"), "similar")
    discard(met, sets)
    return found


def passages(docs: DataFrame, stretches: DataFrame) -> DataFrame:
    """key, doc_id, start, stop, kept_doc_id: all runs of MIN_WORDS words that a smaller doc_id has, in stretches.

    Equal stretches are settled as a whole. Where a seed has different stretches, the runs of the first
    document of each are compared one by one; the first document with a run is the first with its stretch.
    """
    shared = stretches.groupBy("unit").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("span") != F.max("span")).alias("mixed")).filter("lo <> hi")
    shared = scratch(stretches.join(shared.select("unit", "mixed"), "unit"), "shared")
    first = shared.groupBy("unit", "span").agg(F.min("doc_id").alias("kept_doc_id"))
    met = scratch(shared.join(first, ["unit", "span"]).filter("mixed OR doc_id <> kept_doc_id").drop("unit", "span", "mixed"), "met")
    discard(shared)
    whole = met.filter("doc_id <> kept_doc_id").select("key", "doc_id", "start", "stop", "kept_doc_id")
    wanted = met.filter("doc_id = kept_doc_id").groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids = b.column(1).to_numpy(), b.column(2).to_numpy()
            size, (start, stop) = fields(b.column(3))
            rows, starts, found, n, i = [], [], [], 0, 0
            for row, (text, k) in enumerate(zip(texts(b), size.tolist())):
                at = each_of(start[i : i + k], stop[i : i + k] - MIN_WORDS + 1)  # no run is in two stretches
                found.append(_windows(word_hashes(text.lower()), MIN_WORDS)[at])
                rows.append(np.full(len(at), row))
                starts.append(at)
                n, i = n + len(at), i + k
                if n > _UNITS or row == b.num_rows - 1:
                    of = np.concatenate(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[of]), pa.array(ids[of]), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(found).view(np.int64))],
                        names=["key", "doc_id", "start", "run"],
                    )
                    rows, starts, found, n = [], [], [], 0

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key")).dropDuplicates(["doc_id", "key"])
    found = source.join(wanted, ["doc_id", "key"]).select("text", "key", "doc_id", "spans").mapInArrow(each, "key long, doc_id long, start int, run long")
    found = scratch(found, "runs")
    first = found.groupBy("run").agg(F.min("doc_id").alias("kept_doc_id"), F.max("doc_id").alias("most")).filter("kept_doc_id <> most")
    single = found.join(first.select("run", "kept_doc_id"), "run").filter("doc_id <> kept_doc_id")
    out = scratch(whole.unionAll(single.select("key", "doc_id", "start", (F.col("start") + MIN_WORDS).alias("stop"), "kept_doc_id")), "passages")
    discard(met, found)
    return out


def repeats(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """key, doc_id, start, stop, kept_doc_id, paragraph: the passages to remove, by their words.

    Paragraphs are clustered by components of equal or similar ones. Of a cluster that is in more than one
    document the document with the smallest doc_id keeps what it has; every other occurrence is listed.
    Inside paragraphs and across them all is listed, word by word, that is in a run of MIN_WORDS words or more
    which a document with a smaller doc_id has too.
    """
    u = scratch(units(docs), "units")
    lines = u.filter("line")
    comp = components(paragraph_links(docs, lines, similarity), "a", "b")
    spread = lines.groupBy("unit").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    spread = spread.join(comp.withColumnRenamed("node", "unit"), "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    cluster = spread.groupBy("component").agg(F.min("least").alias("kept_doc_id"), F.max("most").alias("most")).filter("kept_doc_id <> most")
    marked = spread.join(cluster.select("component", "kept_doc_id"), "component").select("unit", "kept_doc_id")
    columns = ["key", "doc_id", "start", "stop", "kept_doc_id"]
    found = scratch(lines.drop("bands").join(marked, "unit").filter("doc_id <> kept_doc_id").select(*columns, F.lit(True).alias("line")), "lines")
    found = found.unionAll(passages(docs, u.filter("NOT line").drop("line", "bands")).select(*columns, F.lit(False).alias("line")))
    discard(u)
    per = found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "stop", "line", "kept_doc_id")).alias("s"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, (start, stop, line, kept) = fields(b.column(2))
            row = np.repeat(np.arange(b.num_rows), size)
            line = line.astype(bool)
            runs = merged(*(x[~line] for x in (row, start, stop, kept)))
            row, start, stop, kept = (np.concatenate([x[line], y]) for x, y in zip((row, start, stop, kept), runs))
            columns = [pa.array(b.column(i).to_numpy()[row]) for i in (1, 0)] + [pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(kept)]
            columns.append(pa.array(np.arange(len(row)) < line.sum()))
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "start", "stop", "kept_doc_id", "paragraph"])

    return per.select("doc_id", "key", "s").mapInArrow(each, "key long, doc_id long, start int, stop int, kept_doc_id long, paragraph boolean")


def merged(row: np.ndarray, start: np.ndarray, stop: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of rows (texts) as spans without a common word, in order.

    By start, the longer and then that of the smaller `kept` first, a span keeps what no span before it has; what so
    follows on, or overlaps, with the same `kept` is one span."""
    order = np.lexsort((kept, -stop, start, row))
    row, start, stop, kept = (x[order].astype(np.int64) for x in (row, start, stop, kept))
    reach = np.maximum.accumulate(row << 32 | stop)
    before = np.append(-1, reach[:-1])[: len(row)]
    before = np.where(before >> 32 == row, before & 0xFFFFFFFF, -1)  # how far the spans before it in the text reach
    more = stop > before
    row, start, stop, kept, before = (x[more] for x in (row, start, stop, kept, before))
    new = np.ones(len(row), bool)
    new[1:] = (start[1:] > before[1:]) | (kept[1:] != kept[:-1])
    last = np.append(new[1:], True)[: len(row)]
    return row[new], np.maximum(start, before)[new], stop[last], kept[new]


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans (start, stop) and the white space after them."""
    whole: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if whole and s <= whole[-1][1]:
            whole[-1] = (whole[-1][0], max(e, whole[-1][1]))
        else:
            whole.append((s, e))
    out, n, i = [], 0, 0
    for part in sections(text):
        blank = _BLANK[np.frombuffer(part, np.uint8)]
        at = np.append(np.nonzero(~blank & np.append(True, blank[:-1]))[0], len(part)).tolist()
        upto, done = n + len(at) - 1, 0
        while i < len(whole) and whole[i][0] < upto:
            s, e = whole[i]
            out.append(part[done : at[s - n] if s >= n else 0])
            done = at[min(e, upto) - n]
            if e >= upto:  # goes on in the next section, if only with the white space there
                break
            i += 1
        out.append(part[done:])
        n = upto
    return b"".join(out)


def remove_repeats(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with the columns they have, repeated passages cut out of `text`.

    n_chars, if there is such a column, is counted anew where the text changed. A document of which
    nothing but white space is left goes; documents without repeats are as they were, also null or
    empty ones. A null doc_id takes no part. Repeated rows of one doc_id lose the same passages. Texts of any length
    are compared whole; other columns may have any names.
    """
    small_batches(docs.sparkSession)
    found = scratch(repeats(docs, similarity), "repeats")  # else its Python workers and those of cut would stand side by side in each task
    spans = found.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("_skein_id"), F.col("key").alias("_skein_key"), F.col("spans").alias("_skein_spans"))

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, lambda t, s: without(t.encode(), [(x["start"], x["stop"]) for x in s]).decode())

    joined = docs.join(spans, (docs["doc_id"].cast("long") == F.col("_skein_id")) & (F.xxhash64(docs["text"]) == F.col("_skein_key")), "left")
    whole = joined.filter("_skein_spans IS NULL").select(docs.columns)
    changed = joined.filter("_skein_spans IS NOT NULL").withColumn("text", cut("text", "_skein_spans")).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(changed.select(docs.columns))


def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each passage that goes: where it is and the document that keeps it."""
    found = repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "kept_doc_id", "paragraph", F.col("start").alias("start_word"), (F.col("stop") - F.col("start")).alias("n_words"))
