"""Packing: length buckets chosen by dynamic programming over the global histogram, token-budget batches inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import WORD, read, scratch

BUCKETS = 16
TOKEN_BUDGET = 65_536
#: Parts in which the rows of a bucket are numbered: a table of BUCKETS * PARTS counts joins them up.
PARTS = 4_096


def boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least padding in all.

    histogram: (length, documents), any order. A bucket pads its documents to its largest length. The
    cost of (i, j] is length[j] * (documents in it), so each layer of the programme is a lower envelope
    of lines with falling slopes asked at rising lengths: linear time, in exact integers.
    """
    rows = sorted((int(n), int(c)) for n, c in histogram if c)
    if not rows:
        return []
    length = [n for n, _ in rows]
    upto = [0]
    for _, c in rows:
        upto.append(upto[-1] + c)
    m = len(rows)
    best = [length[j] * upto[j + 1] for j in range(m)]  # one bucket over rows 0..j
    back = [[0] * m]
    for layer in range(1, min(buckets, m)):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, first row of the last bucket
        head, new, frm = 0, [0] * m, [0] * m
        for j in range(m):
            if j >= layer:  # the last bucket may start at row j
                k, c = -upto[j], best[j - 1]
                while len(hull) - head >= 2:
                    (k1, c1, _), (k2, c2, _) = hull[-2], hull[-1]
                    if (c - c1) * (k1 - k2) <= (c2 - c1) * (k1 - k):
                        hull.pop()
                    else:
                        break
                hull.append((k, c, j))
            if j < layer:
                new[j], frm[j] = best[j], back[-1][j]
                continue
            x = length[j]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            k, c, i = hull[head]
            new[j], frm[j] = x * upto[j + 1] + k * x + c, i
        best = new
        back.append(frm)
    out, j, layer = [], m - 1, len(back) - 1
    while j >= 0:
        out.append(length[j])
        i = back[layer][j]
        if i == 0:
            break
        j, layer = i - 1, layer - 1
    return out[::-1]


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, batch, slot for rows (doc_id, n_tokens): each row in one slot of one batch.

    bucket is the length its rows are padded to. A batch holds floor(budget / bucket) rows, at least one, so
    its padded tokens stay within the budget unless a single row exceeds it; all batches of a bucket are full
    but for the last. Rows of length 0 have the bucket 0 of their own, with `budget` rows in a batch. Null
    doc_ids and repeated rows get slots like any others. The histogram has at most sqrt(2 * all tokens)
    distinct lengths, which bounds what the driver holds.
    """
    rows = scratch(lengths.select("doc_id", "n_tokens"), "lengths")
    histogram = [(r[0], r[1]) for r in rows.filter("n_tokens > 0").groupBy("n_tokens").count().toLocalIterator()]
    bounds = [0, *boundaries(histogram, buckets)]
    bucket = F.lit(bounds[-1])
    for b in reversed(bounds[:-1]):
        bucket = F.when(F.col("n_tokens") <= b, b).otherwise(bucket)
    rows = rows.withColumn("bucket", bucket.cast("long")).withColumn("part", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(PARTS)).cast("int"))
    count = rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("bucket").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offset = count.select("bucket", "part", before.alias("before"))  # at most (buckets + 1) * PARTS rows
    place = F.row_number().over(W.partitionBy("bucket", "part").orderBy(F.col("doc_id").asc_nulls_last())) - 1
    rows = rows.withColumn("place", place).join(F.broadcast(offset), ["bucket", "part"])
    room = F.when(F.col("bucket") > 0, F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket")))).otherwise(F.lit(budget))
    at = F.col("place") + F.col("before")
    return rows.select(
        "doc_id", "n_tokens", "bucket", F.floor(at / room).cast("long").alias("batch"), (at % room).cast("long").alias("slot")
    )


def word_lengths(docs: DataFrame) -> DataFrame:
    """doc_id and the words of its text (null: none)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))


def op1_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(word_lengths(read(spark, sf_dir, "documents")))
