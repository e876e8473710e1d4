"""Exact top-k inner products by MaxScore over shards of the vectors."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import discard, read, scratch, small_batches

SHARD_ROWS, QUERY_ROWS = 4096, 512
#: Bytes of queries that go to every task at a time.
QUERY_BYTES = 32 << 20
#: Dimensions that are probed together before the competitors are weighed again.
PROBE = 8
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def usable(rows: DataFrame) -> DataFrame:
    """The rows whose vector is there and has finite components only; an empty one has."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(ok)


class Shard:
    """Vectors of a shard as postings by dimension, with each dimension's bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.columns = ids, np.ascontiguousarray(vectors.T)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)

    def search(self, query: np.ndarray, own: int, k: int, threshold: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, of all rows but those with the id `own`.

        threshold: a score below which nothing matters, from k rows of other shards. A dimension gives each row its
        least contribution and something on top, at most its bound. In falling order of bounds, the terms are
        essential while those after them could still lift a row that has nothing on top of the least into the
        result: their postings are traversed for every row. The others are probed, a few at a time, only for rows
        that can still compete.
        """
        if self.columns.dtype == object or not len(self.columns):
            return self._all(query, own, k)
        a, b = query * self.low, query * self.high
        least, bound = np.minimum(a, b), np.abs(b - a)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)
        floor, fixed = least.sum(), least[bound == 0].sum()
        rivals = np.nonzero(self.ids != own)[0]
        score = query @ self.columns[:, rivals[: 16 * k]]
        if len(score) >= k:
            kth = np.partition(score, len(score) - k)[len(score) - k]
            threshold = kth if threshold is None else max(threshold, kth)
        essential = len(order) if threshold is None else int(np.searchsorted(-(floor + rest), -threshold, side="right"))
        head = order[: min(essential, len(order))]
        part = (query[head] @ self.columns[head])[rivals] + fixed
        at = len(head)
        ahead = np.append(np.cumsum(least[order][::-1])[::-1], 0)  # least that the terms from here give
        while threshold is not None:
            keep = part + (ahead[at] + rest[at]) >= threshold
            rivals, part = rivals[keep], part[keep]
            if at >= len(order):
                break
            more = order[at : at + PROBE]
            part = part + query[more] @ self.columns[more][:, rivals]
            at = min(at + PROBE, len(order))
            if len(part) > k:
                sure = part + ahead[at]
                threshold = max(threshold, np.partition(sure, len(sure) - k)[len(sure) - k])
        best = np.lexsort((self.ids[rivals], -part))[:k]
        return [(int(part[i]), int(self.ids[rivals[i]])) for i in best]

    def _all(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The same without bounds, for numbers whose bounds are no doubles, and for vectors without components."""
        score = [min(_MOST, max(_LEAST, int(x))) for x in query @ self.columns] if len(query) else [0] * len(self.ids)
        return sorted(((s, i) for s, i in zip(score, self.ids.tolist()) if i != own), key=lambda x: (-x[0], x[1]))[:k]


def whole_numbers(vectors: np.ndarray, other: float | None = None) -> np.ndarray:
    """floor(256 * x) in doubles; Python integers where sums of products with components of at most `other` (by default
    the vectors' own most) might not be exact otherwise."""
    with np.errstate(over="ignore"):
        v = np.floor(256 * vectors)
    most = float(np.abs(v).max(initial=0))
    if v.size and v.shape[-1] * most * max(most, other or 0) >= 2.0**52:
        return np.array([[_whole(x) for x in row] for row in vectors.tolist()], dtype=object).reshape(vectors.shape)
    return v


def _whole(x: float) -> int:
    return int(x) << 8 if abs(x) >= 2.0**53 else math.floor(256 * x)


def _packed(rows: DataFrame, size: int, tag: str) -> DataFrame:
    """Rows of a dimension in blocks of about `size`, equal ids dealt out too: dim, block, ids and vectors as bytes."""
    n = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("blocks"))
    dealt = rows.withColumn("no", F.monotonically_increasing_id()).join(n, "dim").withColumn("block", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        v = np.array(t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
        one = lambda x, kind: pa.array([x], kind)
        return pa.table(
            {
                "dim": t.column("dim").slice(0, 1), "block": t.column("block").slice(0, 1),
                "ids": one(t.column("vec_id").to_numpy().astype(np.int64).tobytes(), pa.binary()), "vectors": one(v.tobytes(), pa.binary()),
            }
        )

    kind = "dim int, block int, ids binary, vectors binary"
    return scratch(dealt.select("dim", "block", "vec_id", "embedding").groupBy("dim", "block").applyInArrow(pack, kind), tag)


def _opened(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vectors).reshape(len(i), dim)


def _some(blocks: DataFrame) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """Blocks of queries, in lists of about QUERY_BYTES."""
    held, size = [], 0
    for r in blocks.toLocalIterator():
        held.append((r["dim"], *_opened(r["ids"], r["vectors"], r["dim"])))
        size += len(r["vectors"])
        if size >= QUERY_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for all queries (vec_id, embedding) against all vectors.

    Vectors of different lengths have no inner product and don't meet; empty ones have the product 0 with each other.
    Null or unfinished vectors take no part. Of repeated rows each is a candidate of its own; one with the query's own
    id never is. A query id that is repeated is answered once if its vectors are equal, else for the sum of what they
    find. A product beyond the range of long counts as the nearest long, also for its rank. Extra columns are not read.

    Shards stay where they are. Queries go to them in turns of about QUERY_BYTES; a task hands the k-th score that a
    query has reached on from shard to shard, and only its k best rows for each query go on.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    dims = lambda df: usable(df).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim"))
    shards = _packed(dims(vectors), SHARD_ROWS, "shards")
    blocks = _packed(dims(queries).dropDuplicates(["vec_id", "embedding"]), QUERY_ROWS, "queries")

    def against(sent):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int], list[tuple[int, int]]] = {}
            own = [(n, dim, qids, q, 256 * float(np.abs(q).max(initial=0))) for n, (dim, qids, q) in enumerate(sent.value)]
            for b in batches:
                for r in b.to_pylist():
                    ids, v = _opened(r["ids"], r["vectors"], r["dim"])
                    for n, dim, qids, q, most in own:
                        if dim != r["dim"]:
                            continue
                        shard = Shard(ids, whole_numbers(v, most))
                        whole = whole_numbers(q, 256 * float(np.abs(v).max(initial=0)))
                        for i, x in enumerate(whole):
                            had = best.get((n, i), [])
                            new = shard.search(x, int(qids[i]), k, had[-1][0] if len(had) == k else None)
                            best[n, i] = sorted(had + new, key=lambda p: (-p[0], p[1]))[:k]
            out = [(int(own[n][2][i]), s, d) for (n, i), found in best.items() for s, d in found]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], names=["query_id", "score", "vec_id"])

        return each

    kind = "query_id long, score long, vec_id long"
    found = [spark.createDataFrame([], kind)]
    for some in _some(blocks):
        found.append(scratch(shards.select("dim", "ids", "vectors").mapInArrow(against(spark.sparkContext.broadcast(some)), kind), "found"))
    discard(shards, blocks)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return functools.reduce(DataFrame.unionAll, found).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter("vec_id % 50 = 0"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(CASE WHEN len(q.e) = 0 THEN 0 ELSE list_inner_product(q.e, c.e) END AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
