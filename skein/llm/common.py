"""Shared pieces of the corpus operators: scratch tables, hot-group tiles, connected components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_WS = re.compile(rb"[\x20\x09-\x0D]")
#: What "a word" is everywhere here.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only where that is unset and Spark is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="skein-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def scratch(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_skein_path", None)
        if path:
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Long texts: few rows in an Arrow batch, so that a batch stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]


def word_pieces(low: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, in lists from pieces of about `size` bytes, so that no text fills memory."""
    if len(low) <= size:
        yield low.split()
        return
    at = 0
    while at < len(low):
        end = min(at + size, len(low))
        m = _WS.search(low, end) if end < len(low) else None
        end = m.start() if m else len(low)
        yield low[at:end].split()
        at = end


def tiles(rows: DataFrame, keys: list[str], by: str, cap: int) -> DataFrame:
    """Deal groups of any size into tasks of at most about 2 * cap rows, without losing a pair.

    Groups of one row go. A group of n rows gets k = ceil(n / cap) parts by the hash of `by`; each
    row is sent to the k tasks (lo, hi) that hold its part (`part`) and one other, so every pair of
    rows meets in exactly one task: in (p, p) within a part, else in (lo, hi) across parts.
    """
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    k = F.ceil(F.col("_n") / F.lit(cap)).cast("int")
    out = rows.join(n, keys).withColumn("_k", k).withColumn("part", F.pmod(F.xxhash64(by), F.col("_k")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return (
        out.withColumn("lo", F.least("part", "_other"))
        .withColumn("hi", F.greatest("part", "_other"))
        .drop("_n", "_k", "_other")
        .repartition(*keys, "lo", "hi")
        .sortWithinPartitions(*keys, "lo", "hi")
    )


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by keys: tables of whole groups, with the positions where groups start and the end."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        new[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.nonzero(new)[0], t.num_rows)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < 20_000:
            continue
        t = pa.Table.from_batches(held)
        s = starts(t)
        if len(s) > 2:
            cut = int(s[-2])
            yield t.slice(0, cut), s[:-1]
            rest = t.slice(cut)
            held, rows = rest.to_batches(), rest.num_rows
    if held:
        t = pa.Table.from_batches(held)
        yield t, starts(t)


def find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): each node of an edge with the smallest node it reaches.

    Rounds of hooking every node on its smallest neighbour, pointer jumping to the roots and
    contracting the edges; a round at least halves the nodes of every component. All steps are
    equi joins and partial aggregates, so a hub of any degree is split by Spark like any join key.
    No edge: an empty table.
    """
    e = scratch(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct(), "edges"
    )
    maps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b"), F.col("a")))
        tree = scratch(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "hook")
        while True:
            up = tree.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            nxt = scratch(tree.join(up, "p").select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "jump")
            discard(tree)
            tree = nxt
            if tree.filter("moved").isEmpty():
                break
        pa_, pb = (tree.select(F.col("u").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        contracted = scratch(
            e.join(pa_, "a").join(pb, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).filter("a < b").distinct(),
            "edges",
        )
        discard(e)
        e = contracted
        maps.append(tree.select("u", "p"))
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0]
    for later in maps[1:]:
        up = later.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        out = out.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"))
    return out.select(F.col("u").alias("node"), F.col("p").alias("component"))
