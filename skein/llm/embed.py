"""Near-duplicate vectors by sorted projection passes, with the links of what they join counted exactly."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import components, discard, read, runs, scratch, small_batches, tiles

COSINE = 0.93
#: Neighbours on either side in the sorted order that a vector is compared with; twice as many after every PASSES passes.
WINDOW, PASSES = 48, 8
#: Share of the probes that passes are made until: about PROBES of the vectors, each with a twin at COSINE from it in a
#: random direction. They only say when to stop; every vector takes part in every pass.
RECALL, PROBES = 0.99, 2_000
LEAST_PASSES = 3
BITS = 62
TILE_ROWS = 1024
_BLOCK = 4096


def _unit(t: pa.Table | pa.RecordBatch, column: str | int = "v") -> list[np.ndarray]:
    return [np.frombuffer(x, np.float64) for x in t.column(column).to_pylist()]


@functools.lru_cache(maxsize=8)
def _planes(no: int, dim: int) -> np.ndarray:
    return np.random.default_rng([no, dim]).standard_normal((BITS, dim))


def _keys(vectors: list[np.ndarray], no: int) -> np.ndarray:
    """Of each vector the concatenated bits of the pass's random hyperplanes, the first one highest."""
    out, weight = np.zeros(len(vectors), np.int64), 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    size = np.array([len(v) for v in vectors])
    for dim in np.unique(size):
        at = np.nonzero(size == dim)[0]
        out[at] = (np.stack([vectors[i] for i in at]) @ _planes(no, int(dim)).T > 0) @ weight
    return out


def near_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of (vec_id, embedding, label).

    Equal vectors of a label are one class and count as linked to each other. In each pass the classes
    stand in the order of their hashes, and a class is compared with WINDOW others on either side; what is
    found joins components. Passes go on until probes at the threshold are found, whatever the vectors' distribution. Within a component all pairs are then compared in blocks, so a window does not
    limit n_links; recall is short only of pairs that no pass and no chain of links brings together. A null
    label, a null, empty or zero vector and one with a null or non-finite component link with nothing.
    A null vec_id: its row stays and counts for others, and is no component's id. Repeated rows count each.
    """
    spark = rows.sparkSession
    small_batches(spark)
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    fine = F.coalesce(fine & F.col("label").isNotNull(), F.lit(False))
    cls = base.filter(fine).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    node = F.coalesce("least", F.lit(1 << 62) + F.xxhash64("label", "embedding").bitwiseAND((1 << 60) - 1))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(3).to_pylist():
                a = np.array(x, np.float64)
                a = a / np.abs(a).max()
                out.append((a / np.sqrt(a @ a)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], names=["node", "label", "copies", "v"])

    cls = scratch(cls.select(node.alias("node"), "label", "copies", "embedding").mapInArrow(normal, "node long, label long, copies long, v binary"), "classes")
    links = _passes(cls, cosine)
    comp = scratch(components(links, "a", "b"), "components")
    inside = cls.join(comp, "node").select("component", "node", "copies", "v")
    counted = tiles(inside, ["component"], "node", TILE_ROWS).mapInArrow(_count(cosine), "node long, more long")
    counted = scratch(counted, "counted")
    more = counted.groupBy("node").agg(F.sum("more").alias("more"))
    label = cls.join(more, "node", "left").join(comp, "node", "left")
    label = label.select("node", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    known = base.withColumn("fine", fine)
    of_class = base.filter(fine).groupBy("label", "embedding").agg(F.min("vec_id").alias("least")).select("label", "embedding", node.alias("node"))
    joined = known.filter("fine").join(of_class, ["label", "embedding"]).join(label, "node").select(
        "vec_id", "n_links", F.when(F.col("component") < 1 << 62, F.col("component")).alias("component_id")
    )
    alone = known.filter("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionAll(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _centred(cls: DataFrame) -> DataFrame:
    """node, label, v and c: v less the mean of its label, which hyperplanes through the origin divide more evenly."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for b in batches:
            for label, v in zip(b.column(0).to_pylist(), _unit(b, 1)):
                at = sums.setdefault((label, len(v)), [0, np.zeros(len(v))])
                at[0] += 1
                at[1] += v
        rows = [(label, size, n, x.tobytes()) for (label, size), (n, x) in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["label", "dim", "n", "x"])

    def mean(t: pa.Table) -> pa.Table:
        x = sum(np.frombuffer(v, np.float64) for v in t.column("x").to_pylist()) / sum(t.column("n").to_pylist())
        return pa.table({"label": t.column("label").slice(0, 1), "dim": t.column("dim").slice(0, 1), "mean": pa.array([x.tobytes()], pa.binary())})

    def less(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = [(v - m).astype(np.float32).tobytes() for v, m in zip(_unit(b, 2), _unit(b, 3))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(c, pa.binary())], names=["node", "label", "v", "c"])

    parts = cls.select("label", "v").mapInArrow(add, "label long, dim int, n long, x binary")  # a row for each task and label
    means = parts.groupBy("label", "dim").applyInArrow(mean, "label long, dim int, mean binary")
    rows = cls.select("node", "label", "v", F.floor(F.octet_length("v") / 8).cast("int").alias("dim")).join(means, ["label", "dim"])
    return rows.select("node", "label", "v", "mean").mapInArrow(less, "node long, label long, v binary, c binary")


def _probes(rows: DataFrame, cosine: float) -> DataFrame:
    """Twins (node, label, v, c) at `cosine` from about PROBES of the rows, under their nodes."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs, cs = [], []
            for node, v, c in zip(b.column(0).to_pylist(), _unit(b, 2), b.column(3).to_pylist()):
                u = np.random.default_rng(node & 0x7FFFFFFFFFFFFFFF).standard_normal(len(v))
                u -= (u @ v) * v
                t = cosine * v + math.sqrt(1 - cosine * cosine) * u / np.sqrt(u @ u)
                vs.append(t.tobytes())
                cs.append((t - v + np.frombuffer(c, np.float32)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vs, pa.binary()), pa.array(cs, pa.binary())], names=["node", "label", "v", "c"])

    step = max(1, rows.count() // PROBES)
    some = rows.filter(F.octet_length("v") > 8).filter(F.pmod(F.xxhash64("node", F.lit("probe")), F.lit(step)) == 0)
    return some.mapInArrow(turn, "node long, label long, v binary, c binary")


def _passes(cls: DataFrame, cosine: float) -> DataFrame:
    """a, b: the verified links of as many passes as it takes to bring RECALL of the probes beside their originals."""
    spark = cls.sparkSession
    found = [cls.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)]
    many = cls.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("label")
    rows = scratch(_centred(cls.join(many, "label", "left_semi")), "centred")
    probes = scratch(_probes(rows, cosine), "probes")
    wanted, met, no, window = probes.count(), set(), 0, WINDOW
    both = rows.withColumn("probe", F.lit(False)).unionAll(probes.withColumn("probe", F.lit(True)))
    while not rows.isEmpty() and (no < LEAST_PASSES or len(met) < RECALL * wanted):
        one = scratch(_one_pass(both, no, cosine, window), "pass")
        found.append(one.filter("NOT probe").select("a", "b"))
        met |= {r[0] for r in one.filter("probe").select("a").collect()}  # at most as many as there are probes
        no += 1
        window *= 2 if no % PASSES == 0 else 1
    discard(rows, probes)
    return functools.reduce(DataFrame.unionAll, found)


def _one_pass(rows: DataFrame, no: int, cosine: float, window: int) -> DataFrame:
    """a, b, probe: verified links between classes at most `window` places apart in the order of pass `no`, and the
    nodes (as a) whose probe stands so near."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = _keys([np.frombuffer(x, np.float32).astype(np.float64) for x in b.column(3).to_pylist()], no)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(4), pa.array(key)], names=["node", "label", "v", "probe", "key"])

    spark = rows.sparkSession
    rows = rows.select("node", "label", "v", "c", "probe").mapInArrow(keyed, "node long, label long, v binary, probe boolean, key long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "label", "key", "node").sortWithinPartitions("label", "key", "node", "probe")
    placed = scratch(rows.withColumn("id", F.monotonically_increasing_id()).select("node", "label", "v", "probe", F.shiftright("id", 33).cast("int").alias("part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("place")), "sorted")
    sizes = sorted((r[0], r[1]) for r in placed.groupBy("part").count().collect())  # one row for each partition
    before, upto = [], 0
    for p, n in sizes:
        before.append((p, upto))
        upto += n
    offset = spark.createDataFrame(before, "part int, before long")
    at = placed.join(F.broadcast(offset), "part").withColumn("place", F.col("place") + F.col("before"))
    block = max(_BLOCK, 2 * window)
    own = F.floor(F.col("place") / block)
    nxt = F.floor((F.col("place") + window) / block)  # the last rows of a block are shown to the next one too
    at = at.withColumn("block", F.explode(F.array_distinct(F.array(own, nxt)))).drop("part", "before")

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        node, label, place, probe = (t.column(c).to_numpy() for c in ("node", "label", "place", "probe"))
        home = place // block == t.column("block")[0].as_py()
        v = _unit(t, "v")
        a, b, tried = [], [], []
        same_size = len({len(x) for x in v}) == 1
        m = np.stack(v) if same_size else None
        for d in range(1, min(window, len(node) - 1) + 1):
            i = np.nonzero((label[d:] == label[:-d]) & home[d:] & (place[d:] - place[:-d] == d))[0]
            tried.append(node[i[(node[i] == node[i + d]) & (probe[i] != probe[i + d])]])
            i = i[~probe[i] & ~probe[i + d]]
            if same_size:
                cos = np.einsum("ij,ij->i", m[i], m[i + d])
            else:
                cos = np.array([v[x] @ v[x + d] if len(v[x]) == len(v[x + d]) else -2.0 for x in i])
            i = i[cos >= cosine]
            a.append(node[i])
            b.append(node[i + d])
        none = [np.zeros(0, np.int64)]
        a, b, tried = (np.concatenate(x or none) for x in (a, b, tried))
        return pa.table({"a": np.concatenate([a, tried]), "b": np.concatenate([b, tried]), "probe": np.arange(len(a) + len(tried)) >= len(a)})

    return at.groupBy("block").applyInArrow(compare, "a long, b long, probe boolean")


def _count(cosine: float):
    """For the rows of each tile of a component: how many copies of others each class is linked to."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, s in runs(batches, ["component", "lo", "hi"]):
            node, copies, part = (t.column(c).to_numpy() for c in ("node", "copies", "part"))
            cross = t.column("lo").to_numpy() != t.column("hi").to_numpy()
            v, more = _unit(t), np.zeros(len(node), np.int64)
            for o, e in zip(s[:-1].tolist(), s[1:].tolist()):
                by_size: dict[int, list[int]] = {}
                for i in range(o, e):
                    by_size.setdefault(len(v[i]), []).append(i)
                for own in by_size.values():
                    at = np.array(own)
                    m = np.stack([v[i] for i in own])
                    near = m @ m.T >= cosine
                    if cross[o]:
                        near &= part[at][:, None] != part[at][None, :]
                    np.fill_diagonal(near, False)
                    more[at] += near @ copies[at]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(more)], names=["node", "more"])

    return each


def op10_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
), comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM link l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM comp c
"""
