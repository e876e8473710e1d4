"""Putting ranked lists together: fusion, tests last, spread over files, limits by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.text import asks_about_tests, rank_score

PAYLOAD_BYTES = 65_536


def fuse(lanes: list[DataFrame], id_: str = "id") -> DataFrame:
    """id, exact, score: reciprocal ranks added up over lanes (id, rank0, exact); an exact hit brings 2 for its lane.

    Lanes are top-k lists, so this sorts and groups no more than they hold.
    """
    rows = lanes[0].select(id_, "rank0", "exact")
    for lane in lanes[1:]:
        rows = rows.unionByName(lane.select(id_, "rank0", "exact"))
    part = F.when(F.col("exact"), 2.0).otherwise(rank_score(F.col("rank0")))
    return rows.groupBy(id_).agg(F.max("exact").alias("exact"), F.round(F.sum(part), 6).alias("score"))


def ranked(top: DataFrame, order: list) -> DataFrame:
    """A top-k list with rank0 from 0; k rows at most, so one task numbers them."""
    return top.withColumn("rank0", F.row_number().over(W.orderBy(*order)) - 1)


def defer_tests(hits: DataFrame, query: str, test: Column, spelled: Column | None = None, order: list | None = None) -> DataFrame:
    """hits with `place`: tests after the rest in the order they have, unless asked for, spelled out or exact."""
    order = order or [F.desc("score"), "id"]
    late = F.lit(False) if asks_about_tests(query) else test & (F.col("score") < 2.0) & ~(F.lit(False) if spelled is None else spelled)
    return hits.withColumn("deferred", late).withColumn("place", F.row_number().over(W.orderBy("deferred", *order)))


def diverse(hits: DataFrame, k: int, per_file: int, place: str = "place") -> DataFrame:
    """k hits, at most per_file of a path first, exact ones exempt; those put off fill what is free. 0 is no limit."""
    exact = F.col("score") >= 2.0
    before = F.count(F.lit(1)).over(W.partitionBy("path").orderBy(place).rowsBetween(W.unboundedPreceding, -1))
    off = F.lit(False) if not per_file else (~exact & (before >= per_file))
    out = hits.withColumn("put_off", off)
    return out.withColumn("slot", F.row_number().over(W.orderBy("put_off", place))).filter(F.col("slot") <= k)


def fitting(rows: DataFrame, order: list, limit: int = PAYLOAD_BYTES) -> DataFrame:
    """The prefix of the rows whose JSON fits into `limit` bytes with a comma each, with the running `bytes`."""
    size = F.octet_length(F.to_json(F.struct(*rows.columns))) + 1
    return rows.withColumn("bytes", F.sum(size).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).filter(F.col("bytes") <= limit)


def truncations(**counts: tuple[int, int]) -> list[dict]:
    """A notice for each limit (name=(found, kept)) that cut something."""
    return [{"kind": k, "found": f, "kept": n} for k, (f, n) in counts.items() if f > n]
