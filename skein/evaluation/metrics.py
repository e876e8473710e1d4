"""How good results are: ranks, coverage of regions, precision and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rank_metrics(ranks: DataFrame) -> DataFrame:
    """hit1, hit3, hit8, found, mrr over rows (query, rank), rank null where the answer was not found."""
    at = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6)
    return ranks.agg(at(1).alias("hit1"), at(3).alias("hit3"), at(8).alias("hit8"), F.count("rank").alias("found"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def region_coverage(wanted: DataFrame, seen: DataFrame) -> DataFrame:
    """task, files, files_found, lines, lines_found of wanted and seen spans (task, path, start, stop)."""
    lines = lambda df: df.select("task", "path", F.explode(F.sequence("start", "stop")).alias("line")).distinct()
    w, s = lines(wanted), lines(seen).withColumn("hit", F.lit(1))
    per = w.join(s, ["task", "path", "line"], "left").groupBy("task", "path").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("k"))
    return per.groupBy("task").agg(F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("k") > 0, 1)).alias("files_found"), F.sum("n").alias("lines"), F.sum("k").alias("lines_found"))


def precision_recall(truth: DataFrame, said: DataFrame, on: list[str]) -> DataFrame:
    """truth, said, both, precision, recall of distinct keys."""
    t, s = truth.select(on).distinct().withColumn("t", F.lit(1)), said.select(on).distinct().withColumn("s", F.lit(1))
    n = t.join(s, on, "full_outer").agg(F.count("t").alias("truth"), F.count("s").alias("said"), F.count(F.when(F.col("t").isNotNull() & F.col("s").isNotNull(), 1)).alias("both"))
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
    return n.select("truth", "said", "both", ratio("both", "said").alias("precision"), ratio("both", "truth").alias("recall"))
