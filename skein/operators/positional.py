"""Phrases and proximity over token positions, by windows inside a document."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.text import py_whole_tokens, whole_tokens

MAX_DISTANCE = 4096


def positions(units: DataFrame, key: str, terms: list[str], text: str = "text") -> DataFrame:
    """key, pos, term of the query's tokens in units that have all of them."""
    wanted = [F.lit(t) for t in sorted(set(terms))]
    tokens = units.select(key, whole_tokens(F.col(text)).alias("_t"))
    tokens = tokens.filter(F.size(F.array_intersect("_t", F.array(*wanted))) == len(wanted))
    return tokens.select(key, F.posexplode("_t").alias("pos", "term")).filter(F.col("term").isin(*set(terms)))


def phrase(units: DataFrame, key: str, query: str, gap: int = 0, text: str = "text") -> DataFrame:
    """key, start, stop: the words in order with at most `gap` others among them in all; for each end the shortest.

    The latest start of a match of the first k words that ends at a token is the latest start of k - 1 words
    before it: a running maximum for each word of the query.
    """
    terms = py_whole_tokens(query)
    if not terms or not 0 <= gap <= MAX_DISTANCE:
        raise ValueError("a phrase of words and a gap within bounds are needed")
    rows = positions(units, key, terms, text)
    before = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("s0", F.when(F.col("term") == terms[0], F.col("pos")))
    for i, t in enumerate(terms[1:], 1):
        rows = rows.withColumn(f"s{i}", F.when(F.col("term") == t, F.max(f"s{i - 1}").over(before)))
    last = f"s{len(terms) - 1}"
    return rows.filter(F.col(last).isNotNull() & (F.col("pos") - F.col(last) < len(terms) + gap)).select(key, F.col(last).alias("start"), F.col("pos").alias("stop"))


def near(units: DataFrame, key: str, query: str, window: int = 8, text: str = "text") -> DataFrame:
    """key, start, stop: all words, as often as the query has them, in any order within `window` tokens; for each end the shortest."""
    terms = py_whole_tokens(query)
    if not terms or not len(terms) <= window <= MAX_DISTANCE:
        raise ValueError("words and a window that holds them are needed")
    rows = positions(units, key, terms, text)
    upto = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    own = W.partitionBy(key, "term").orderBy("pos")
    starts = []
    for i, (t, n) in enumerate(sorted(Counter(terms).items())):
        nth = F.col("pos") if n == 1 else F.lag("pos", n - 1).over(own)
        rows = rows.withColumn(f"p{i}", F.when(F.col("term") == t, nth))
        starts.append(F.max(f"p{i}").over(upto))
    rows = rows.select(key, "pos", *[s.alias(f"q{i}") for i, s in enumerate(starts)])
    whole = rows.dropna()
    start = F.least(*[F.col(f"q{i}") for i in range(len(starts))]) if len(starts) > 1 else F.col("q0")
    return whole.select(key, start.alias("start"), F.col("pos").alias("stop")).filter(F.col("stop") - F.col("start") < window)
