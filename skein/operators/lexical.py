"""Ranked retrieval: postings, statistics and BM25 over metadata fields and over bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.text import STOPWORDS, exact_fold, exact_query, minimum_terms, query_terms, split_tokens, squash, whole_tokens
from skein.sources.storage import settled

K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"name": 8.0, "path": 2.0, "signature": 1.0, "qualified": 4.0}
#: Scores are published with so many places, which also settles ties.
PLACES = 6


def saturate(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def body_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def meta_idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))


def body_postings(units: DataFrame, key: str, text: str = "text", whole: bool = False) -> DataFrame:
    """key, term, tf, length: a row for each term of each unit with the unit's number of terms."""
    tokens = whole_tokens(F.col(text)) if whole else split_tokens(F.col(text))
    rows = units.select(key, tokens.alias("_t")).withColumn("length", F.size("_t"))
    return rows.select(key, "length", F.explode("_t").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def body_search(units: DataFrame, key: str, query: str, match: str | int = "any", k: int | None = 10, text: str = "text", terms: list[str] | None = None, whole: bool = False) -> DataFrame:
    """key, matched, score of the k best units (all with k None); ties to the smaller key. A unit without terms is no document.

    One pass counts, for each unit, its length and the query's terms in it, with no explosion of the others, and writes
    these numbers down; statistics (one row, broadcast) and hits are read from them, so that text is tokenised once.
    """
    terms = query_terms(query, whole) if terms is None else terms
    least = minimum_terms(match, len(terms))
    if not terms or least > len(terms):
        return units.select(key, F.lit(0).alias("matched"), F.lit(0.0).alias("score")).limit(0)
    tokens = whole_tokens(F.col(text)) if whole else split_tokens(F.col(text))
    rows = units.select(key, tokens.alias("_t")).withColumn("length", F.size("_t")).filter("length > 0")
    count = lambda t: F.size(F.filter("_t", lambda w: w == t))
    tf = [count(t) for t in terms]
    counted = settled(rows.select(key, "length", *[c.alias(f"tf{i}") for i, c in enumerate(tf)]))
    stats = counted.agg(
        F.count(F.lit(1)).alias("n"), F.greatest(F.avg("length"), F.lit(1.0)).alias("average"),
        *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))],
    )
    hits = counted.filter(sum(F.col(f"tf{i}") for i in range(len(terms))) > 0).join(F.broadcast(stats))
    part = [
        F.when(F.col(f"tf{i}") > 0, body_idf(F.col("n"), F.col(f"df{i}")) * saturate(F.col(f"tf{i}"), F.col("length"), F.col("average"))).otherwise(0.0)
        for i in range(len(terms))
    ]
    matched = sum((F.col(f"tf{i}") > 0).cast("int") for i in range(len(terms)))
    scored = hits.select(key, matched.alias("matched"), F.round(sum(part), PLACES).alias("score"))
    scored = scored.filter((F.col("matched") >= least) & (F.col("score") > 0))
    return scored if k is None else scored.orderBy(F.desc("score"), key).limit(k)


def meta_fields(nodes: DataFrame) -> DataFrame:
    """The searched fields; the qualified name counts only where it says more than the name."""
    qualified = F.when(F.col("qualified_name").eqNullSafe(F.col("name")), "").otherwise(F.coalesce("qualified_name", F.lit("")))
    signature = F.coalesce("signature", F.lit("")) if "signature" in nodes.columns else F.lit("")
    return nodes.select("id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("path", F.lit("")).alias("path"), signature.alias("signature"), qualified.alias("qualified"), F.coalesce("qualified_name", F.lit("")).alias("full"))


def meta_search(nodes: DataFrame, query: str, match: str | int = "any", k: int = 10, bm25f: bool = False) -> DataFrame:
    """id, exact, matched, score of the k best symbols over four weighted fields; an exact name scores 2."""
    terms = query_terms(query)
    least = minimum_terms(match, len(terms))
    fields = meta_fields(nodes)
    no_stop = lambda c: F.filter(split_tokens(c), lambda w: ~w.isin(*STOPWORDS))
    names = list(FIELD_WEIGHTS)
    rows = fields.select("id", "name", "full", *[no_stop(F.col(f)).alias(f"_{f}") for f in names])
    count = lambda f, t: F.size(F.filter(f"_{f}", lambda w: w == t))
    tf = [count(f, t).alias(f"tf_{f}_{i}") for i, t in enumerate(terms) for f in names]
    rows = settled(rows.select("id", "name", "full", *[F.size(f"_{f}").alias(f"len_{f}") for f in names], *tf))
    has = [sum(F.col(f"tf_{f}_{i}") for f in names) > 0 for i in range(len(terms))]
    total = sum(F.col(f"len_{f}") for f in names)
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"), F.greatest(F.avg(total), F.lit(1.0)).alias("avg"),
        *[F.greatest(F.avg(f"len_{f}"), F.lit(1.0)).alias(f"avg_{f}") for f in names],
        *[F.count(F.when(h, 1)).alias(f"df{i}") for i, h in enumerate(has)],
    )
    rows = rows.join(F.broadcast(stats))

    def one(i: int) -> Column:
        idf = meta_idf(F.col("n"), F.col(f"df{i}"))
        if bm25f:
            x = sum(w * F.col(f"tf_{f}_{i}") / (1 - B + B * F.col(f"len_{f}") / F.col(f"avg_{f}")) for f, w in FIELD_WEIGHTS.items())
            score = idf * x * (K1 + 1) / (x + K1)
        else:
            score = idf * saturate(sum(w * F.col(f"tf_{f}_{i}") for f, w in FIELD_WEIGHTS.items()), total, F.col("avg"))
        return F.when(has[i], score).otherwise(0.0)

    wanted = exact_query(query)
    exact = (exact_fold(F.col("name")) == wanted) | (exact_fold(F.col("full")) == wanted)
    score = sum((one(i) for i in range(len(terms))), F.lit(0.0))
    matched = sum((h.cast("int") for h in has), F.lit(0))
    out = rows.select("id", exact.alias("exact"), matched.alias("matched"), F.round(squash(score, exact), PLACES).alias("score"))
    ok = F.col("exact") | ((F.col("matched") >= least) & (F.col("score") > 0) & F.lit(0 < least <= len(terms)))
    return out.filter(ok).orderBy(F.desc("score"), "id").limit(k)


def best_per_owner(hits: DataFrame, owner: str, order: list) -> DataFrame:
    """The best region of each owner."""
    return hits.withColumn("_r", F.row_number().over(W.partitionBy(owner).orderBy(*order))).filter("_r = 1").drop("_r")


def complementary(regions: DataFrame, owner: str, unit: str, most: int = 4) -> DataFrame:
    """owner, unit, rank: the best region of an owner, then greedily up to three that add query terms.

    regions: (owner, unit, score, mask), mask with a bit for each query term. Each round takes, for all owners at
    once, the best region that has a term the chosen ones lack, so an owner with many regions is no one task.
    """
    left, chosen = regions.select(owner, unit, "score", "mask"), None
    have = left.groupBy(owner).agg(F.lit(0).cast("long").alias("have"))
    for rank in range(most):
        new = left.join(have, owner).filter(F.col("mask").bitwiseAND(F.bitwise_not("have")) != 0)
        best = new.groupBy(owner).agg(F.max_by(F.struct(unit, "mask"), F.struct("score", -F.col(unit))).alias("b"))
        best = best.select(owner, F.col(f"b.{unit}").alias(unit), F.lit(rank).alias("rank"), F.col("b.mask").alias("mask"))
        chosen = best if chosen is None else chosen.unionAll(best)
        have = have.join(best.select(owner, F.col("mask").alias("_m")), owner, "left").select(owner, F.col("have").bitwiseOR(F.coalesce("_m", F.lit(0))).alias("have"))
    return chosen.select(owner, unit, "rank")


def anchor_line(lines: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """key, line, n_terms: the line with most distinct terms, the earliest of equals. lines: (key, line, content)."""
    tokens = split_tokens(F.col("content"))
    n = F.size(F.array_intersect(tokens, F.array(*[F.lit(t) for t in terms])))
    hits = lines.select(key, "line", n.alias("n_terms")).filter("n_terms > 0")
    best = F.max_by(F.struct("line", "n_terms"), F.struct("n_terms", -F.col("line")))
    return hits.groupBy(key).agg(best.alias("b")).select(key, "b.line", "b.n_terms")


def having_all(postings: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """Keys whose postings have all the terms."""
    few = postings.filter(F.col("term").isin(*terms)).groupBy(key).agg(F.count_distinct("term").alias("n"))
    return few.filter(F.col("n") == len(set(terms))).select(key)
