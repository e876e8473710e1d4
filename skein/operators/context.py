"""Excerpts: snippets around a hit, what was shown already, merging, and packing by value for bytes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SNIPPET_LINES, EXCERPT_LINES, EXCERPTS = 10, 80, 64


def snippet(text: Column, anchor: Column, lines: int = SNIPPET_LINES) -> Column:
    """Up to `lines` lines around line `anchor` (from 1), as struct(start, stop, content)."""
    all_ = F.split(text, "\r?\n")
    n = F.when(F.element_at(all_, -1) == "", F.size(all_) - 1).otherwise(F.size(all_))
    start = F.greatest(F.lit(1), F.least(anchor - lines // 2, n - lines + 1))
    stop = F.least(n, start + lines - 1)
    return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.array_join(F.slice(all_, start, F.greatest(F.lit(0), stop - start + 1)), "\n").alias("content"))


def uncovered(spans: DataFrame, order: str = "rank") -> DataFrame:
    """path, hash, rank, line: the lines of spans (path, hash, rank, start, stop) not shown by a span of a lower rank."""
    line = spans.select("path", "hash", order, F.explode(F.sequence("start", "stop")).alias("line"))
    return line.groupBy("path", "hash", "line").agg(F.min(order).alias(order))


def merged(spans: DataFrame, most: int = EXCERPT_LINES) -> DataFrame:
    """Excerpts (path, hash, role, start, stop) that touch made one, while together at most `most` lines.

    Islands of touching spans by a running maximum; an island that is too long is left as cut spans of `most` lines.
    """
    w = W.partitionBy("path", "hash", "role").orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = spans.withColumn("_b", before).withColumn("_i", F.sum(F.when(F.col("_b").isNull() | (F.col("start") > F.col("_b") + 1), 1).otherwise(0)).over(w))
    whole = rows.groupBy("path", "hash", "role", "_i").agg(F.min("start").alias("lo"), F.max("stop").alias("hi"))
    cut = whole.select("path", "hash", "role", "hi", F.explode(F.sequence("lo", "hi", F.lit(most))).alias("start"))
    return cut.select("path", "hash", "role", "start", F.least(F.col("start") + most - 1, F.col("hi")).alias("stop"))


def proximity(lines: list[tuple[int, int]], scale: int = 1_000_000) -> int:
    """Half the scale over the shortest span of lines that has all terms of (line, mask); 0 for fewer than two terms."""
    wanted = 0
    for _, m in lines:
        wanted |= m
    if bin(wanted).count("1") < 2:
        return 0
    best = None
    last: dict[int, int] = {}
    bits = [i for i in range(wanted.bit_length()) if wanted >> i & 1]
    for line, m in sorted(lines):
        for i in bits:
            if m >> i & 1:
                last[i] = line
        if len(last) == len(bits):
            span = line - min(last.values()) + 1
            best = span if best is None else min(best, span)
    return scale // 2 // best


def pack(candidates: list[dict], budget: int, most: int = EXCERPTS) -> list[dict]:
    """Greedily the candidate with the most new value for its bytes, again and again, while it fits.

    candidates: {id, terms (set), value, bytes}; a term counts once over all that is taken. The list is one query's
    pool of at most some hundreds. Ties go to the earlier one.
    """
    taken: list[dict] = []
    have: set = set()
    left = list(candidates)
    while left and len(taken) < most:
        worth = [((c["value"] + len(set(c["terms"]) - have)) / max(1, c["bytes"]), -i) for i, c in enumerate(left)]
        best = -max(worth)[1]
        c = left.pop(best)
        if c["bytes"] <= budget and (c["value"] > 0 or set(c["terms"]) - have):
            budget -= c["bytes"]
            have |= set(c["terms"])
            taken.append(c)
    return taken


def fit(result: dict, limit: int = 65_536) -> tuple[dict, list[dict]]:
    """A result whose JSON fits: excerpts go first, then edges, snippets, items, from the end; with notices of what went."""
    out, notices = dict(result), []
    size = lambda: len(json.dumps(out, ensure_ascii=False).encode())
    for part in ("excerpts", "edges", "snippets", "items"):
        had = len(out.get(part, []))
        while out.get(part) and size() > limit:
            out[part] = out[part][: -max(1, len(out[part]) // 8)]
        if len(out.get(part, [])) < had:
            notices.append({"kind": f"payload_{part}", "found": had, "kept": len(out[part])})
    if size() > limit:
        raise ValueError("the result does not fit without any item")
    return out, notices
