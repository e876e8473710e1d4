"""Limits on work: numeric caps with notices, lanes that share them, deadlines and cancellation."""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name: (default, ceiling)
LIMITS = {
    "candidates": (10_000, 100_000), "postings": (200_000, 1_000_000), "dictionary": (256, 4_096), "positional_bytes": (64 << 20, 64 << 20), "positional_tokens": (1_000_000, 1_000_000), "witnesses": (1_024, 1_024),
    "source_files": (10_000, 10_000), "source_bytes": (64 << 20, 64 << 20), "windows": (10_000, 10_000), "occurrences": (10_000, 10_000), "metadata": (100_000, 100_000), "edges": (50, 500), "files": (100, 1_000), "lines": (250, 2_000), "live_files": (512, 512),
}


@dataclass
class WorkBudget:
    """Caps are cuts after a total order, so that a partial result is the same on every run, and each cut is noted."""

    asked: dict[str, int] = field(default_factory=dict)
    notices: list[dict] = field(default_factory=list)
    spent: dict[str, int] = field(default_factory=dict)

    def limit(self, name: str) -> int:
        default, ceiling = LIMITS[name]
        return min(self.asked.get(name) or default, ceiling)

    def cut(self, df: DataFrame, name: str, order: list) -> DataFrame:
        """The first rows up to the limit; one more row tells whether there are more."""
        n = self.limit(name)
        some = df.orderBy(*order).limit(n + 1)
        found = some.count()
        self.spent[name] = self.spent.get(name, 0) + min(found, n)
        if found > n:
            self.notices.append({"kind": name, "found": found, "kept": n})
        return some.orderBy(*order).limit(n)

    def lane(self, share: float = 0.5) -> WorkBudget:
        """A lane with a share of what is left of each cap; `absorb` gives its spending back."""
        return WorkBudget({k: max(1, int((self.limit(k) - self.spent.get(k, 0)) * share)) for k in LIMITS})

    def absorb(self, lane: WorkBudget) -> None:
        for k, v in lane.spent.items():
            self.spent[k] = self.spent.get(k, 0) + v
        self.notices += lane.notices


@contextmanager
def deadline(spark: SparkSession, seconds: float):
    """Jobs started inside are interrupted when time is up; the event given says whether it was."""
    sc, tag, up = spark.sparkContext, f"skein-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        up.set()
        sc.cancelJobsWithTag(tag)

    sc.addJobTag(tag)
    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        yield up
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def analysis_coverage(units: DataFrame) -> DataFrame:
    """path, units, lines, headings, truncated of units (path, unit, start_line, end_line, headings): a roll-up for each file."""
    from skein.extractors.markdown import UNITS_A_FILE

    n = F.count(F.lit(1))
    return units.groupBy("path").agg(n.alias("units"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines"), F.count(F.when(F.size("headings") > 0, 1)).alias("headings"), (n >= UNITS_A_FILE).alias("truncated"))


def line_postings(lines: DataFrame, key: str = "path") -> DataFrame:
    """key, term, lines (sorted), split and whole: on which lines a term occurs, by either tokenizer."""
    from skein.functions.text import split_tokens, whole_tokens

    # lines are dealt out, not their many more postings, by the key alone; explode would have Spark tokenise each a second time, for a filter on what is empty
    t = lines.select(key, "line", "content").repartition(key).select(key, "line", split_tokens(F.col("content")).alias("_s"), whole_tokens(F.col("content")).alias("_w"))
    t = t.select(key, "line", "_s", "_w", F.array_except("_s", "_w").alias("_o"))
    # in the order split only, both, whole only, so that a term's place tells which it is
    t = t.select(key, "line", F.size("_o").alias("_from"), F.size(F.array_distinct("_s")).alias("_to"), F.array_union(F.array_union("_o", "_s"), "_w").alias("_t"))
    marked = t.select(key, "line", "_from", "_to", F.posexplode_outer("_t").alias("_pos", "term")).filter("term IS NOT NULL")
    marked = marked.select(key, "term", "line", (F.col("_pos") < F.col("_to")).alias("s"), (F.col("_pos") >= F.col("_from")).alias("w"))
    return marked.groupBy(key, "term").agg(F.sort_array(F.collect_set("line")).alias("lines"), F.bool_or("s").alias("split"), F.bool_or("w").alias("whole"))
