"""File and literal-text scans with limits that say when they cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.globs import anchored_glob, include_glob
from skein.functions.names import clamp_limit, truncate_line

FILES_LIMIT, FILES_MOST = 100, 1_000
TEXT_LIMIT, TEXT_MOST = 250, 2_000


def _cut(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first `limit` rows, with `truncated` true on all of them if there are more: one row past the limit tells."""
    top = df.orderBy(*order).limit(limit + 1)
    w = W.orderBy(*order)
    seen = top.withColumn("_n", F.row_number().over(w)).withColumn("truncated", F.count(F.lit(1)).over(W.partitionBy(F.lit(1))) > limit)
    return seen.filter(F.col("_n") <= limit).drop("_n")


def find_files(files: DataFrame, pattern: str | None = None, language: str | None = None, root: str = "", limit: int = 0) -> DataFrame:
    """path, language, bytes of the files that match, in path order."""
    hits = in_root(files, root)
    if pattern is not None:
        hits = hits.filter(F.col("path").rlike(anchored_glob(pattern)))
    if language:
        hits = hits.filter(F.col("language") == language)
    return _cut(hits.select("path", "language", "bytes"), ["path"], clamp_limit(limit, FILES_LIMIT, FILES_MOST))


def in_root(files: DataFrame, root: str) -> DataFrame:
    """Files below a folder given relative to the root; one that leads out of it is refused."""
    parts: list[str] = []
    for p in root.split("/"):
        if p == "..":
            if not parts:
                raise ValueError(f"{root!r} leaves the root")
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    return files.filter(F.col("path").startswith("/".join(parts) + "/")) if parts else files


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), content: lines end at \\n or \\r\\n; the end of the text begins none."""
    split = files.select("path", F.split("text", "\n").alias("_l"))
    rows = split.select("path", F.posexplode_outer("_l").alias("pos", "content"), F.size("_l").alias("_n"))  # explode would have Spark split each text twice
    rows = rows.filter((F.col("pos") < F.col("_n") - 1) | (F.col("content") != ""))
    ends = F.col("pos") < F.col("_n") - 1
    return rows.select("path", (F.col("pos") + 1).alias("line"), F.when(ends, F.regexp_replace("content", "\r$", "")).otherwise(F.col("content")).alias("content"))


def find_text(files: DataFrame, literal: str, ignore_case: bool = False, include: str | None = None, language: str | None = None, limit: int = 0) -> DataFrame:
    """path, line, content of lines that contain the literal: one hit a line, in path and line order."""
    if not literal:
        raise ValueError("the text is empty")
    if language:
        files = files.filter(F.col("language") == language)
    if include:
        glob = include_glob(include)
        files = files.filter(F.col("path").rlike(glob) | F.regexp_extract("path", "[^/]*$", 0).rlike(glob))
    has = (lambda c: F.lower(c).contains(F.lower(F.lit(literal)))) if ignore_case else (lambda c: c.contains(F.lit(literal)))
    if "\n" not in literal:
        files = files.filter(has(F.col("text")))  # whole texts first: only those that match are split
    hits = lines(files).filter(has(F.col("content"))).select("path", "line", truncate_line(F.col("content")).alias("content"))
    return _cut(hits, ["path", "line"], clamp_limit(limit, TEXT_LIMIT, TEXT_MOST))


def classified(files: DataFrame, max_bytes: int = 1 << 20) -> DataFrame:
    """path, state, text for rows (path, content binary): text, binary, invalid_utf8, oversize."""
    binary = F.expr("position(X'00' in substring(content, 1, 8192)) > 0")
    state = (
        F.when(F.octet_length("content") > max_bytes, "oversize").when(binary, "binary").when(~F.is_valid_utf8(F.col("content").cast("string")), "invalid_utf8").otherwise("text")
    )
    out = files.withColumn("state", state)
    return out.withColumn("text", F.when(F.col("state") == "text", F.col("content").cast("string")))


def coverage(classed: DataFrame) -> DataFrame:
    """One row: how many files are in each state."""
    n = lambda s: F.count(F.when(F.col("state") == s, 1)).alias(s)
    return classed.agg(F.count(F.lit(1)).alias("files"), n("text"), n("binary"), n("invalid_utf8"), n("oversize"))
