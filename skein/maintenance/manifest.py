"""What changed between a manifest and a walk, and what that means for unchanged files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def classify(manifest: DataFrame, walk: DataFrame, version_bump: bool = False) -> DataFrame:
    """path, change, renamed_from for manifest and walk rows (path, size, mtime_ns, content_hash[, quarantine]).

    unchanged, modified, added, removed, renamed. Same size and time: unchanged, unread. Else the hash decides; a
    quarantined file is tried again when size or time moved. Of added and removed paths with one hash, the first
    pairs with the first. After a version bump every path that is still there is modified.
    """
    q = F.col("quarantine") if "quarantine" in manifest.columns else F.lit(None).cast("string")
    m = manifest.select("path", F.col("size").alias("s0"), F.col("mtime_ns").alias("t0"), F.col("content_hash").alias("h0"), q.alias("q0"), F.lit(True).alias("was"))
    w = walk.select("path", F.col("size").alias("s1"), F.col("mtime_ns").alias("t1"), F.col("content_hash").alias("h1"), F.lit(True).alias("now"))
    both = m.join(w, "path", "full_outer")
    calm = (F.col("s0") == F.col("s1")) & (F.col("t0") == F.col("t1"))
    change = (
        F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.lit(version_bump), "modified").when(calm, "unchanged")
        .when(F.col("q0").isNotNull(), "modified").when(F.col("h0").eqNullSafe(F.col("h1")), "unchanged").otherwise("modified")
    )
    rows = both.select("path", change.alias("change"), F.coalesce("h1", "h0").alias("h"))
    moved = rows.filter(F.col("change").isin("added", "removed"))
    nth = F.row_number().over(W.partitionBy("change", "h").orderBy("path"))
    moved = moved.withColumn("n", nth)
    gone = moved.filter("change = 'removed'").select("h", "n", F.col("path").alias("renamed_from"))
    new = moved.filter("change = 'added'").select("h", "n", "path")
    pair = new.join(gone, ["h", "n"]).select("path", "renamed_from")
    out = rows.drop("h").join(pair, "path", "left").join(pair.select(F.col("renamed_from").alias("path"), F.lit(True).alias("used")), "path", "left").filter("used IS NULL")
    return out.select("path", F.when(F.col("renamed_from").isNotNull(), "renamed").otherwise(F.col("change")).alias("change"), "renamed_from")


def totals(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def staleness(manifest: DataFrame, walk: DataFrame, content: bool = False) -> DataFrame:
    """path, state of what differs: by size and time, or by content hash."""
    m = manifest.select("path", "size", "mtime_ns", "content_hash", F.lit(1).alias("a")).toDF("path", "s0", "t0", "h0", "a")
    w = walk.select("path", "size", "mtime_ns", "content_hash", F.lit(1).alias("b")).toDF("path", "s1", "t1", "h1", "b")
    same = F.col("h0").eqNullSafe(F.col("h1")) if content else F.col("s0").eqNullSafe(F.col("s1")) & F.col("t0").eqNullSafe(F.col("t1"))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "missing").when(~same, "changed")
    return m.join(w, "path", "full_outer").select("path", state.alias("state")).filter("state IS NOT NULL")


def binding_surface(symbols: DataFrame) -> DataFrame:
    """path, surface: a hash of what other files can bind to; spans, signatures and bodies don't change it."""
    one = F.to_json(F.struct("kind", "name", "qualified_name", "visibility"))
    return symbols.groupBy("path").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(one))), 256).alias("surface"))


def dependents(changed: DataFrame, imports: DataFrame) -> DataFrame:
    """path: the files to bind anew when `changed` (path) did: themselves and all that import them, directly or not."""
    from skein.operators.graph import closure

    e = imports.select(F.col("path").alias("src"), F.col("imported").alias("dst"))
    return closure(e, changed.select(F.col("path").alias("id"))).withColumnRenamed("id", "path")


def updated_counts(counts: DataFrame, removed: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """Counts (key, n) after taking out and adding partial counts; a key at zero goes."""
    signed = counts.select(key, "n").unionAll(removed.select(key, -F.col("n"))).unionAll(added.select(key, "n"))
    return signed.groupBy(key).agg(F.sum("n").alias("n")).filter("n <> 0")


def replaced(old: DataFrame, new: DataFrame, paths: DataFrame, by: str = "path") -> DataFrame:
    """Rows of `old` whose path is not among `paths`, with `new`: what an incremental index keeps and adds."""
    return old.join(paths.select(by).distinct(), by, "left_anti").select(old.columns).unionByName(new.select(old.columns))
