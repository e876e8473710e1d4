"""A source tree's index on disk: built whole, brought up to date, opened, and compared with the tree."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.maintenance import manifest as M
from skein.maintenance.generations import Store
from skein.operators.scan import classified
from skein.plans.explore import Index
from skein.sources.storage import settled
from skein.sources.workspace import load_config, read_tree, walk

STORE = ".skein"


def _store(root: str) -> Store:
    return Store(str(Path(root) / STORE))


def _live(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, str]:
    """files with text, the manifest of a complete walk, and the policy's fingerprint."""
    policy = load_config(root)
    walked = walk(root, policy).require_complete()
    tree = settled(classified(read_tree(spark, root, walked), policy.max_file_bytes))
    quarantine = F.when(F.col("state") != "text", F.col("state"))
    return tree.filter("text IS NOT NULL").select("path", "language", "text"), tree.select("path", "size", "mtime_ns", "content_hash", quarantine.alias("quarantine")), policy.fingerprint()


def _publish(root: str, files: DataFrame, manifest: DataFrame, policy: str, symbols: DataFrame, refs: DataFrame) -> tuple[str, Index]:
    index = Index.build(files, symbols, refs)
    with _store(root).writing() as store:
        tables = {"nodes": index.nodes, "edges": index.edges, "units": index.units, "files": files, "manifest": manifest, "symbols": symbols, "references": refs}
        gen = store.publish(tables, policy=policy)
        store.retain()
    return gen, index


def reindex(spark: SparkSession, root: str) -> dict:
    files, manifest, policy = _live(spark, root)
    gen, index = _publish(root, files, manifest, policy, *Index.facts(files))
    return {"generation": gen, "files": manifest.count(), "nodes": index.nodes.count()}


def sync(spark: SparkSession, root: str) -> dict:
    """Files that changed are extracted anew, the facts of the others are kept, and all are bound together.

    Nothing is written where nothing changed; a changed policy builds the whole index. The tables equal a rebuild's.
    """
    store = _store(root)
    old = store.open(spark)
    files, manifest, policy = _live(spark, root)
    if store.pointer()["policy"] != policy:
        return {**reindex(spark, root), "reindexed": True}
    diff = settled(M.classify(old["manifest"], manifest))
    totals = {r["change"]: r["n"] for r in M.totals(diff).collect()}
    if not set(totals) - {"unchanged"}:
        return {"changed": 0, **totals}
    touched = diff.filter("change <> 'unchanged'")
    gone = touched.select("path").unionAll(touched.filter("renamed_from IS NOT NULL").select("renamed_from"))
    new = Index.facts(files.join(touched.select("path"), "path", "left_semi"))
    symbols, refs = (settled(M.replaced(old[t], n, gone)) for t, n in zip(("symbols", "references"), new))
    gen, _ = _publish(root, files, manifest, policy, symbols, refs)
    return {"generation": gen, "changed": sum(n for k, n in totals.items() if k != "unchanged"), **totals}


def open_index(spark: SparkSession, root: str) -> Index:
    t = _store(root).open(spark)
    return Index(t["nodes"], t["edges"], t["units"], t["files"])


def status(spark: SparkSession, root: str, content: bool = False) -> dict:
    store = _store(root)
    t = store.open(spark)
    _, manifest, policy = _live(spark, root)
    stale = M.staleness(t["manifest"], manifest, content).count()
    return {**store.status(spark), "stale": stale, "policy_changed": store.pointer()["policy"] != policy}
