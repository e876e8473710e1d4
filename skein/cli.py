"""skein: index, sync, status and search over a source tree."""

from __future__ import annotations

import argparse
import sys

EXIT_OK, EXIT_ERROR, EXIT_USAGE, EXIT_STALE, EXIT_NO_INDEX = 0, 1, 2, 3, 4


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein")
    p.add_argument("--root", default=".")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "index", "sync", "status"):
        sub.add_parser(name)
    s = sub.add_parser("search")
    s.add_argument("mode", choices=["files", "text", "symbol", "refs", "callers", "callees", "impact", "deps", "neighbors", "path", "explore", "occurrences"])
    s.add_argument("query")
    s.add_argument("to", nargs="?")
    s.add_argument("--limit", type=int, default=0)
    s.add_argument("--depth", type=int, default=0)
    s.add_argument("--kind")
    s.add_argument("--language")
    s.add_argument("--include")
    s.add_argument("--ignore-case", action="store_true")
    s.add_argument("-k", type=int, default=8)
    return p


def run(argv: list[str], spark=None) -> tuple[int, str]:
    """The exit code and what to print."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from skein.maintenance import workspace_index as I
    from skein.operators import graph, scan
    from skein.plans.explore import explore
    from skein.plans.requests import Envelope, ExploreRequest

    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return (EXIT_OK if e.code == 0 else EXIT_USAGE), ""
    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    try:
        if a.command in ("init", "index"):
            out = I.reindex(spark, a.root)
            return EXIT_OK, Envelope(a.command, {}, [out]).to_json()
        if a.command == "sync":
            return EXIT_OK, Envelope("sync", {}, [I.sync(spark, a.root)]).to_json()
        if a.command == "status":
            out = I.status(spark, a.root)
            return (EXIT_STALE if out["stale"] else EXIT_OK), Envelope("status", {}, [out], stale=str(out["stale"])).to_json()
        index = I.open_index(spark, a.root)
    except FileNotFoundError as e:
        return EXIT_NO_INDEX, str(e)
    try:
        q, edges = a.query, index.edges.filter("dst IS NOT NULL")
        files = index.files.withColumn("bytes", F.octet_length("text"))
        target = lambda: graph.resolve_target(index.nodes, q)
        nodes = index.nodes.withColumn("line", F.col("start_line"))
        if a.mode == "explore":
            env = explore(index, ExploreRequest(q, a.k, language=a.language, path=a.include))
            return EXIT_OK, env.to_json() if a.json else env.to_text()
        if a.mode == "files":
            df = scan.find_files(files, q, a.language, limit=a.limit)
        elif a.mode == "text":
            df = scan.find_text(files, q, a.ignore_case, a.include, a.language, a.limit)
        elif a.mode == "symbol":
            df = graph.find_symbol(nodes, q, a.kind, a.limit)
        elif a.mode == "impact":
            df = graph.impact_nodes(edges, nodes, target(), a.depth or 2, limit=a.limit)
        elif a.mode == "path":
            df = graph.shortest_path(edges, target(), graph.resolve_target(nodes, a.to)).withColumn("path", F.col("id"))
        elif a.mode == "occurrences":
            df = edges.filter((F.col("dst") == target()) | (F.col("src") == target()))
        elif a.mode == "deps":
            df = edges.filter(F.col("kind").isin("imports", "links_to", "loads_stylesheet", "cites")).filter((F.col("src") == target()) | (F.col("dst") == target()))
        else:
            kinds, direction = {"refs": (("calls", "references", "type_uses"), "in"), "callers": (("calls",), "in"), "callees": (("calls",), "out"), "neighbors": ((a.kind,) if a.kind else (), "both")}[a.mode]
            kept, _ = graph.neighborhood(edges.select("src", "kind", "dst", "line", "sites"), nodes, target(), a.depth or 1, direction, kinds)
            df = kept.select("path", "line", "id", "kind", "depth").orderBy("path", "line", "id").limit(a.limit or graph.LIMIT)
        env = Envelope(a.mode, {"query": q}, [r.asDict() for r in df.collect()])  # limits above bound this
        return EXIT_OK, env.to_json() if a.json else env.to_text()
    except (LookupError, ValueError) as e:
        return EXIT_ERROR, str(e)


def main() -> None:
    code, out = run(sys.argv[1:])
    print(out)
    sys.exit(code)


if __name__ == "__main__":
    main()
