"""Questions to a property graph: nodes (id, kind, name, qualified_name, path, line), edges (src, kind, dst, line, sites)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.names import clamp_limit, edge_id
from skein.sources.storage import dealt, settled

MAX_DEPTH = 4
LIMIT, MOST = 50, 500
REFERENCE_KINDS = ("calls", "references", "type_uses", "extends", "implements", "imports", "uses_class", "selects", "links_to", "cites", "exports", "loads_stylesheet")


def clamp_depth(depth: int) -> int:
    return max(1, min(depth, MAX_DEPTH))


def find_symbol(nodes: DataFrame, name: str, kind: str | None = None, limit: int = 0) -> DataFrame:
    """id, kind, name, path, score: the id itself, else case-sensitive bare (1.0) then qualified (0.9) names."""
    score = F.when(F.col("id") == name, 2.0).when(F.col("name") == name, 1.0).when(F.col("qualified_name") == name, 0.9)
    hits = nodes.withColumn("score", score).filter("score IS NOT NULL")
    best = hits.agg(F.max("score").alias("_best"))
    hits = hits.join(F.broadcast(best)).filter("_best < 2 OR score = 2")  # an id leaves out names, whatever the filter says
    if kind:
        hits = hits.filter(F.col("kind") == kind)
    tier = F.when(F.col("kind").isin("field", "variant", "variable", "export"), 1).otherwise(0)
    out = hits.select("id", "kind", "name", "path", "score", tier.alias("tier"))
    return out.orderBy(F.desc("score"), "tier", "id").limit(clamp_limit(limit, LIMIT, MOST))


def resolve_target(nodes: DataFrame, name: str) -> str:
    """The one id that a name stands for; more than one is an error that says so."""
    ids = [r[0] for r in nodes.filter(F.col("id") == name).select("id").limit(2).collect()]
    for column in ("name", "qualified_name"):
        if not ids:
            ids = [r[0] for r in nodes.filter(F.col(column) == name).select("id").distinct().limit(2).collect()]
    if len(ids) != 1:
        raise LookupError(f"{name!r} is {'ambiguous' if ids else 'unknown'}")
    return ids[0]


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """frm, to, and the edge itself, along the direction: out, in or both."""
    e = edges.select("src", "kind", "dst")
    ahead = e.select(F.col("src").alias("frm"), F.col("dst").alias("to"), *e.columns)
    back = e.select(F.col("dst").alias("frm"), F.col("src").alias("to"), *e.columns)
    out = {"out": ahead, "in": back}.get(direction)
    return ahead.unionAll(back) if out is None else out


def _start(edges: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """The rows that rounds begin with as a table whose size Spark knows: else it would deal out all edges for the first join."""
    return settled(edges.sparkSession.createDataFrame(rows, schema).coalesce(1))


def rings(edges: DataFrame, seeds: list[str], depth: int, direction: str) -> DataFrame:
    """id, depth: every node within reach with the depth it is first met at; seeds have 0.

    A round joins the frontier with the edges and takes out what was met before. What is met is settled between
    rounds, so each round's plan is one join and one anti join; at most MAX_DEPTH rounds.
    """
    step = _steps(edges, direction).select("frm", "to").filter("to IS NOT NULL")
    met = frontier = _start(edges, [(s, 0) for s in sorted(set(seeds))], "id string, depth int")
    for d in range(1, clamp_depth(depth) + 1):
        reached = step.join(frontier.select(F.col("id").alias("frm")), "frm").select(F.col("to").alias("id")).distinct()
        new = reached.join(met.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        if d < clamp_depth(depth):
            new = settled(new)
        met, frontier = met.unionByName(new), new
    return met


def neighborhood(edges: DataFrame, nodes: DataFrame, seed: str, depth: int, direction: str, kinds: tuple[str, ...] = (), keep: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within depth, the seed among them. keep: a condition that hides nodes but is crossed all the same.

    Edges between two known nodes are given if one of them is kept.
    """
    e = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    met = rings(e, [seed], depth, direction)
    full = met.join(nodes, "id")
    kept = full.filter(keep) if keep else full
    ends = full.select("id")
    inner = e.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    if keep:
        k = kept.select("id", F.lit(True).alias("k"))
        inner = inner.join(k.toDF("src", "ks"), "src", "left").join(k.toDF("dst", "kd"), "dst", "left").filter("ks OR kd").drop("ks", "kd")
    return kept, inner


def impact_rings(edges: DataFrame, nodes: DataFrame, seed: str, depth: int = 2, kinds: tuple[str, ...] = REFERENCE_KINDS, keep: str | None = None) -> DataFrame:
    """depth, kind, nodes: how many nodes of each kind depend on the seed at each depth; kind null is the sum."""
    met = rings(edges.filter(F.col("kind").isin(*kinds)), [seed], depth, "in").filter("depth > 0").join(nodes.select("id", "kind", "path"), "id")
    met = met.filter(keep) if keep else met
    return met.rollup("depth", "kind").agg(F.count(F.lit(1)).alias("nodes")).filter("depth IS NOT NULL")


def impact_nodes(edges: DataFrame, nodes: DataFrame, seed: str, depth: int = 2, kinds: tuple[str, ...] = REFERENCE_KINDS, limit: int = 0, links: DataFrame | None = None) -> DataFrame:
    """The dependents in the order depth, incoming edges within the cone (most first), path, line, id.

    Rings are made until they hold as many nodes as are asked for. links: the edges as rounds may read them, repeated or not.
    """
    e, most, depth = edges.filter(F.col("kind").isin(*kinds)), clamp_limit(limit, LIMIT, MOST), clamp_depth(depth)
    step = (e if links is None else links.filter(F.col("kind").isin(*kinds))).select(F.col("src").alias("to"), F.col("dst").alias("frm")).filter("to IS NOT NULL")
    met = frontier = _start(edges, [(seed, 0)], "id string, depth int")
    found, n = None, 0
    for d in range(1, depth + 1):
        new = step.join(frontier.select(F.col("id").alias("frm")), "frm").select(F.col("to").alias("id")).distinct().join(met.select("id"), "id", "left_anti")
        frontier = settled(new.withColumn("depth", F.lit(d)))
        met = met.unionByName(frontier)
        rows = settled(frontier.join(nodes.select("id", "path", "line"), "id"))
        found, n = rows if found is None else found.unionByName(rows), n + rows.count()
        if n >= most:  # deeper rings come later in the order
            break
    # an edge into the cone before its last ring comes from the cone
    into = lambda at: e.filter("src IS NOT NULL").join(found.filter(at).select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    inside = into(F.col("depth") < depth)
    if d == depth:
        inside = inside.unionByName(into(F.col("depth") == depth).join(met.select(F.col("id").alias("src")), "src", "left_semi"))
    degree = inside.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    out = found.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return out.select("id", "depth", "degree", "path", "line").orderBy("depth", F.desc("degree"), "path", "line", "id").limit(most)


def caller_summary(edges: DataFrame, seed: str, hops: int = 2) -> DataFrame:
    """direct, total: distinct direct callers but the seed itself, and all within hops."""
    met = rings(edges.filter("kind = 'calls'"), [seed], hops, "in").filter("depth > 0")
    return met.agg(F.count(F.when(F.col("depth") == 1, 1)).alias("direct"), F.count(F.lit(1)).alias("total"))


def shortest_path(edges: DataFrame, start: str, goal: str, hops: int = MAX_DEPTH) -> DataFrame:
    """place, id, kind (of the edge that leads there): one shortest undirected path, or no row.

    Of equal ways a node is reached from the least frontier id, then by the least (src, kind, dst).
    """
    spark = edges.sparkSession
    step = _steps(edges, "both").filter("dst IS NOT NULL")
    if start == goal:
        return spark.createDataFrame([(0, start, None)], "place int, id string, kind string")
    met = frontier = _start(edges, [(start, None, None, 0)], "id string, parent string, via string, depth int")
    last = min(hops, MAX_DEPTH)
    for d in range(1, last + 1):
        # nothing goes on from the last round, so that only the goal is of use there
        way = (step if d < last else step.filter(F.col("to") == goal)).join(frontier.select(F.col("id").alias("frm")), "frm")
        best = F.min_by(F.struct("frm", "kind"), F.struct("frm", "src", "kind", "dst"))
        new = way.groupBy(F.col("to").alias("id")).agg(best.alias("b")).join(met.select("id"), "id", "left_anti")
        frontier = settled(new.select("id", F.col("b.frm").alias("parent"), F.col("b.kind").alias("via"), F.lit(d).alias("depth")))
        met = met.unionByName(frontier)
        if not frontier.filter(F.col("id") == goal).isEmpty():
            break
    else:
        return spark.createDataFrame([], "place int, id string, kind string")
    out, at, place = [], goal, d
    while place >= 0:  # one row for each hop, four at most
        row = met.filter((F.col("id") == at) & (F.col("depth") == place)).first()
        out.append((place, at, row["via"]))
        at, place = row["parent"], place - 1
    return spark.createDataFrame(out, "place int, id string, kind string")


def connect(edges: DataFrame, seeds: list[str], hops: int = 2) -> DataFrame:
    """src, kind, dst: the edges on shortest undirected paths of at most `hops` between any two seeds.

    One traversal from all seeds at once, keyed by seed, over half the hops: two seeds are as far apart as the least sum
    of a node's distances to both. From the nodes halfway the edges that the rounds came by are followed back, so the
    edges as a whole are read once a round.
    """
    step = _steps(edges, "both").filter("src <> dst")
    met = frontier = _start(edges, [(s, s, 0) for s in sorted(set(seeds))], "seed string, id string, depth int")
    ways = []
    for d in range(1, (hops + 1) // 2 + 1):
        way = step.join(frontier.select("seed", F.col("id").alias("frm")), "frm").join(met.select("seed", F.col("id").alias("to")), ["seed", "to"], "left_anti")
        ways.append(settled(way.select("seed", "frm", "to", "src", "kind", "dst")))
        frontier = settled(ways[-1].select("seed", F.col("to").alias("id"), F.lit(d).alias("depth")).distinct())
        met = met.unionByName(frontier)
    near_a, near_b = met.toDF("a", "id", "da"), met.toDF("b", "id", "db")
    pair = near_a.join(near_b, "id").filter("a < b")
    far = pair.groupBy("a", "b").agg(F.min(F.col("da") + F.col("db")).alias("far")).filter(F.col("far") <= hops)
    mid = settled(pair.join(far, ["a", "b"]).filter("da + db = far AND da = (far + 1) div 2"))
    mid = mid.select("a", "id", "da").union(mid.select("b", "id", "db")).toDF("seed", "id", "depth")
    out, on = edges.select("src", "kind", "dst").limit(0), mid.select("seed", "id").limit(0)
    for d in range(len(ways), 0, -1):
        on = on.unionByName(mid.filter(F.col("depth") == d).select("seed", "id")).distinct()
        back = settled(ways[d - 1].join(on.withColumnRenamed("id", "to"), ["seed", "to"], "left_semi"))
        out, on = out.unionByName(back.select("src", "kind", "dst")), back.select("seed", F.col("frm").alias("id"))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component: the least id that each node of an edge is connected to, by hooking, jumping and contracting."""
    e = settled(edges.filter("dst IS NOT NULL").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    loops = e.filter("a = b").select(F.col("a").alias("u"), F.col("a").alias("p"))
    e, maps = e.filter("a < b"), []
    while not e.isEmpty():
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b"), F.col("a")))
        tree = settled(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")))
        while True:
            up = tree.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            tree = settled(tree.join(up, "p").select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            if tree.filter("moved").isEmpty():
                break
        tree = tree.select("u", "p")
        pa, pb = tree.toDF("a", "pa"), tree.toDF("b", "pb")
        e = settled(e.join(pa, "a").join(pb, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).filter("a < b").distinct())
        maps.append(tree)
    out = maps[0] if maps else loops.limit(0)
    for later in maps[1:]:
        out = out.join(later.toDF("p", "pp"), "p", "left").select("u", F.coalesce("pp", "p").alias("p"))
    return out.unionByName(loops.join(out.select("u"), "u", "left_anti")).toDF("id", "component")


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """id: all that depend on the seeds (id), directly or not, the seeds among them; rounds until nothing is new."""
    step = edges.filter("dst IS NOT NULL").select("src", "dst").distinct()
    met = frontier = settled(seeds.select("id").distinct())
    while True:
        reached = step.join(frontier.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id")).distinct()
        frontier = settled(reached.join(met, "id", "left_anti"))
        if frontier.isEmpty():
            return met
        met = settled(met.unionByName(frontier))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, kind, n: nodes and edges by kind; kind null is the sum."""
    one = lambda df, what: df.rollup("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return one(nodes, "nodes").unionAll(one(edges, "edges"))


def unique_edges(edges: DataFrame) -> DataFrame:
    """edge_id, sites: an edge once, with the sites behind it. Edges are dealt out once and summed where they are: a task holds its own edges only."""
    key = edge_id(F.col("src"), F.col("kind"), F.coalesce("dst", "to_name") if "to_name" in edges.columns else F.col("dst"))
    return dealt(edges.select(key.alias("edge_id"), "sites"), "edge_id").groupBy("edge_id").agg(F.sum("sites").alias("sites"))


def credit_index_links(hits: DataFrame, edges: DataFrame, is_index: str = "path LIKE '%index.md'") -> DataFrame:
    """hits (id, path, line, score) where one on an index page's line with a single link stands for the linked node."""
    one = edges.filter("kind = 'links_to' AND dst IS NOT NULL").groupBy(F.col("src").alias("id"), "line").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("linked")).filter("n = 1")
    out = hits.join(one.select("id", "line", "linked"), ["id", "line"], "left")
    out = out.withColumn("id", F.when(F.expr(is_index) & F.col("linked").isNotNull(), F.col("linked")).otherwise(F.col("id")))
    return out.groupBy("id").agg(F.max("score").alias("score"))


def span_pairs(points: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of points (path, start, stop, ...) beside each span (path, id, lo, hi) of their path in whose blocks they start.

    Blocks have the size of a power of two. A span is in the one or two blocks of the least size it fits into, a
    point in its block of every size that its path has spans of, so a pair is at most two blocks apart.
    """
    level = F.length(F.bin(F.col("hi").cast("long") - F.col("lo").cast("long")))
    block = lambda c: F.expr(f"shiftright(CAST({c} AS BIGINT), _level)")
    s = spans.filter("lo <= hi").withColumn("_level", level)
    s = s.withColumn("_block", F.explode(F.array_distinct(F.array(block("lo"), block("hi")))))
    p = points.join(s.select("path", "_level").distinct(), "path").withColumn("_block", block("start"))
    return p.join(s, ["path", "_level", "_block"]).drop("_level", "_block")


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (path, start, stop, ...) with `owner`: the id of the narrowest span (path, id, lo, hi) that holds them, or null.

    start is at most stop. Pairs are made only of spans about a point (`span_pairs`); of equal spans the least id.
    """
    key = F.xxhash64(*[F.col(c) for c in points.columns])
    p = points.withColumn("_key", key)
    inside = span_pairs(p, spans).filter("lo <= start AND stop <= hi")
    best = inside.groupBy("_key").agg(F.min_by("id", F.struct(F.col("hi") - F.col("lo"), F.col("id"))).alias("owner"))
    return p.join(best, "_key", "left").drop("_key")


def occurrences(sites: DataFrame, target: str | None = None, owner: str | None = None, name: str | None = None, limit: int = 0) -> DataFrame:
    """Reference sites of a target, an owner or an exact name, in the order owner, line, target."""
    for column, value in (("target", target), ("owner", owner), ("name", name)):
        if value is not None:
            sites = sites.filter(F.col(column) == value)
    return sites.orderBy("owner", "line", "target").limit(clamp_limit(limit, LIMIT, MOST))


def ordered(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.orderBy(*order)))
