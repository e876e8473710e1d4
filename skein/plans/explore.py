"""Combined retrieval: a route for the query, ranked lanes fused, seeds connected, excerpts packed."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as TX
from skein.functions.globs import anchored_glob
from skein.operators import context, graph, lexical, positional, ranking
from skein.plans.requests import GRAPH_CONTEXT, MAX_TERMS, Envelope, ExploreRequest

POOL_MULTIPLIER, POOL_LEAST, POOL_MOST = 4, 64, 500
PREFIX_ENTRIES = 256


class Index:
    """Tables that explore reads: nodes (with start_line, end_line), edges, units (unit_id, path, start_line, end_line, owner, text), files (path, language, text)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, units: DataFrame, files: DataFrame):
        self.nodes, self.edges, self.units, self.files = nodes, edges, units, files

    @staticmethod
    def facts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Symbols and references of files (path, language, text), each file by itself."""
        from skein.extractors import css, html, markdown, python, scanner  # noqa: F401  they register themselves
        from skein.extractors.base import extract

        symbols, refs, _ = extract(files)
        return symbols, refs

    @classmethod
    def build(cls, files: DataFrame, symbols: DataFrame | None = None, refs: DataFrame | None = None) -> Index:
        """From files (path, language, text): units, and references bound where the ladder can bind them."""
        from skein.extractors import markdown
        from skein.extractors.base import populate
        from skein.plans.binding import bind
        from skein.sources.storage import settled

        if symbols is None or refs is None:
            symbols, refs = cls.facts(files)
        nodes, contains = populate(symbols)
        files_ = files.withColumn("lines", F.size(F.split("text", "\n")))
        node = F.lit(None).cast("string")
        file_nodes = files_.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("kind"), "path", F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.col("path").alias("qualified_name"), node.alias("signature"), F.lit(1).alias("start_line"), F.col("lines").alias("end_line"))
        nodes = settled(nodes.select("id", "kind", "path", "name", "qualified_name", "signature", "start_line", "end_line", "key", "parent_key", "attributes").unionByName(file_nodes, allowMissingColumns=True))
        refs = settled(refs.withColumn("ref", F.monotonically_increasing_id()))
        local = F.coalesce(F.col("attributes")["lexical_local"] == "true", F.lit(False))
        bound = bind(refs.withColumnRenamed("kind", "edge_kind"), nodes.withColumn("local", local), files)
        owner = nodes.select("path", F.col("key").alias("from_key"), F.col("id").alias("owner"))
        sites = refs.join(bound.select("ref", "target", "to_name"), "ref").join(owner, ["path", "from_key"], "left")
        edges = sites.groupBy(F.coalesce("owner", F.concat(F.lit("file:"), "path")).alias("src"), "kind", F.col("target").alias("dst"), "to_name").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("sites"))
        edges = edges.unionByName(contains.withColumn("sites", F.lit(1).cast("long")), allowMissingColumns=True)
        units = markdown.units(files, nodes.filter("kind <> 'file'").select("path", "id", "start_line", "end_line"))
        body = files.select("path", F.split("text", "\r?\n").alias("_l"))
        units = units.join(body, "path").withColumn("text", F.array_join(F.expr("slice(_l, start_line, end_line - start_line + 1)"), "\n")).drop("_l")
        units = units.withColumn("unit_id", F.format_string("%s:%08d", "path", "unit")).withColumn("owner", F.coalesce("owner", F.concat(F.lit("file:"), "path")))
        return cls(nodes.drop("key", "parent_key"), settled(edges), settled(units), files)


def route(index: Index, r: ExploreRequest) -> str:
    """Which way a query goes."""
    o, q = r.options, r.query.strip()
    if o.mode in ("exact", "name", "prefix", "path", "phrase", "near"):
        return o.mode
    if q.startswith(("sym:", "file:")):
        return "exact"
    if o.mode == "auto" and o.exact_fast_path and len(q.split()) == 1 and not index.nodes.filter((F.col("name") == q) | (F.col("qualified_name") == q)).isEmpty():
        return "name"
    if o.ranking != "auto":
        return o.ranking
    return "body" if len(q.split()) > 1 else "fusion"


def seeds(index: Index, r: ExploreRequest, way: str) -> DataFrame:
    """id, score, place of at most k seeds."""
    o, q = r.options, r.query.strip()
    query, _ = TX.strip_task(q) if o.task else (q, [])
    pool = max(POOL_LEAST, min(POOL_MOST, POOL_MULTIPLIER * r.k))
    nodes, units = index.nodes, index.units
    if r.path:  # filters come before every pool, so that they lose no hit
        nodes, units = (x.filter(F.col("path").rlike(anchored_glob(r.path))) for x in (nodes, units))
    if r.language:
        own = index.files.filter(F.col("language") == r.language).select("path")
        nodes, units = (x.join(own, "path", "left_semi") for x in (nodes, units))
    if len(TX.query_terms(query, o.analysis == "identifiers")) > MAX_TERMS:
        raise ValueError("too many terms")
    body = functools.partial(_body_lane, units, query, pool, o)
    if way == "exact":
        hits = nodes.filter(F.col("id") == q).select("id", F.lit(2.0).alias("score"))
    elif way == "name":
        hits = graph.find_symbol(nodes, q, limit=pool).select("id", "score")
    elif way == "prefix":
        starts = F.col("name").startswith(q)
        hits = nodes.filter(starts | F.col("qualified_name").startswith(q)).select("id", F.when(starts, 1.0).otherwise(0.9).alias("score")).orderBy(F.desc("score"), "id").limit(PREFIX_ENTRIES)
    elif way == "path":
        hits = nodes.filter("kind = 'file'").filter(F.col("path").rlike(anchored_glob(q))).select("id", F.lit(1.0).alias("score")).orderBy("id").limit(pool)
    elif way in ("phrase", "near"):
        found = positional.phrase(units, "unit_id", query, o.phrase_gap) if way == "phrase" else positional.near(units, "unit_id", query, o.near_window)
        hits = found.join(index.units.select("unit_id", "owner"), "unit_id").groupBy(F.col("owner").alias("id")).agg(F.min(F.struct("unit_id", "start")).alias("first"))
        hits = ranking.ranked(hits.orderBy("first", "id").limit(pool), ["first", "id"]).select("id", TX.rank_score(F.col("rank0")).alias("score"))
    elif way == "body":
        hits = body()
        if hits.isEmpty():
            hits = lexical.meta_search(nodes.filter("kind <> 'file'"), query, o.match, pool, o.bm25f).select("id", "score")
    elif way == "metadata":
        hits = lexical.meta_search(nodes.filter("kind <> 'file'"), query, o.match, pool, o.bm25f).select("id", "score")
    else:
        meta = lexical.meta_search(nodes.filter("kind <> 'file'"), query, o.match, pool, o.bm25f)
        lanes = [ranking.ranked(meta, [F.desc("score"), "id"]), ranking.ranked(body(), [F.desc("score"), "id"]).withColumn("exact", F.lit(False))]
        hits = ranking.fuse(lanes).select("id", "score")
    hits = hits.join(nodes.select("id", "path", "qualified_name", "attributes"), "id")
    test = TX.test_owned(F.col("path"), F.col("qualified_name"), F.col("attributes")["test_owned"])
    late = test if o.tests == "defer" and way in ("body", "fusion") else F.lit(False)
    placed = ranking.defer_tests(hits, query, late, TX.spells_name(query, F.col("qualified_name")))
    return ranking.diverse(placed, r.k, o.per_file).select("id", "path", "score", F.col("slot").alias("place"))


def _body_lane(units: DataFrame, query: str, pool: int, o) -> DataFrame:
    """id, score: the best region of each owner, then the best owners."""
    hits = lexical.body_search(units, "unit_id", query, o.match, None, whole=o.analysis == "identifiers")
    hits = hits.join(units.select("unit_id", F.col("owner").alias("id")), "unit_id")
    best = hits.groupBy("id").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "id").limit(pool)


def explore(index: Index, r: ExploreRequest) -> Envelope:
    """Seeds with snippets and caller counts, the edges that connect them, and excerpts that fit the payload."""
    from skein.sources.storage import settled

    way = route(index, r)
    top = settled(seeds(index, r, way))
    terms = TX.query_terms(r.query)
    lines = index.files.join(top.select("path").distinct(), "path", "left_semi").select("path", F.posexplode(F.split("text", "\r?\n")).alias("pos", "content")).withColumn("line", F.col("pos") + 1)
    span = top.join(index.nodes.select("id", "kind", "name", "start_line", "end_line"), "id")
    inside = span.join(lines, "path").filter("line BETWEEN start_line AND end_line").select("id", "line", "content")
    at = lexical.anchor_line(inside, "id", terms or [""])
    items = span.join(at, "id", "left").join(index.files.select("path", "text"), "path")
    items = items.select("id", "kind", "name", "path", "score", "place", "start_line", "end_line", context.snippet(F.col("text"), F.coalesce("line", "start_line")).alias("s"))
    rows = [x.asDict(recursive=True) for x in items.orderBy("place").collect()]  # at most k rows
    kinds, impact = GRAPH_CONTEXT[r.options.graph_context]
    ids = [x["id"] for x in rows]
    links = [x.asDict() for x in graph.connect(index.edges.filter(F.col("kind").isin(*kinds)).select("src", "kind", "dst", "line", "sites"), ids, r.hops).limit(graph.MOST).collect()] if kinds and len(ids) > 1 else []
    for x in rows:
        if impact and x["kind"] in ("function", "method"):
            x |= graph.caller_summary(index.edges, x["id"], 2).first().asDict()
    pool = [{"id": x["id"], "terms": [t for t in terms if t in x["s"]["content"].lower()], "value": x["score"], "bytes": len(x["s"]["content"].encode())} for x in rows]
    kept = {c["id"] for c in context.pack(pool, ranking.PAYLOAD_BYTES // 4)}
    for x in rows:
        s = x.pop("s")
        if x["id"] in kept or r.detail == "full":
            x["snippet"] = s
    fitted, cut = context.fit({"items": rows, "edges": links}, ranking.PAYLOAD_BYTES)
    return Envelope("explore", {"query": r.query, "route": way, "terms": terms}, fitted["items"], fitted["edges"], cut, {"seeds": len(rows)})
