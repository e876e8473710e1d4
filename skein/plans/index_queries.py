"""Queries over an index built from a source tree, and over binding, presence and identity operators by themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.extractors.base import populate
from skein.functions import names, text
from skein.operators import context, graph, paths, resolve
from skein.plans.registry import query
from skein.sources import tables as T
from skein.sources import workspace

_LANGUAGES = "(VALUES ('src/', '.rs'), ('py/', '.py'), ('ts/', '.ts')) k(folder, ending)"


def _index(spark, d):
    from skein.plans.explore import Index

    return Index.build(T.tree(spark, d))


def _ids(n: str) -> str:
    """SQL of the id of a region's or nation's function."""
    key = {"region": "r_regionkey", "nation": "n_nationkey"}[n]
    return f"concat('sym:', folder, '{n[0]}', {key}, ending, '#function:{n}_', {key})"


@query("index_calls", f"SELECT {_ids('nation')} AS src, {_ids('region')} AS dst, 1::BIGINT AS sites FROM nation JOIN region ON r_regionkey = n_regionkey, {_LANGUAGES}")
def index_calls(spark, d):
    """Calls that an import, a module path or a specifier leads to the one function meant of three of its name."""
    return _index(spark, d).edges.filter("kind = 'calls'").select("src", "dst", "sites")


@query("index_imports", f"SELECT concat('file:', folder, 'n', n_nationkey, ending) AS src, {_ids('region')} AS dst FROM nation JOIN region ON r_regionkey = n_regionkey, {_LANGUAGES}")
def index_imports(spark, d):
    return _index(spark, d).edges.filter("kind = 'imports'").select("src", "dst")


@query("index_page_links", "SELECT concat('sym:md/n', n_nationkey, '.md#concept:Nation ', n_nationkey) AS src, concat('sym:md/r', n_regionkey, '.md#concept:Region ', n_regionkey) AS dst FROM nation")
def index_page_links(spark, d):
    return _index(spark, d).edges.filter("kind = 'links_to'").select("src", "dst")


@query("index_contains", f"""SELECT concat('file:', folder, 'r', r_regionkey, ending) AS src, {_ids('region')} AS dst FROM region, {_LANGUAGES}
UNION ALL SELECT concat('file:', folder, 'n', n_nationkey, ending), {_ids('nation')} FROM nation, {_LANGUAGES}
UNION ALL SELECT concat('file:md/', k, '.md'), concat('sym:md/', k, '.md#concept:', t) FROM (SELECT concat('r', r_regionkey) AS k, concat('Region ', r_regionkey) AS t FROM region UNION ALL SELECT concat('n', n_nationkey), concat('Nation ', n_nationkey) FROM nation)
UNION ALL SELECT concat('sym:md/', k, '.md#concept:', t), concat('sym:md/', k, '.md#section:', t, '::', t) FROM (SELECT concat('r', r_regionkey) AS k, concat('Region ', r_regionkey) AS t FROM region UNION ALL SELECT concat('n', n_nationkey), concat('Nation ', n_nationkey) FROM nation)""")
def index_contains(spark, d):
    return _index(spark, d).edges.filter("kind = 'contains'").select("src", "dst")


@query("index_files", f"""SELECT concat('file:', path) AS id, path FROM (SELECT concat(folder, 'r', r_regionkey, ending) AS path FROM region, {_LANGUAGES} UNION ALL SELECT concat(folder, 'n', n_nationkey, ending) FROM nation, {_LANGUAGES}
UNION ALL SELECT concat('md/r', r_regionkey, '.md') FROM region UNION ALL SELECT concat('md/n', n_nationkey, '.md') FROM nation)""")
def index_files(spark, d):
    return _index(spark, d).nodes.filter("kind = 'file'").select("id", "path")


@query("resolution_counts", "SELECT 'calls' AS edge_kind, count(*) FILTER (n = 1) AS resolved, count(*) FILTER (n <> 1) AS unresolved FROM (SELECT c_custkey, (SELECT count(*) FROM part WHERE concat('s', p_partkey % 50) = concat('s', c_custkey % 70)) AS n FROM customer)")
def resolution_counts(spark, d):
    cat = lambda a, c: F.concat(F.lit(a), c.cast("string"))
    none = F.lit(None).cast("string")
    symbols = T.table(spark, d, "part").select(cat("p", F.col("p_partkey")).alias("id"), F.lit("f").alias("path"), F.lit("function").alias("kind"), cat("s", F.col("p_partkey") % 50).alias("name"), none.alias("qualified_name"), none.alias("lexical_key"), F.lit(False).alias("local"))
    refs = T.table(spark, d, "customer").select(F.col("c_custkey").alias("ref"), F.lit("g").alias("path"), F.lit("calls").alias("edge_kind"), cat("s", F.col("c_custkey") % 70).alias("name"), none.alias("lexical_key"), none.alias("import_path"), none.alias("import_name"), F.lit(False).alias("dynamic"))
    return resolve.resolution_counts(refs, resolve.resolve(refs, symbols))


@query("kind_compatibility", """SELECT asks, count(*) AS n FROM (SELECT unnest(['const', 'export', 'function', 'macro', 'method', 'variable']) AS k, 'calls' AS asks
UNION ALL SELECT unnest(['class', 'impl', 'interface', 'trait']), 'extends' UNION ALL SELECT unnest(['class', 'impl', 'interface', 'trait']), 'implements' UNION ALL SELECT unnest(['file', 'module']), 'imports'
UNION ALL SELECT unnest(['class', 'enum', 'impl', 'interface', 'module', 'struct', 'trait', 'type_alias', 'variant']), 'type_uses'
UNION ALL SELECT unnest(['class', 'const', 'export', 'function', 'macro', 'variable']), 'bare python call' UNION ALL SELECT unnest(['class', 'const', 'export', 'function', 'macro', 'method', 'variable']), 'dotted python call') GROUP BY asks""")
def kind_compatibility(spark, d):
    return resolve.admitted(spark).groupBy("asks").agg(F.count(F.lit(1)).alias("n"))


@query("module_declarations", """SELECT n_nationkey AS ref, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN concat('src/m', n_nationkey, '.rs') ELSE concat('src/m', n_nationkey, '/mod.rs') END AS target FROM nation""")
def module_declarations(spark, d):
    n = T.table(spark, d, "nation")
    name = F.concat(F.lit("m"), F.col("n_nationkey").cast("string"))
    files = n.filter("n_nationkey % 3 > 0").select(F.concat(F.lit("src/"), name, F.when(F.col("n_nationkey") % 3 == 1, ".rs").otherwise("/mod.rs")).alias("path"))
    return paths.module_files(n.select(F.col("n_nationkey").alias("ref"), F.lit("src/lib.rs").alias("path"), name.alias("name")), files)


@query("anchored_paths", "SELECT c_custkey AS ref, CASE WHEN c_custkey % 2 = 0 THEN concat('n', n_nationkey) END AS target FROM customer JOIN nation ON n_nationkey = c_nationkey")
def anchored_paths(spark, d):
    """crate::<region>::<nation>; every second path names the wrong region."""
    n, r, c = (T.table(spark, d, x) for x in ("nation", "region", "customer"))
    none = F.lit(None).cast("string")
    cat = lambda a, x: F.concat(F.lit(a), x.cast("string"))
    members = r.select(F.lit("crate").alias("owner"), F.col("r_name").alias("name"), cat("r", F.col("r_regionkey")).alias("id"), none.alias("visible_from"), none.alias("forward"))
    members = members.unionAll(n.select(cat("r", F.col("n_regionkey")), "n_name", cat("n", F.col("n_nationkey")), none, none))
    right = F.when(F.col("c_custkey") % 2 == 0, F.col("n_regionkey")).otherwise((F.col("n_regionkey") + 1) % 5)
    asked = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).withColumn("rk", right).join(r, F.col("r_regionkey") == F.col("rk"))
    return paths.walk_paths(asked.select(F.col("c_custkey").alias("ref"), F.lit("crate").alias("scope"), F.array(F.lit("crate"), "r_name", "n_name").alias("segments")), members)


@query("receiver_types", "SELECT c_custkey AS ref, CASE WHEN c_custkey % 3 > 0 THEN concat('R', n_regionkey, '::go') END AS target FROM customer JOIN nation ON n_nationkey = c_nationkey")
def receiver_types(spark, d):
    n, r, c = (T.table(spark, d, x) for x in ("nation", "region", "customer"))
    cat = lambda a, x, b="": F.concat(F.lit(a), F.col(x).cast("string"), F.lit(b))
    types = n.select(cat("N", "n_nationkey").alias("owner"), F.lit("region").alias("name"), cat("R", "n_regionkey").alias("type"))
    members = r.select(cat("R", "r_regionkey").alias("owner"), F.lit("go").alias("name"), cat("R", "r_regionkey", "::go").alias("id"))
    steps = F.array(F.when(F.col("c_custkey") % 3 == 0, "nothing").otherwise("region"))
    return paths.receivers(c.select(F.col("c_custkey").alias("ref"), cat("N", "c_nationkey").alias("owner_type"), steps.alias("steps"), F.lit("go").alias("method")), members, types)


@query("esm_exports", "SELECT c_custkey AS ref, CASE WHEN c_custkey % 4 < 3 THEN concat('t', n_regionkey) END AS target FROM customer JOIN nation ON n_nationkey = c_nationkey")
def esm_exports(spark, d):
    """Nations forward what regions export, even ones by name and others by star; a fourth of what is asked for does not exist."""
    n, r, c = (T.table(spark, d, x) for x in ("nation", "region", "customer"))
    none = F.lit(None).cast("string")
    cat = lambda a, x: F.concat(F.lit(a), F.col(x).cast("string"))
    star = F.col("n_nationkey") % 2 == 1
    modules = r.select(cat("r", "r_regionkey").alias("path"), F.lit("x").alias("name"), cat("t", "r_regionkey").alias("target"), none.alias("forward_path"), none.alias("forward_name"), F.lit(False).alias("star"))
    modules = modules.unionAll(n.select(cat("n", "n_nationkey"), F.when(star, "*").otherwise("x"), none, cat("r", "n_regionkey"), F.when(star, "*").otherwise("x"), star))
    return resolve.exports(modules, c.select(F.col("c_custkey").alias("ref"), cat("n", "c_nationkey").alias("path"), F.when(F.col("c_custkey") % 4 < 3, "x").otherwise("y").alias("name")))


@query("package_maps", "SELECT n_nationkey AS ref, CASE n_nationkey % 3 WHEN 0 THEN concat('main', n_regionkey, '.js') WHEN 1 THEN concat('sub', n_regionkey, '.js') END AS target FROM nation")
def package_maps(spark, d):
    n, r = T.table(spark, d, "nation"), T.table(spark, d, "region")
    pkg = lambda x: F.concat(F.lit("@org/p"), F.col(x).cast("string"))
    at = lambda a: F.concat(F.lit(a), F.col("r_regionkey").cast("string"), F.lit(".js"))
    maps = r.select(pkg("r_regionkey").alias("package"), F.lit(".").alias("key"), at("main").alias("target")).unionAll(r.select(pkg("r_regionkey"), F.lit("./sub"), at("sub")))
    rest = F.element_at(F.array(F.lit(""), F.lit("/sub"), F.lit("/none")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return resolve.package_exports(n.select(F.col("n_nationkey").alias("ref"), F.concat(pkg("n_regionkey"), rest).alias("specifier")), maps)


@query("project_choice", "WITH " + T.NODES_SQL + ", p AS (SELECT DISTINCT path FROM nodes) SELECT path, CASE WHEN path LIKE 'sales/tests/%' THEN 'sales/tests/jsconfig.json' WHEN path LIKE 'sales/%' THEN 'sales/tsconfig.json' WHEN path LIKE 'parts/%' THEN 'parts/tsconfig.json' END AS config FROM p")
def project_choice(spark, d):
    configs = spark.createDataFrame([("sales/tsconfig.json",), ("sales/tests/jsconfig.json",), ("parts/jsconfig.json",), ("parts/tsconfig.json",)], "path string")
    return resolve.project_of(T.nodes(spark, d).select("path").distinct(), configs)


@query("rebinding", "SELECT l_orderkey AS owner, l_linenumber AS line, CASE WHEN p_size < 25 THEN concat('part:', l_partkey) END AS target FROM lineitem JOIN part ON p_partkey = l_partkey")
def rebinding(spark, d):
    """Sites whose target is gone keep their place and lose the binding."""
    part = F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))
    sites = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("line"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target"))
    return resolve.rebind(sites, T.table(spark, d, "part").filter("p_size < 25").select(part.alias("id")))


@query("index_entry_credit", """WITH h AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'index.md' ELSE 'page.md' END AS path, doc_id // 4 AS line, n_chars::DOUBLE AS score FROM documents)
SELECT CASE WHEN path = 'index.md' AND line % 3 > 0 THEN concat('to', line) ELSE concat('own', doc_id) END AS id, max(score) AS score FROM h GROUP BY 1""")
def index_entry_credit(spark, d):
    """A hit on an index page's line with one link counts for the linked page; lines with two links or none do not."""
    docs, i = T.table(spark, d, "documents"), F.col("doc_id")
    line = F.floor(i / 4)
    own = F.concat(F.lit("own"), i.cast("string"))
    hits = docs.select(own.alias("id"), F.when(i % 4 == 0, "index.md").otherwise("page.md").alias("path"), line.alias("line"), F.col("n_chars").cast("double").alias("score"))
    to = lambda a: F.concat(F.lit(a), line.cast("string"))
    links = docs.select(own.alias("src"), F.lit("links_to").alias("kind"), F.explode(F.when(line % 3 == 0, F.array(to("to"), to("too"))).otherwise(F.array(to("to")))).alias("dst"), line.alias("line"))
    return graph.credit_index_links(hits, links)


@query("id_disambiguation", """WITH s AS (SELECT event_id, event_type AS path, concat('u', user_id) AS q, event_id // 3 AS line, printf('%012d', event_id) AS key FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY path, q ORDER BY line, key) AS n, row_number() OVER (PARTITION BY path, q, line ORDER BY key) AS l FROM s)
SELECT event_id, concat('sym:', path, '#function:', q, CASE WHEN n > 1 THEN concat('@', line) ELSE '' END, CASE WHEN l > 1 THEN concat('#', l) ELSE '' END) AS id FROM n""")
def id_disambiguation(spark, d):
    e = T.table(spark, d, "events")
    q = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    symbols = e.select("event_id", F.col("event_type").alias("path"), F.format_string("%012d", "event_id").alias("key"), F.lit(None).cast("string").alias("parent_key"), F.lit("function").alias("kind"), q.alias("name"), q.alias("qualified_name"), F.floor(F.col("event_id") / 3).cast("int").alias("start_line"))
    return populate(symbols)[0].select("event_id", "id")


@query("occurrence_identity", """SELECT l_orderkey, l_linenumber, sha256(concat('{"p0":"', l_orderkey, '","p1":"', l_partkey, '","p2":"', l_linenumber, '"}')) AS id FROM lineitem""")
def occurrence_identity(spark, d):
    return T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", names.occurrence_id(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")).alias("id"))


@query("uncovered_lines", """WITH s AS (SELECT source AS path, doc_id AS rank, unnest(range(doc_id % 40, doc_id % 40 + doc_id % 7 + 1)) AS line FROM documents)
SELECT path, line, min(rank) AS rank FROM s GROUP BY ALL""")
def uncovered_lines(spark, d):
    """Of spans of one file, each line once, for the first span that shows it."""
    at = F.col("doc_id") % 40
    spans = T.table(spark, d, "documents").select(F.col("source").alias("path"), F.lit("h").alias("hash"), F.col("doc_id").alias("rank"), at.alias("start"), (at + F.col("doc_id") % 7).alias("stop"))
    return context.uncovered(spans).drop("hash")


@query("spelled_names", "WITH " + T.NODES_SQL + " SELECT id FROM nodes WHERE lower(qualified_name) LIKE 'geo::nation\\_%' ESCAPE '\\' AND regexp_extract(name, '[0-9]+') IN ('3', '7')")
def spelled_names(spark, d):
    n = T.nodes(spark, d)
    return n.filter(text.spells_name("where is geo nation 3 or nation 7", F.col("qualified_name"))).select("id")


@query("external_urls", "SELECT external, count(*) AS n FROM (SELECT CASE WHEN page_id % 2 = 0 THEN true ELSE false END AS external FROM pages) GROUP BY external")
def external_urls(spark, d):
    u = T.table(spark, d, "pages").select(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^[a-z]+://", "")).alias("u"))
    return u.groupBy(names.is_external(F.col("u")).alias("external")).agg(F.count(F.lit(1)).alias("n"))


@query("percent_decoding", "SELECT doc_id, concat(lang, ' ', source, '/é') AS decoded FROM documents")
def percent_decoding(spark, d):
    return T.table(spark, d, "documents").select("doc_id", names.percent_decode(F.concat("lang", F.lit("%20"), "source", F.lit("%2F%C3%A9"))).alias("decoded"))


@query("bundle_membership", "SELECT concat(source, '/sub/', doc_id, '.md') AS path FROM documents WHERE lang = 'en' AND source IN (SELECT source FROM documents WHERE lang = 'de') UNION ALL SELECT DISTINCT concat(source, '/index.md') FROM documents WHERE lang = 'de'")
def bundle_membership(spark, d):
    """Markdown files at or below a folder with index.md."""
    docs = T.table(spark, d, "documents")
    pages = docs.filter("lang = 'en'").select(F.concat("source", F.lit("/sub/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return workspace.bundle_members(pages.unionAll(docs.filter("lang = 'de'").select(F.concat("source", F.lit("/index.md"))).distinct()))


@query("module_presence", """SELECT DISTINCT path, state FROM (SELECT concat(source, '/', doc_id, '.', lang) AS path, 'file' AS state FROM documents UNION ALL SELECT source, 'directory' FROM documents
UNION ALL SELECT concat(source, '/', doc_id, '.', lang, '/x'), 'obstructed' FROM documents UNION ALL SELECT concat('none/', doc_id), 'missing' FROM documents)""")
def module_presence(spark, d):
    f = T.files(spark, d)
    asked = f.select("path").unionAll(f.select("source")).unionAll(f.select(F.concat("path", F.lit("/x")))).unionAll(f.select(F.concat(F.lit("none/"), F.col("doc_id").cast("string"))))
    return workspace.presence(asked.distinct(), f)


@query("callers_kept", "WITH " + T.NODES_SQL + ", " + T.EDGES_SQL + " SELECT DISTINCT n.id, n.kind FROM nodes n WHERE (n.id = 'nation:3' OR n.id IN (SELECT src FROM edges WHERE dst = 'nation:3')) AND n.kind <> 'function'")
def callers_kept(spark, d):
    """A filter on what is shown: hidden nodes are walked over all the same."""
    e = T.edges(spark, d, ("references", "type_uses"))
    kept, _ = graph.neighborhood(e, T.nodes(spark, d), "nation:3", 1, "in", ("references", "type_uses"), keep="kind <> 'function'")
    return kept.select("id", "kind")
