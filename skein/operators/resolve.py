"""Binding references to symbols: a ladder of joins in which the first rule that claims a reference decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.names import ancestors, dangling_name, folder_of, is_external, join_path, percent_decode, selector_names

# What an edge of a kind may point at; a kind that is not listed may point at anything.
TARGETS = {
    "calls": ("const", "export", "function", "macro", "method", "variable"),
    "extends": ("class", "impl", "interface", "trait"),
    "implements": ("class", "impl", "interface", "trait"),
    "imports": ("file", "module"),
    "type_uses": ("class", "enum", "impl", "interface", "module", "struct", "trait", "type_alias", "variant"),
}
#: How a reference is told apart here: a Python call of a bare or of a dotted name, and any edge that may point anywhere.
_BARE, _DOTTED, _ANY = "bare python call", "dotted python call", "any"


def admitted(spark) -> DataFrame:
    """asks, to_node: what references may point at, some tens of rows. Python calls may hit classes, methods only by a
    dotted name."""
    rows = [(e, n) for e, kinds in TARGETS.items() for n in kinds]
    rows += [(way, n) for way in (_BARE, _DOTTED) for n in (*TARGETS["calls"], "class") if way == _DOTTED or n != "method"]
    return spark.createDataFrame(rows, "asks string, to_node string")


def asks(refs: DataFrame) -> Column:
    """What a reference (edge_kind, name, perhaps language) asks the kind table for."""
    out = F.when(F.col("edge_kind").isin(*TARGETS), F.col("edge_kind")).otherwise(_ANY)
    if "language" not in refs.columns:
        return out
    call = (F.col("language") == "python") & (F.col("edge_kind") == "calls")
    return F.when(F.coalesce(call, F.lit(False)), F.when(F.col("name").contains("."), _DOTTED).otherwise(_BARE)).otherwise(out)


def _admitting(symbols: DataFrame, keys: list[str], rule: str, imports_any: bool = False) -> DataFrame:
    """keys, asks, <rule>_n, <rule>_id: for each key and way to ask how many symbols there are, and the only one.

    Symbols are counted by key and kind before the kinds are looked at, so a name that many symbols have is one row
    for each kind; what references join has one row for each way to ask.
    """
    by_kind = symbols.dropna(subset=keys).groupBy(*keys, "kind").agg(F.count_distinct("id").alias("_n"), F.min("id").alias("_id"))
    table = admitted(symbols.sparkSession)
    if imports_any:
        table = table.filter("asks <> 'imports'")
    hit = by_kind.join(F.broadcast(table), F.col("kind") == F.col("to_node")).select(*keys, "asks", "_n", "_id")
    free = [_ANY, "imports"] if imports_any else [_ANY]
    hit = hit.unionAll(by_kind.select(*keys, F.explode(F.array(*[F.lit(x) for x in free])), "_n", "_id"))
    return hit.groupBy(*keys, "asks").agg(F.sum("_n").alias(f"{rule}_n"), F.min("_id").alias(f"{rule}_id"))


def resolve(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref, target, rule, resolved, to_name for references (ref, path, edge_kind, name, lexical_key, import_path, import_name, dynamic).

    symbols: (id, path, kind, name, qualified_name, lexical_key, local). The rules in order: a dynamic reference
    dangles; a lexical target must be in the file; an import must be in the file it names; then one compatible
    symbol of that name in the file; one with that qualified name; one not local to a function anywhere. A rule
    that claims a reference and finds nothing or several leaves it dangling: it never falls through to the next.
    With a column `language` Python's rules for calls hold; with a column `bound` (an id that another operator found
    for the reference) that comes right after dynamic. Each rule is one left join of references with a table that has one
    row for their key, so references are neither multiplied nor grouped; a hot name is split by Spark like any key.
    """
    visible = symbols.filter("NOT coalesce(local, false)")
    tables = [
        (_admitting(symbols, ["path", "lexical_key"], "lexical"), {"path": "path", "lexical_key": "lexical_key"}),
        (_admitting(symbols, ["path", "name"], "imported", imports_any=True), {"path": "import_path", "name": "import_name"}),
        (_admitting(visible, ["path", "name"], "same"), {"path": "path", "name": "name"}),
        (_admitting(visible, ["qualified_name"], "qualified"), {"qualified_name": "name"}),
        (_admitting(visible, ["name"], "global"), {"name": "name"}),
    ]
    out = refs.withColumn("_asks", asks(refs))
    for no, (table, on) in enumerate(tables):
        t = table.select(*[F.col(c).alias(f"_{no}_{c}") for c in (*on, "asks")], *[c for c in table.columns if c not in on and c != "asks"])
        cond = [F.col(f"_{no}_asks") == F.col("_asks")] + [F.col(f"_{no}_{c}") == F.col(r) for c, r in on.items()]
        out = out.join(t, cond, "left").drop(*[f"_{no}_{c}" for c in (*on, "asks")])
    one = lambda rule: F.when(F.col(f"{rule}_n") == 1, F.col(f"{rule}_id"))
    say = lambda rule, found: F.struct(F.lit(rule).alias("rule"), found.alias("id"))
    claim = F.when(F.coalesce("dynamic", F.lit(False)), say("dynamic", F.lit(None).cast("string")))
    if "bound" in refs.columns:
        claim = claim.when(F.col("bound").isNotNull(), say("bound", F.col("bound")))
    claim = (
        claim.when(F.col("lexical_key").isNotNull(), say("lexical", one("lexical")))
        .when(F.col("import_path").isNotNull(), say("import", one("imported")))
        .when(F.col("same_n") > 0, say("same_file", one("same")))
        .when((F.col("qualified_n") > 0) & F.col("name").contains("::"), say("qualified", one("qualified")))
        .otherwise(say("global", one("global")))
    )
    out = out.withColumn("c", claim).select("ref", F.col("c.id").alias("target"), F.col("c.rule").alias("rule"), "name")
    return out.select("ref", "target", "rule", F.col("target").isNotNull().alias("resolved"), F.when(F.col("target").isNull(), dangling_name(F.col("name"))).alias("to_name"))


def resolution_counts(refs: DataFrame, bound: DataFrame) -> DataFrame:
    """edge_kind, resolved, unresolved: how many references of each kind (ref, edge_kind) `resolve` bound (ref, resolved)."""
    per = refs.select("ref", "edge_kind").join(bound.select("ref", "resolved"), "ref").groupBy("edge_kind")
    return per.agg(F.count(F.when(F.col("resolved"), 1)).alias("resolved"), F.count(F.when(~F.col("resolved"), 1)).alias("unresolved"))


def unique_globals(symbols: DataFrame) -> DataFrame:
    """name, id of names that exactly one symbol has."""
    return symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter("n = 1").select("name", "id")


def last_binding(symbols: DataFrame) -> DataFrame:
    """path, name, id: of several top-level bindings of a name in a file the last."""
    return symbols.groupBy("path", "name").agg(F.max_by("id", F.struct("start", "id")).alias("id"))


def specifiers(refs: DataFrame, files: DataFrame, suffixes: tuple[str, ...] = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")) -> DataFrame:
    """ref, target: the first file that a relative specifier (ref, path, specifier) may mean, in the order of suffixes."""
    at = join_path(folder_of(F.col("path")), F.col("specifier"))
    tries = refs.filter(F.col("specifier").startswith(".")).select("ref", F.posexplode(F.transform(F.array(*[F.lit(s) for s in suffixes]), lambda s: F.concat(at, s))).alias("no", "candidate"))
    hit = tries.join(files.select(F.col("path").alias("candidate")), "candidate")
    best = hit.groupBy("ref").agg(F.min_by("candidate", "no").alias("target"))
    return refs.select("ref").join(best, "ref", "left")


def exports(modules: DataFrame, wanted: DataFrame, depth: int = 64) -> DataFrame:
    """ref, target: what an imported name of a module stands for; null where nothing or more than one thing.

    modules: (path, name, target, forward_path, forward_name, star): an export of a symbol, one forwarded from another
    module, or `export *` (which never forwards `default`). wanted: (ref, path, name). An explicit export goes before a
    star. Each round follows one forwarding join; no more rounds than `depth`, and none twice through one place.
    """
    from skein.sources.storage import settled

    done, at = None, settled(wanted.select("ref", "path", "name"))
    seen = at
    for _ in range(depth):
        explicit = at.join(modules.filter("NOT star"), ["path", "name"]).select("ref", "path", "name", "target", "forward_path", "forward_name")
        starred = at.join(explicit.select("ref", "path", "name"), ["ref", "path", "name"], "left_anti").filter("name <> 'default'")
        starred = starred.join(modules.filter("star").select("path", F.col("forward_path").alias("fp")), "path").select("ref", F.col("fp").alias("path"), "name")
        found = explicit.filter("target IS NOT NULL").select("ref", "target")
        done = found if done is None else done.unionAll(found)
        nxt = explicit.filter("target IS NULL").select("ref", F.col("forward_path").alias("path"), F.col("forward_name").alias("name")).unionAll(starred)
        at = settled(nxt.distinct().join(seen, ["ref", "path", "name"], "left_anti"))
        if at.isEmpty():
            break
        seen = seen.unionAll(at)
    one = done.groupBy("ref").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).filter("n = 1").drop("n")
    return wanted.select("ref").distinct().join(one, "ref", "left")


def package_owner(files: DataFrame, packages: DataFrame) -> DataFrame:
    """path, package, state: the nearest folder with a manifest decides.

    packages: (folder, name, role): package owns, workspace owns nothing, several manifests or an unreadable one
    leave the ownership incomplete.
    """
    at = packages.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"), F.min("role").alias("role"))
    up = files.select("path", F.explode(ancestors(F.col("path"))).alias("folder")).join(at, "folder")
    best = up.groupBy("path").agg(F.max_by(F.struct("n", "name", "role"), F.length("folder")).alias("b"))
    state = F.when(F.col("b").isNull(), "none").when((F.col("b.n") > 1) | (F.col("b.role") == "unavailable"), "incomplete").when(F.col("b.role") == "workspace", "none").otherwise("package")
    return files.select("path").join(best, "path", "left").withColumn("state", state).select("path", F.when(F.col("state") == "package", F.col("b.name")).alias("package"), "state")


def project_of(files: DataFrame, configs: DataFrame) -> DataFrame:
    """path, config: the nearest folder's tsconfig.json, else its jsconfig.json. configs: (path)."""
    c = configs.select(folder_of(F.col("path")).alias("folder"), F.col("path").alias("config"), F.col("path").endswith("tsconfig.json").alias("ts"))
    up = files.select("path", F.explode(ancestors(F.col("path"))).alias("folder")).join(c, "folder")
    return files.select("path").join(up.groupBy("path").agg(F.max_by("config", F.struct(F.length("folder"), "ts")).alias("config")), "path", "left")


def aliases(refs: DataFrame, patterns: DataFrame) -> DataFrame:
    """ref, no, candidate: what path patterns (pattern, no, substitution) make of bare specifiers (ref, specifier).

    An exact pattern goes first, else the one with the longest part before its `*`, the first of equals.
    """
    p = patterns.withColumn("head", F.regexp_extract("pattern", r"^[^*]*", 0)).withColumn("tail", F.regexp_extract("pattern", r"\*(.*)$", 1)).withColumn("wild", F.col("pattern").contains("*"))
    bare = refs.filter(~F.col("specifier").startswith("."))
    fits = F.when(F.col("wild"), F.col("specifier").startswith(F.col("head")) & F.col("specifier").endswith(F.col("tail")) & (F.length("specifier") >= F.length("head") + F.length("tail"))).otherwise(F.col("specifier") == F.col("pattern"))
    hit = bare.join(F.broadcast(p), fits)  # a project's patterns: tens of rows from one config file
    rank = F.dense_rank().over(W.partitionBy("ref").orderBy(F.col("wild").asc(), F.length("head").desc(), "pattern"))
    hit = hit.withColumn("r", rank).filter("r = 1")
    star = F.expr("substring(specifier, length(head) + 1, length(specifier) - length(head) - length(tail))")
    return hit.select("ref", "no", F.when(F.col("wild"), F.replace("substitution", F.lit("*"), star)).otherwise(F.col("substitution")).alias("candidate"))


def package_exports(refs: DataFrame, maps: DataFrame) -> DataFrame:
    """ref, target: exact keys of package maps (package, key, target) for specifiers (ref, specifier) like name/sub or #key."""
    name = F.regexp_extract("specifier", r"^(@[^/]+/[^/]+|[^/]+)", 1)
    rest = F.expr("substring(specifier, length(_p) + 1)")
    at = refs.withColumn("_p", F.when(F.col("specifier").startswith("#"), F.col("package") if "package" in refs.columns else F.lit("")).otherwise(name))
    at = at.withColumn("key", F.when(F.col("specifier").startswith("#"), F.col("specifier")).otherwise(F.concat(F.lit("."), rest)))
    hit = at.join(maps.filter(~F.col("key").contains("*")).withColumnRenamed("package", "_p"), ["_p", "key"])
    one = hit.groupBy("ref").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).filter("n = 1").drop("n")
    return refs.select("ref").join(one, "ref", "left")


def markup_edges(elements: DataFrame, rules: DataFrame, files: DataFrame) -> DataFrame:
    """src, kind, dst, to_name: elements (id, path, tag, classes array, element_id, href, src, rel) against css rules (id, selector) and files (path).

    A class names rules (uses_class), a rule names ids (selects), a link names a file; edges are distinct.
    """
    none = F.lit(None).cast("string")
    by_class = rules.select(F.col("id").alias("dst"), F.explode(selector_names(F.col("selector"), ".")).alias("name"))
    used = elements.select(F.col("id").alias("src"), F.explode("classes").alias("name")).join(by_class, "name")
    by_id = rules.select(F.col("id").alias("src"), F.explode(selector_names(F.col("selector"), "#")).alias("element_id"))
    selected = by_id.join(elements.select("element_id", F.col("id").alias("dst")), "element_id")
    link = elements.select(F.col("id").alias("src"), "path", "rel", F.explode(F.array_compact(F.array("href", "src"))).alias("link"))
    link = link.filter(~is_external(F.col("link")) & ~F.col("link").startswith("#"))
    clean = percent_decode(F.regexp_replace("link", r"[?#].*$", ""))
    at = F.when(clean.startswith("/"), F.regexp_replace(clean, "^/+", "")).otherwise(join_path(folder_of(F.col("path")), clean))
    kind = F.when(F.coalesce(F.col("rel") == "stylesheet", F.lit(False)), "loads_stylesheet").otherwise("links_to")
    to_file = link.withColumn("at", at).join(files.select(F.col("path").alias("at"), F.col("path").alias("dst")), "at", "left")
    out = used.select("src", F.lit("uses_class").alias("kind"), "dst", none.alias("to_name"))
    out = out.unionAll(selected.select("src", F.lit("selects"), "dst", none))
    out = out.unionAll(to_file.select("src", kind, F.concat(F.lit("file:"), F.col("dst")), F.when(F.col("dst").isNull(), F.col("link"))))
    return out.distinct()


def rebind(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """Occurrences with bindings to nodes that are gone cleared; the site stays."""
    alive = nodes.select(F.col("id").alias("target"), F.lit(True).alias("alive"))
    return sites.join(alive, "target", "left").withColumn("target", F.when(F.col("alive"), F.col("target"))).drop("alive").select(sites.columns)
