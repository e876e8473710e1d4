"""Binding the references of an index: where names come from is settled by joins before the ladder of rules decides."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.names import folder_of
from skein.operators import paths as P
from skein.operators import resolve as R

SCRIPT_SUFFIXES = ("", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".svelte", ".vue", ".astro", ".css", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
#: Functions inside functions that a name is looked for in, from its own outwards.
SCOPES = 8


def rust_modules(files: DataFrame) -> DataFrame:
    """root, module, path of Rust files: src/lib.rs is the module `crate` of its package, src/a/b.rs is crate::a::b."""
    f = files.filter("path LIKE '%.rs'").select("path")
    at = F.regexp_extract("path", r"^(.*?)(?:^|(?<=/))src/(.*)\.rs$", 2)
    root = F.when(at == "", folder_of(F.col("path"))).otherwise(F.regexp_extract("path", r"^(.*?)(?:^|(?<=/))src/", 1))
    inner = F.when(at == "", F.regexp_extract("path", r"([^/]*)\.rs$", 1)).otherwise(at)
    inner = F.regexp_replace(inner, r"(^|/)(mod|lib|main)$", "")
    return f.select(root.alias("root"), F.array_join(F.filter(F.array(F.lit("crate"), F.replace(inner, F.lit("/"), F.lit("::"))), lambda x: x != ""), "::").alias("module"), "path")


def _rust(imports: DataFrame, files: DataFrame) -> DataFrame:
    """ref, target, member of Rust imports: the file of the module, and the name in it; or the file of a module by itself."""
    modules = rust_modules(files)
    own = imports.filter("language = 'rust'").join(modules, "path").select("ref", "root", F.col("module").alias("here"), F.split("name", "::").alias("s"))
    up = F.size(F.filter("s", lambda x: x == "super"))
    parent = F.array_join(F.slice(F.split("here", "::"), 1, F.greatest(F.lit(0), F.size(F.split("here", "::")) - up)), "::")
    rest = F.filter("s", lambda x: ~x.isin("super", "self", "crate"))
    head = F.when(F.get("s", 0) == "crate", F.lit("crate")).when(F.get("s", 0) == "self", F.col("here")).when(F.get("s", 0) == "super", parent)
    full = F.concat(F.array(head), rest)
    own = own.withColumn("full", full).filter("full[0] IS NOT NULL")
    tries = F.array(
        F.struct(F.array_join("full", "::").alias("module"), F.lit(None).cast("string").alias("member")),
        F.struct(F.array_join(F.slice("full", 1, F.size("full") - 1), "::").alias("module"), F.element_at("full", -1).alias("member")),
    )
    asked = own.select("ref", "root", F.posexplode(tries).alias("no", "t")).select("ref", "root", "no", "t.module", "t.member")
    hit = asked.join(modules, ["root", "module"])
    return hit.groupBy("ref").agg(F.min_by(F.struct(F.col("path").alias("target"), "member"), "no").alias("h")).select("ref", "h.target", "h.member")


def _scripts(imports: DataFrame, files: DataFrame) -> DataFrame:
    """ref, target, member of relative JavaScript, TypeScript and style imports."""
    own = imports.filter("language IN ('javascript', 'typescript', 'svelte', 'vue', 'astro', 'css') AND import_path IS NOT NULL")
    found = R.specifiers(own.select("ref", "path", F.col("import_path").alias("specifier")), files, SCRIPT_SUFFIXES)
    return found.join(own.select("ref", "import_name"), "ref").select("ref", "target", F.when(~F.col("import_name").isin("*", "default"), F.col("import_name")).alias("member"))


def _python(imports: DataFrame, files: DataFrame) -> DataFrame:
    """ref, target, member of Python imports: a module of that name from the root or beside the file."""
    own = imports.filter("language = 'python' AND import_path IS NOT NULL").select("ref", "path", "import_path", "import_name")
    join = lambda *parts: F.concat_ws("/", *[F.when(p != "", p) for p in parts])
    none = F.lit(None).cast("string")
    tries, name = [], F.col("import_name")
    for base in (F.lit(""), folder_of(F.col("path"))):
        for end in (".py", "/__init__.py"):
            tries.append(F.when(name.isNotNull(), F.struct(F.concat(join(base, F.col("import_path"), name), F.lit(end)).alias("at"), none.alias("member"))))
            tries.append(F.struct(F.concat(join(base, F.col("import_path")), F.lit(end)).alias("at"), name.alias("member")))
    asked = own.select("ref", F.posexplode(F.array_compact(F.array(*tries))).alias("no", "t")).select("ref", "no", "t.at", "t.member")
    hit = asked.join(files.select(F.col("path").alias("at")), "at")
    return hit.groupBy("ref").agg(F.min_by(F.struct(F.col("at").alias("target"), "member"), "no").alias("h")).select("ref", "h.target", "h.member")


def _pages(refs: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """ref, bound of links and citations of pages."""
    links = refs.filter("language = 'okf' AND edge_kind IN ('links_to', 'cites')")
    roots = files.filter("path LIKE '%index.md'").select(folder_of(F.col("path")).alias("bundle"))
    own = links.select("ref", "path", F.col("name").alias("link"), (F.col("edge_kind") == "cites").alias("cites"), folder_of(F.col("path")).alias("_f"))
    inside = own.join(roots, (F.col("bundle") == "") | (F.col("_f") == F.col("bundle")) | F.col("_f").startswith(F.concat("bundle", F.lit("/"))), "left")
    top = inside.groupBy("ref", "path", "link", "cites").agg(F.coalesce(F.min_by("bundle", F.length("bundle")), F.lit("")).alias("bundle"))
    concepts = nodes.filter("kind = 'concept'").groupBy("path").agg(F.min("id").alias("id"))
    return P.page_links(top, files, concepts).filter("target IS NOT NULL").select("ref", F.col("target").alias("bound"))


def lexical(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """ref, bound: function-local names seen from inside their function; the innermost scope decides, its last name wins.

    One join with the parents for each level outwards, at most SCOPES.
    """
    local = nodes.filter("local").groupBy("path", F.col("parent_key").alias("scope"), "name").agg(F.max_by("id", F.struct("start_line", "id")).alias("id"))
    parent = nodes.select("path", F.col("key").alias("scope"), F.col("parent_key").alias("up"))
    at = refs.filter("from_key IS NOT NULL").select("ref", "path", "name", F.col("from_key").alias("scope"), F.lit(0).alias("depth"))
    at = at.join(local.select("path", "name").distinct(), ["path", "name"], "left_semi")  # only names that are local somewhere in the file
    levels = [at]
    for depth in range(1, SCOPES):
        at = at.join(parent, ["path", "scope"]).filter("up IS NOT NULL").select("ref", "path", "name", F.col("up").alias("scope"), F.lit(depth).alias("depth"))
        levels.append(at)
    hit = functools.reduce(DataFrame.unionAll, levels).join(local, ["path", "scope", "name"])
    return hit.groupBy("ref").agg(F.min_by("id", "depth").alias("bound"))


def _head(name: Column) -> Column:
    return F.regexp_extract(name, r"^[^.:]+", 0)


def bind(refs: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """ref, target, rule, resolved, to_name of references (ref, path, edge_kind, name, from_key, import_path, import_name, dynamic).

    nodes: (id, path, kind, name, qualified_name, key, parent_key, start_line, local); files: (path, language). Imports are led
    to the file they name, by module paths (Rust), specifiers (JavaScript, TypeScript, styles) or module names (Python); a
    file's other references whose first segment an import brings in are looked up there, the last import of a name wins.
    """
    from skein.sources.storage import settled

    refs = refs.join(files.select("path", "language"), "path", "left")
    imports = refs.filter("edge_kind = 'imports'")
    found = functools.reduce(DataFrame.unionAll, (f(imports, files) for f in (_rust, _scripts, _python))).filter("target IS NOT NULL")
    found = settled(found)
    line = F.col("line") if "line" in refs.columns else F.col("ref")
    known = imports.withColumn("_known", F.when(F.col("language") == "rust", F.col("import_name")).when(F.col("language") == "python", F.element_at(F.split("name", r"\."), -1)).otherwise(F.col("name")))
    brought = known.join(found, "ref").groupBy("path", F.col("_known").alias("_head")).agg(F.max_by(F.struct("target", "member"), F.struct(line.alias("line"), F.col("ref"))).alias("_from"))
    out = refs.join(found.select("ref", F.col("target").alias("_file"), F.col("member").alias("_member")), "ref", "left")
    out = out.withColumn("_head", F.when(F.col("edge_kind") != "imports", _head(F.col("name")))).join(brought, ["path", "_head"], "left")
    last = F.element_at(F.split("name", r"\.|::"), -1)
    dotted = last != F.col("name")
    import_path = F.coalesce("_file", F.when(F.col("_from.member").isNull() | ~dotted, F.col("_from.target")))
    import_name = F.when(F.col("edge_kind") == "imports", F.col("_member")).when(F.col("_from.target").isNotNull(), F.coalesce("_from.member", F.when(dotted, last)))
    whole = F.when((F.col("edge_kind") == "imports") & F.col("_file").isNotNull() & F.col("_member").isNull(), F.concat(F.lit("file:"), "_file"))
    by_rule = lexical(refs, nodes).unionAll(_pages(refs, nodes, files))
    out = out.join(by_rule.withColumnRenamed("bound", "_bound"), "ref", "left")
    asked = out.select(
        "ref", "path", "language", "edge_kind", F.when(F.col("name").contains("::"), F.col("name")).otherwise(last).alias("name"), F.lit(None).cast("string").alias("lexical_key"),
        F.when(import_name.isNotNull(), import_path).alias("import_path"), import_name.alias("import_name"), "dynamic", F.coalesce(whole, "_bound").alias("bound"),
    )
    symbols = nodes.filter("kind <> 'file'").select("id", "path", "kind", "name", "qualified_name", F.lit(None).cast("string").alias("lexical_key"), "local")
    return R.resolve(asked, symbols)
