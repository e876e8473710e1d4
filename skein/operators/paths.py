"""Binding by paths: module declarations, paths through modules, receivers, links of pages, root files of a project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.globs import anchored_glob
from skein.functions.names import folder_of, is_external, join_path, percent_decode
from skein.sources.storage import settled

MAX_SEGMENTS = 256


def module_files(declarations: DataFrame, files: DataFrame) -> DataFrame:
    """ref, target: the file that `mod name;` (ref, path, name) in a file means: name.rs, then name/mod.rs, beside a root
    file (lib, main, mod) or in the folder that the file is named after."""
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    base = F.when(stem.isin("lib", "main", "mod", "build"), folder_of(F.col("path"))).otherwise(F.concat_ws("/", folder_of(F.col("path")), stem))
    tries = F.array(*[join_path(base, F.concat(F.col("name"), F.lit(end))) for end in (".rs", "/mod.rs")])
    hit = declarations.select("ref", F.posexplode(tries).alias("no", "candidate")).join(files.select(F.col("path").alias("candidate")), "candidate")
    return declarations.select("ref").join(hit.groupBy("ref").agg(F.min_by("candidate", "no").alias("target")), "ref", "left")


def walk_paths(paths: DataFrame, members: DataFrame) -> DataFrame:
    """ref, target of anchored paths (ref, scope, segments array) through members (owner, name, id, visible_from, forward).

    A step joins on (owner, name); a member is seen if it is public (visible_from null) or the scope is at or below
    visible_from. `forward` (an id) is a re-export: the walk goes on there. `crate`, `self` and `super` must be resolved to
    an id as the first segment. A glob segment, an unseen or a doubtful member leaves the path dangling. One join for
    each segment of the longest path, at most MAX_SEGMENTS.
    """
    m = members.select(F.col("owner").alias("at"), "name", F.coalesce("forward", "id").alias("to"), "visible_from")
    at = settled(paths.filter((F.size("segments") > 1) & (F.size("segments") <= MAX_SEGMENTS)).select("ref", "scope", F.element_at("segments", 1).alias("at"), F.expr("slice(segments, 2, size(segments))").alias("rest")))
    done = paths.filter(F.size("segments") == 1).select("ref", F.element_at("segments", 1).alias("target"))
    while not at.isEmpty():
        step = at.withColumn("name", F.element_at("rest", 1)).filter("name <> '*'").join(m, ["at", "name"])
        seen = F.col("visible_from").isNull() | (F.col("scope") == F.col("visible_from")) | F.col("scope").startswith(F.concat(F.col("visible_from"), F.lit("::")))
        one = step.filter(seen).groupBy("ref").agg(F.count_distinct("to").alias("n"), F.first("to").alias("at"), F.first("scope").alias("scope"), F.first("rest").alias("rest")).filter("n = 1")
        one = settled(one.select("ref", "scope", "at", F.expr("slice(rest, 2, size(rest))").alias("rest")))
        done = done.unionAll(one.filter("size(rest) = 0").select("ref", F.col("at").alias("target")))
        at = one.filter("size(rest) > 0")
    return paths.select("ref").join(done, "ref", "left")


def receivers(calls: DataFrame, members: DataFrame, types: DataFrame) -> DataFrame:
    """ref, target of calls (ref, owner_type, steps array, method): the method of the type that the steps lead to.

    steps name fields or methods from owner_type on; types (owner, name, type) states what each has or returns, members
    (owner, name, id) the methods. A type that is not stated, or stated twice, ends the walk with null, and the ladder
    of rules goes on.
    """
    t = types.groupBy(F.col("owner").alias("at"), F.col("name").alias("step")).agg(F.count_distinct("type").alias("n"), F.first("type").alias("to")).filter("n = 1").drop("n")
    at = settled(calls.select("ref", F.col("owner_type").alias("at"), "steps", "method"))
    ready = at.filter("size(steps) = 0")
    while not (todo := at.filter("size(steps) > 0")).isEmpty():
        at = settled(todo.withColumn("step", F.element_at("steps", 1)).join(t, ["at", "step"]).select("ref", F.col("to").alias("at"), F.expr("slice(steps, 2, size(steps))").alias("steps"), "method"))
        ready = ready.unionAll(at.filter("size(steps) = 0"))
    m = members.select(F.col("owner").alias("at"), F.col("name").alias("method"), "id")
    one = ready.join(m, ["at", "method"]).groupBy("ref").agg(F.count_distinct("id").alias("n"), F.first("id").alias("target")).filter("n = 1").drop("n")
    return calls.select("ref").join(one, "ref", "left")


def page_links(links: DataFrame, files: DataFrame, concepts: DataFrame) -> DataFrame:
    """ref, target of page links (ref, path, link, cites, bundle): the concept of the page meant, else its file, else null.

    Tried in order: beside the page, with .md, its index.md; a citation also from the bundle's root. External links and
    anchors dangle. concepts: (path, id).
    """
    clean = percent_decode(F.regexp_replace("link", r"[?#].*$", ""))
    rooted = clean.startswith("/")
    here = F.when(rooted, join_path(F.col("bundle"), F.regexp_replace(clean, "^/+", ""))).otherwise(join_path(folder_of(F.col("path")), clean))
    from_root = F.when(F.col("cites"), join_path(F.col("bundle"), clean))
    forms = [f(p) for p in (here, from_root) for f in (lambda p: p, lambda p: F.concat(p, F.lit(".md")), lambda p: F.concat(p, F.lit("/index.md")))]
    asked = links.filter(~is_external(F.col("link")) & ~F.col("link").startswith("#") & (clean != "")).select("ref", F.posexplode(F.array(*forms)).alias("no", "at"))
    hit = asked.filter("at IS NOT NULL").join(files.select(F.col("path").alias("at")), "at").join(concepts.select(F.col("path").alias("at"), "id"), "at", "left")
    best = hit.groupBy("ref").agg(F.min_by(F.coalesce("id", F.concat(F.lit("file:"), F.col("at"))), "no").alias("target"))
    return links.select("ref").join(best, "ref", "left")


def root_files(files: DataFrame, config: dict, folder: str = "") -> DataFrame:
    """path of the files a project takes in: `files`, or those that fit `include` (all, without either), less `exclude`."""
    base = folder + "/" if folder else ""

    def pattern(p: str) -> str:
        p = p.removeprefix("./")
        last = p.rsplit("/", 1)[-1]
        return anchored_glob(base + (p if "*" in last or "." in last else p + "/**/*"))

    source = F.col("path").rlike(r"\.(ts|tsx|mts|cts|js|jsx|mjs|cjs)$")
    named = F.col("path").isin(*[base + f.removeprefix("./") for f in config.get("files") or []]) if config.get("files") else F.lit(False)
    include = config.get("include") or ([] if config.get("files") else ["**/*"])
    taken, out = F.lit(False), F.lit(False)
    for p in include:
        taken = taken | F.col("path").rlike(pattern(p))
    for p in config.get("exclude") or ["node_modules", "bower_components", "jspm_packages"]:
        out = out | F.col("path").rlike(pattern(p))
    return files.filter(named | (source & taken & ~out)).select("path")
