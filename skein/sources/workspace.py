"""Source trees as tables: listing with ignore rules, contents, configuration and package manifests."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tomllib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.extractors.base import EXTENSIONS, language_of
from skein.functions.globs import _body

# Folders that are never walked, by name.
DEFAULT_EXCLUDES = (".git", "target", "node_modules", "dist", "build", "out", ".venv", "venv", "vendor")


@dataclass(frozen=True)
class WalkPolicy:
    max_files: int = 200_000
    excludes: tuple[str, ...] = DEFAULT_EXCLUDES
    include_hidden: bool = False
    respect_ignore: bool = True
    max_file_bytes: int = 1 << 20
    languages: tuple[str, ...] = ()
    extensions: dict[str, str] = field(default_factory=dict)

    def fingerprint(self) -> str:
        """Tells whether an index was made under the same policy."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def load_config(root: str) -> WalkPolicy:
    """The policy that skein.toml in the root asks for, over the defaults."""
    try:
        t = tomllib.loads(Path(root, "skein.toml").read_text())
    except FileNotFoundError:
        return WalkPolicy()
    given = tuple(t.get("excludes", ()))
    return WalkPolicy(
        excludes=given if t.get("replace_defaults") else (*DEFAULT_EXCLUDES, *given), include_hidden=t.get("include_hidden", False), respect_ignore=t.get("respect_ignore", True),
        max_file_bytes=t.get("max_file_bytes", 1 << 20), languages=tuple(t.get("languages", ())), extensions=t.get("extensions", {}),
    )


class _Ignore:
    """The rules of one ignore file; later ones win, `!` takes back."""

    def __init__(self, folder: str, text: str):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for x in text.splitlines():
            x = x.rstrip()
            if not x or x.startswith("#"):
                continue
            back, only_dir = x.startswith("!"), x.endswith("/")
            p = x.lstrip("!").rstrip("/")
            rooted = "/" in p
            glob = _body(p.lstrip("/"), crosses=False)
            self.rules.append((re.compile("^" + re.escape(folder + "/" if folder else "") + ("" if rooted else "(?:.*/)?") + glob + "$"), not back, only_dir))

    def says(self, path: str, is_dir: bool) -> bool | None:
        out = None
        for pattern, ignored, only_dir in self.rules:
            if (is_dir or not only_dir) and pattern.match(path):
                out = ignored
        return out


@dataclass
class Walk:
    files: list[tuple[str, int, int, str | None]]
    skipped: dict[str, int]
    complete: bool

    def require_complete(self) -> Walk:
        """An incomplete walk must never be taken for deletions."""
        if not self.complete:
            raise RuntimeError("the walk was cut short; what it lacks may still be there")
        return self


def walk(root: str, policy: WalkPolicy | None = None) -> Walk:
    """Files under root in path order with size, mtime and language, and counts of what was left out and why."""
    policy = policy or WalkPolicy()
    out: list[tuple[str, int, int, str | None]] = []
    skipped: dict[str, int] = {}
    complete = True

    def skip(why: str) -> None:
        skipped[why] = skipped.get(why, 0) + 1

    def visit(folder: str, rules: list[_Ignore]) -> None:
        nonlocal complete
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:
            skip("unreadable")
            complete = False
            return
        if policy.respect_ignore:
            for name in (".gitignore", ".ignore"):
                if any(e.name == name for e in entries):
                    rules = [*rules, _Ignore(folder, Path(root, folder, name).read_text(errors="replace"))]
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            is_dir = e.is_dir(follow_symlinks=False)
            if e.is_symlink():
                skip("symlink")
            elif e.name.startswith(".") and not policy.include_hidden:
                skip("hidden")
            elif e.name in policy.excludes and is_dir:
                skip("excluded")
            elif next((s for r in reversed(rules) if (s := r.says(path, is_dir)) is not None), False):
                skip("ignored")
            elif is_dir:
                visit(path, rules)
            elif len(out) >= policy.max_files:
                complete = False
                return
            else:
                st, language = e.stat(), language_of(path, policy.extensions)
                if policy.languages and language not in policy.languages:
                    skip("disabled")
                elif st.st_size > policy.max_file_bytes:
                    skip("oversize")
                else:
                    out.append((path, st.st_size, st.st_mtime_ns, language))

    visit("", [])
    return Walk(sorted(out), skipped, complete)


def read_tree(spark: SparkSession, root: str, walked: Walk) -> DataFrame:
    """path, language, size, mtime_ns, content, content_hash of the walked files, and of no others, read by the executors."""
    listed = spark.createDataFrame(walked.files, "path string, size long, mtime_ns long, language string")
    parts = max(1, min(len(walked.files) // 64, spark.sparkContext.defaultParallelism * 4))
    base = str(Path(root).resolve())

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 64):  # some files' contents at a time
                some = b.iloc[at : at + 64].copy()
                some["content"] = [_content(os.path.join(base, p)) for p in some["path"]]
                yield some[some["content"].notna()]

    read = listed.repartition(parts, "path").mapInPandas(each, "path string, size long, mtime_ns long, language string, content binary")
    return read.select("path", "language", "size", "mtime_ns", "content").withColumn("content_hash", F.sha2("content", 256))


def _content(path: str) -> bytes | None:
    """A file's bytes; None if it is gone since the walk."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except FileNotFoundError:
        return None


def language_table(spark: SparkSession, more: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted({**EXTENSIONS, **(more or {})}.items()), "extension string, language string")


def bundle_members(paths: DataFrame) -> DataFrame:
    """path of Markdown files that belong to a bundle: they or a folder above hold index.md."""
    from skein.functions.names import ancestors, folder_of

    md = paths.filter("path LIKE '%.md'").select("path")
    roots = md.filter(F.regexp_extract("path", "[^/]*$", 0) == "index.md").select(folder_of(F.col("path")).alias("folder")).distinct()
    return md.select("path", F.explode(ancestors(F.col("path"))).alias("folder")).join(roots, "folder", "left_semi").select("path").distinct()


def presence(asked: DataFrame, files: DataFrame) -> DataFrame:
    """path, state of asked paths: file, directory, missing or obstructed (a file stands where a folder is needed)."""
    from skein.functions.names import ancestors

    have = files.select("path")
    folders = have.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    blocked = asked.select("path", F.explode(ancestors(F.col("path"))).alias("up")).join(have.withColumnRenamed("path", "up"), "up", "left_semi").select("path").distinct()
    mark = lambda df, name: df.withColumn(name, F.lit(True))
    out = asked.join(mark(have, "f"), "path", "left").join(mark(folders, "d"), "path", "left").join(mark(blocked, "b"), "path", "left")
    return out.select("path", F.when(F.col("f"), "file").when(F.col("d"), "directory").when(F.col("b"), "obstructed").otherwise("missing").alias("state"))


def strip_jsonc(text: str) -> str:
    """JSON without comments, trailing commas and byte order mark."""
    text = text.removeprefix("\ufeff")
    out = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", out)


def cargo(text: str) -> dict:
    t = tomllib.loads(text)
    p = t.get("package", {})
    targets = [("lib", t["lib"].get("path", "src/lib.rs"))] if "lib" in t else []
    targets += [(k, x.get("path") or f"{d}/{x.get('name')}.rs") for k, d in (("bin", "src/bin"), ("test", "tests"), ("bench", "benches"), ("example", "examples")) for x in t.get(k, [])]
    return {"name": p.get("name"), "role": "package" if p else "workspace", "edition": p.get("edition"), "build": p.get("build"), "members": t.get("workspace", {}).get("members", []), "features": sorted(t.get("features", {})), "targets": targets}


def package_json(text: str) -> dict:
    t = json.loads(text)
    ws = t.get("workspaces", [])
    flat: list[tuple[str, str]] = []

    def conditions(key: str, value) -> None:
        if isinstance(value, str):
            flat.append((key, value))
        elif isinstance(value, dict):
            for c in value.values():
                conditions(key, c)

    for part in ("exports", "imports"):
        v = t.get(part)
        for k, x in v.items() if isinstance(v, dict) and all(k[:1] in ".#" for k in v) else [(".", v)] if v else []:
            conditions(k, x)
    deps = {k: v for d in ("dependencies", "devDependencies", "peerDependencies") for k, v in t.get(d, {}).items()}
    return {"name": t.get("name"), "role": "package" if t.get("name") else "workspace", "main": t.get("main"), "module": t.get("type") == "module", "members": ws.get("packages", []) if isinstance(ws, dict) else ws, "maps": flat, "dependencies": deps, "overrides": sorted({**t.get("overrides", {}), **t.get("resolutions", {})})}


def pnpm_workspace(text: str) -> dict:
    """The membership globs and override keys of a pnpm workspace file."""
    section, out = None, {"members": [], "overrides": []}
    for x in text.splitlines():
        if m := re.match(r"^(\w+):\s*(?:#.*)?$", x):
            section = m[1]
        elif section == "packages" and (m := re.match(r"""^\s+-\s+["']?([^"'#]+?)["']?\s*(?:#.*)?$""", x)):
            out["members"].append(m[1])
        elif section == "overrides" and (m := re.match(r"""^\s+["']?([^"':]+(?:>[^"':]+)?)["']?\s*:""", x)):
            out["overrides"].append(m[1])
    return {"name": None, "role": "workspace", **out}


def pyproject(text: str) -> dict:
    t = tomllib.loads(text)
    return {"name": t.get("project", {}).get("name") or t.get("tool", {}).get("poetry", {}).get("name"), "role": "package"}


def tsconfig(text: str) -> dict:
    t = json.loads(strip_jsonc(text))
    c = t.get("compilerOptions", {})
    return {"extends": t.get("extends"), "files": t.get("files"), "include": t.get("include"), "exclude": t.get("exclude"), "baseUrl": c.get("baseUrl"), "paths": c.get("paths", {}), "outDir": c.get("outDir"), "rootDir": c.get("rootDir")}


def inherit(configs: dict[str, dict], path: str, depth: int = 32) -> dict:
    """A tsconfig with what it extends: its own fields win, base paths stay with the file that gave them."""
    out: dict = {}
    seen: set[str] = set()
    while path in configs and path not in seen and len(seen) < depth:
        seen.add(path)
        own = {k: v for k, v in configs[path].items() if v not in (None, {})}
        if "baseUrl" in own or "paths" in own:
            own.setdefault("base_of", path)
        out = {**own, **out}
        up = configs[path].get("extends")
        if not up:
            break
        path = os.path.normpath(os.path.join(os.path.dirname(path), up))
        path = path if path.endswith(".json") else path + ".json"
    return out


MANIFESTS = {"Cargo.toml": ("cargo", cargo), "package.json": ("node", package_json), "pnpm-workspace.yaml": ("pnpm", pnpm_workspace), "pyproject.toml": ("python", pyproject)}


def manifests(files: DataFrame) -> DataFrame:
    """folder, family, name, role, facts (JSON) of the package manifests among files (path, text); an unreadable one has the role `unavailable`."""
    schema = "path string, folder string, family string, name string, role string, facts string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"]):
                folder, _, file = path.rpartition("/")
                family, parse = MANIFESTS[file]
                try:
                    got = parse(text or "")
                except (ValueError, AttributeError, TypeError):
                    got = {"name": None, "role": "unavailable"}
                rows.append((path, folder, family, got["name"], got["role"], json.dumps(got)))
            yield pd.DataFrame(rows, columns=["path", "folder", "family", "name", "role", "facts"])

    named = files.filter(F.regexp_extract("path", "[^/]*$", 0).isin(*MANIFESTS))
    return named.select("path", "text").mapInPandas(run, schema)


def workspace_members(packages: DataFrame) -> DataFrame:
    """name, folder of Node packages that exactly one workspace pattern set takes in and no other package shares the name with."""
    from skein.functions.globs import anchored_glob

    spaces = [(r["folder"], g) for r in packages.filter("family IN ('node', 'pnpm')").select("folder", "facts").toLocalIterator() for g in json.loads(r["facts"]).get("members", [])]
    member = F.lit(False)
    for folder, g in spaces:
        if not g.startswith("!"):
            member = member | F.col("folder").rlike(anchored_glob(f"{folder}/{g}" if folder else g))
    for folder, g in spaces:
        if g.startswith("!"):
            member = member & ~F.col("folder").rlike(anchored_glob(f"{folder}/{g[1:]}" if folder else g[1:]))
    inside = packages.filter("family = 'node' AND role = 'package'").filter(member)
    return inside.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("folder").alias("folder")).filter("n = 1").drop("n")
