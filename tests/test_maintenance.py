import json

import pytest
from pyspark.sql import functions as F

from skein.maintenance import manifest as M
from skein.maintenance.generations import Store
from skein.sources import workspace as WS

KIND = "path string, size long, mtime_ns long, content_hash string, quarantine string"


def test_classify(spark):
    old = spark.createDataFrame(
        [("same", 1, 1, "h1", None), ("touched", 1, 1, "h2", None), ("edited", 1, 1, "h3", None), ("gone", 1, 1, "h4", None), ("from1", 1, 1, "h5", None), ("from2", 1, 1, "h5", None), ("from3", 1, 1, "h5", None), ("q", 1, 1, "h6", "binary"), ("qmoved", 1, 1, "h7", "binary")], KIND
    )
    new = spark.createDataFrame(
        [("same", 1, 1, "h1", None), ("touched", 1, 2, "h2", None), ("edited", 2, 2, "h3x", None), ("to1", 1, 9, "h5", None), ("to2", 1, 9, "h5", None), ("fresh", 1, 9, "h9", None), ("q", 1, 1, "zz", None), ("qmoved", 1, 5, "h7", None)], KIND
    )
    got = {r.path: (r.change, r.renamed_from) for r in M.classify(old, new).collect()}
    assert got == {
        "same": ("unchanged", None), "touched": ("unchanged", None), "edited": ("modified", None), "gone": ("removed", None), "to1": ("renamed", "from1"), "to2": ("renamed", "from2"), "from3": ("removed", None),
        "fresh": ("added", None), "q": ("unchanged", None), "qmoved": ("modified", None),
    }
    bumped = {r.path: r.change for r in M.classify(old, new, version_bump=True).collect()}
    assert bumped["same"] == "modified" and bumped["fresh"] == "added" and bumped["to1"] == "renamed"
    assert {r.path: r.state for r in M.staleness(old, new).collect()}["touched"] == "changed"
    assert "touched" not in {r.path for r in M.staleness(old, new, content=True).collect()}


def test_surface_ignores_bodies_and_order(spark):
    kind = "path string, kind string, name string, qualified_name string, visibility string, signature string"
    s = lambda rows: M.binding_surface(spark.createDataFrame(rows, kind)).first().surface
    a = [("p", "function", "f", "f", "public", "f()"), ("p", "struct", "S", "S", None, None)]
    assert s(a) == s([a[1], (*a[0][:5], "f(x)")]) != s([a[0], ("p", "struct", "S", "S", "public", None)])


def test_generations(spark, tmp_path):
    store = Store(str(tmp_path))
    with pytest.raises(FileNotFoundError):
        store.open(spark)
    ids = []
    for n in (1, 2, 3):
        with store.writing():
            with pytest.raises(RuntimeError), store.writing():
                pass
            ids.append(store.publish({"t": spark.range(n)}))
    assert store.open(spark)["t"].count() == 3 and store.pointer()["previous"] == ids[1]
    assert store.retain() == [ids[0]] and (tmp_path / f"gen={ids[1]}").exists()
    store.compact(spark)
    assert store.status(spark)["rows"] == {"t": 3}
    bad = json.loads((tmp_path / "current.json").read_text()) | {"versions": {}}
    (tmp_path / "current.json").write_text(json.dumps(bad))
    with pytest.raises(ValueError):
        store.open(spark)


@pytest.fixture
def tree(tmp_path):
    def put(path, text):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())

    put("src/lib.py", 'def parse_header(text):\n    """Reads the header of a message."""\n    return split(text)\n\ndef split(text):\n    return text.split()\n')
    put("src/main.py", "from lib import parse_header\n\ndef run(x):\n    return parse_header(x)\n")
    put("docs/index.md", "# Guide\nHow to read the message header.\n")
    put(".gitignore", "*.log\nbuild2/\n!keep.log\n")
    put("a.log", "no")
    put("keep.log", "yes")
    put("build2/x.py", "no = 1")
    put("node_modules/y.js", "no")
    put(".hidden/z.py", "no = 1")
    put("data.py", b"x = 1\0")
    return tmp_path, put


def test_walk(tree):
    root, put = tree
    w = WS.walk(str(root))
    assert [f[0] for f in w.files] == ["data.py", "docs/index.md", "keep.log", "src/lib.py", "src/main.py"]
    assert w.complete and w.skipped == {"ignored": 2, "excluded": 1, "hidden": 2}
    cut = WS.walk(str(root), WS.WalkPolicy(max_files=2))
    assert not cut.complete
    with pytest.raises(RuntimeError):
        cut.require_complete()
    put("skein.toml", 'excludes = ["docs"]\nlanguages = ["python"]\n')
    assert [f[0] for f in WS.walk(str(root), WS.load_config(str(root))).files] == ["data.py", "src/lib.py", "src/main.py"]
    assert WS.WalkPolicy().fingerprint() != WS.load_config(str(root)).fingerprint()


def test_index_sync_equals_rebuild_and_command_line(spark, tree, tmp_path_factory):
    import shutil

    from skein import cli
    from skein.maintenance import workspace_index as I

    root, put = tree
    at = lambda *a: cli.run(["--root", str(root), "--json", *a], spark)
    assert at("search", "symbol", "run")[0] == cli.EXIT_NO_INDEX and at("nonsense")[0] == cli.EXIT_USAGE
    assert at("index")[0] == cli.EXIT_OK
    found = json.loads(at("search", "symbol", "parse_header")[1])["results"]
    assert [r["id"] for r in found] == ["sym:src/lib.py#function:parse_header"]
    callers = json.loads(at("search", "callers", "parse_header")[1])["results"]
    assert "sym:src/main.py#function:run" in {r["id"] for r in callers}
    out = json.loads(at("search", "explore", "message header")[1])
    assert out["query"]["route"] == "body" and any(r["path"] == "src/lib.py" for r in out["results"])
    assert at("search", "refs", "unknown_name")[0] == cli.EXIT_ERROR
    assert [r["path"] for r in json.loads(at("search", "files", "src/*.py")[1])["results"]] == ["src/lib.py", "src/main.py"]
    assert json.loads(at("search", "text", "parse_header")[1])["results"][0]["line"] == 1
    assert json.loads(at("sync")[1])["results"][0]["changed"] == 0
    put("src/main.py", "from lib import split\n\ndef run(x):\n    return split(x)\n\ndef extra():\n    return run(1)\n")
    (root / "docs/index.md").unlink()
    assert at("status")[0] == cli.EXIT_STALE
    got = json.loads(at("sync")[1])["results"][0]
    assert (got["modified"], got["removed"]) == (1, 1) and at("status")[0] == cli.EXIT_OK
    other = tmp_path_factory.mktemp("rebuild") / "t"
    shutil.copytree(root, other, ignore=shutil.ignore_patterns(".skein"))
    I.reindex(spark, str(other))
    a, b = I.open_index(spark, str(root)), I.open_index(spark, str(other))
    for t in ("nodes", "edges", "units"):
        cols = [c for c in getattr(a, t).columns if c not in ("attributes", "headings")]
        rows = lambda x: sorted(map(str, getattr(x, t).select(cols).collect()))  # noqa: E731, B023
        assert rows(a) == rows(b), t


def test_manifest_readers(spark):
    files = [
        ("Cargo.toml", '[workspace]\nmembers = ["c/*"]\n'), ("c/a/Cargo.toml", '[package]\nname = "a"\nedition = "2021"\n[[bin]]\nname = "t"\n[features]\nx = []\n'),
        ("package.json", '{"workspaces": ["p/*", "!p/no"], "overrides": {"z": "1"}}'), ("p/one/package.json", '{"name": "one", "type": "module", "exports": {".": {"import": "./m.js"}, "./s": "./s.js"}, "dependencies": {"two": "workspace:*"}}'),
        ("p/no/package.json", '{"name": "no"}'), ("p/bad/package.json", "{"), ("pnpm-workspace.yaml", "packages:\n  - 'q/*' # c\noverrides:\n  a>b: 1\n"), ("py/pyproject.toml", '[tool.poetry]\nname = "poem"\n'), ("x/readme.md", ""),
    ]
    m = WS.manifests(spark.createDataFrame(files, "path string, text string"))
    assert {(r.folder, r.family, r.name, r.role) for r in m.collect()} == {
        ("", "cargo", None, "workspace"), ("c/a", "cargo", "a", "package"), ("", "node", None, "workspace"), ("p/one", "node", "one", "package"), ("p/no", "node", "no", "package"), ("p/bad", "node", None, "unavailable"),
        ("", "pnpm", None, "workspace"), ("py", "python", "poem", "package"),
    }
    assert {r["name"]: r.folder for r in WS.workspace_members(m).collect()} == {"one": "p/one"}
    assert json.loads(m.filter("folder = 'p/one'").first().facts)["maps"] == [[".", "./m.js"], ["./s", "./s.js"]]
    assert WS.pnpm_workspace(files[6][1]) == {"name": None, "role": "workspace", "members": ["q/*"], "overrides": ["a>b"]}
    t = WS.tsconfig('\ufeff{ // c\n "extends": "./base", "compilerOptions": {"paths": {"@/*": ["src/*",],},}, /* x */ "include": ["a//b"],}')
    assert t["paths"] == {"@/*": ["src/*"]} and t["include"] == ["a//b"]
    configs = {"p/tsconfig.json": t, "p/base.json": {"extends": None, "baseUrl": ".", "paths": {"x": ["y"]}, "include": ["z"]}}
    got = WS.inherit(configs, "p/tsconfig.json")
    assert got["paths"] == {"@/*": ["src/*"]} and got["baseUrl"] == "." and got["include"] == ["a//b"]


def test_presence_and_bundles(spark):
    files = spark.createDataFrame([("k/index.md",), ("k/sub/a.md",), ("b.md",), ("k/x.py",)], "path string")
    assert {r.path for r in WS.bundle_members(files).collect()} == {"k/index.md", "k/sub/a.md"}
    asked = spark.createDataFrame([("k/x.py",), ("k/sub",), ("nope",), ("b.md/inner",)], "path string")
    assert {r.path: r.state for r in WS.presence(asked, files).collect()} == {"k/x.py": "file", "k/sub": "directory", "nope": "missing", "b.md/inner": "obstructed"}


def test_sync_stream(spark, tmp_path):
    from skein.streaming.sync import FILE_VERSION, sync_stream, windowed_counts

    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "h1", 1, "x", False), ("a", "h2", 2, "y", False), ("b", "h3", 1, "z", True)], FILE_VERSION).coalesce(1).write.parquet(src)
    seen = []
    sync_stream(spark, src, str(tmp_path / "cp"), lambda batch, no: seen.append((no, sorted((r.path, r.content_hash) for r in batch.collect())))).awaitTermination(60)
    assert seen == [(0, [("a", "h2"), ("b", "h3")])]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x"), ("2024-01-01 01:10:00", "y")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.event_type, r.n) for r in windowed_counts(events).collect()) == [("x", 2), ("y", 1)]
