import time

import pytest
from pyspark.sql import functions as F

from skein.operators import paths as P
from skein.plans.budget import WorkBudget, analysis_coverage, deadline, line_postings


def test_module_declarations(spark):
    files = spark.createDataFrame([("src/lib.rs",), ("src/a.rs",), ("src/b/mod.rs",), ("src/a/c.rs",), ("src/b.rs",)], "path string")
    d = spark.createDataFrame([(1, "src/lib.rs", "a"), (2, "src/lib.rs", "b"), (3, "src/a.rs", "c"), (4, "src/a.rs", "zz")], "ref long, path string, name string")
    assert {r.ref: r.target for r in P.module_files(d, files).collect()} == {1: "src/a.rs", 2: "src/b.rs", 3: "src/a/c.rs", 4: None}


def test_paths_and_visibility(spark):
    m = spark.createDataFrame(
        [("crate", "a", "crate::a", None, None), ("crate::a", "f", "fn_f", None, None), ("crate::a", "hidden", "fn_h", "crate::a", None), ("crate", "re", "x", None, "crate::a"), ("crate::a", "twice", "t1", None, None), ("crate::a", "twice", "t2", None, None)],
        "owner string, name string, id string, visible_from string, forward string",
    )
    p = spark.createDataFrame(
        [(1, "crate", ["crate", "a", "f"]), (2, "crate", ["crate", "a", "hidden"]), (3, "crate::a::deep", ["crate", "a", "hidden"]), (4, "crate", ["crate", "re", "f"]), (5, "crate", ["crate", "a", "*"]), (6, "crate", ["crate", "a", "twice"]), (7, "crate", ["crate"]), (8, "crate", ["crate", "no", "f"])],
        "ref long, scope string, segments array<string>",
    )
    assert {r.ref: r.target for r in P.walk_paths(p, m).collect()} == {1: "fn_f", 2: None, 3: "fn_h", 4: "fn_f", 5: None, 6: None, 7: "crate", 8: None}


def test_receivers(spark):
    types = spark.createDataFrame([("S", "field", "T"), ("T", "make", "U"), ("S", "odd", "T"), ("S", "odd", "U")], "owner string, name string, type string")
    members = spark.createDataFrame([("U", "go", "U::go"), ("S", "go", "S::go"), ("T", "go", "T::go")], "owner string, name string, id string")
    calls = spark.createDataFrame([(1, "S", [], "go"), (2, "S", ["field", "make"], "go"), (3, "S", ["odd"], "go"), (4, "S", ["none"], "go"), (5, "S", ["field"], "stop")], "ref long, owner_type string, steps array<string>, method string")
    assert {r.ref: r.target for r in P.receivers(calls, members, types).collect()} == {1: "S::go", 2: "U::go", 3: None, 4: None, 5: None}


def test_page_links(spark):
    files = spark.createDataFrame([("k/a.md",), ("k/b/index.md",), ("k/src/s.md",), ("k/pic.png",)], "path string")
    concepts = spark.createDataFrame([("k/a.md", "A"), ("k/b/index.md", "B")], "path string, id string")
    rows = [(1, "k/b/x.md", "../a.md#h", False), (2, "k/a.md", "b", False), (3, "k/b/x.md", "src/s.md", True), (4, "k/b/x.md", "src/s.md", False), (5, "k/a.md", "https://e.org", False), (6, "k/a.md", "/pic.png?x", False), (7, "k/a.md", "#top", False), (8, "k/b/x.md", "../a", False)]
    links = spark.createDataFrame([(*r, "k") for r in rows], "ref long, path string, link string, cites boolean, bundle string")
    assert {r.ref: r.target for r in P.page_links(links, files, concepts).collect()} == {1: "A", 2: "B", 3: "file:k/src/s.md", 4: None, 5: None, 6: "file:k/pic.png", 7: None, 8: "A"}


def test_root_files(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/x/b.tsx", "node_modules/m/c.ts", "d.js", "e.md", "src/gen/g.ts")], "path string")
    got = lambda c: sorted(r.path for r in P.root_files(files, c).collect())
    assert got({}) == ["d.js", "src/a.ts", "src/gen/g.ts", "src/x/b.tsx"]
    assert got({"include": ["src"], "exclude": ["src/gen"]}) == ["src/a.ts", "src/x/b.tsx"]
    assert got({"files": ["e.md", "./d.js"]}) == ["d.js", "e.md"]


def test_budget(spark):
    b = WorkBudget({"files": 3, "edges": 10_000})
    assert b.limit("files") == 3 and b.limit("edges") == 500 and b.limit("lines") == 250
    rows = spark.range(10)
    assert [r.id for r in b.cut(rows, "files", [F.desc("id")]).collect()] == [9, 8, 7] and b.notices == [{"kind": "files", "found": 4, "kept": 3}]
    lane = WorkBudget({"candidates": 100}).lane()
    assert lane.limit("candidates") == 50
    lane.cut(rows, "candidates", ["id"])
    b.absorb(lane)
    assert b.spent["candidates"] == 10


def test_deadline_interrupts(spark):
    slow = spark.range(0, 64, 1, 4).select(F.udf(lambda x: time.sleep(1) or x, "long")("id"))
    start = time.time()
    with pytest.raises(Exception), deadline(spark, 2) as up:  # noqa: B017  the engine's own cancellation error
        slow.collect()
    assert up.is_set() and time.time() - start < 14
    with deadline(spark, 60) as up:
        assert spark.range(3).count() == 3
    assert not up.is_set()


def test_postings_and_coverage(spark):
    lines = spark.createDataFrame([("p", 1, "fooBar x"), ("p", 3, "foobar FOO")], "path string, line int, content string")
    got = {r.term: (r.lines, r.split, r.whole) for r in line_postings(lines).collect()}
    assert got == {"foo": ([1, 3], True, True), "bar": ([1], True, False), "foobar": ([1, 3], True, True), "x": ([1], True, True)}
    units = spark.createDataFrame([("a", 0, 1, 5, ["h"]), ("a", 1, 6, 6, [])], "path string, unit int, start_line int, end_line int, headings array<string>")
    assert tuple(analysis_coverage(units).first()) == ("a", 2, 6, 1, False)


def test_postings_tokenise_once(spark, tmp_path):
    """A line is split and tokenised once, whatever filters Spark adds, and long lines cost no square; either's terms are told apart."""
    from skein.operators.scan import lines as lines_of

    words = [f"fooBar{i}x b_{i}" for i in range(20_000)]
    spark.createDataFrame([("p", "aB c\n\n" + " ".join(words)), ("q", ""), ("r", None)], "path string, text string").write.parquet(f"{tmp_path}/f")
    files = spark.read.parquet(f"{tmp_path}/f")
    df = line_postings(lines_of(files))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 1 and plan.count("split(lower(regexp_replace(") == 1
    start = time.time()
    got = {r.term: (r.lines, r.split, r.whole) for r in df.collect()}
    assert time.time() - start < 60
    assert got["a"] == ([1], True, False) and got["ab"] == ([1], False, True) and got["c"] == ([1], True, True)
    assert got["foo"] == ([3], True, False) and got["b_7"] == ([3], False, True) and got["foobar7x"] == ([3], False, True)
