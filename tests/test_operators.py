import itertools
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import context, graph, lexical, positional, ranking, resolve, scan


@pytest.fixture
def g(spark):
    """A cycle a-b-c, a self loop at d, parallel edges c-e, a dangling edge, an isolated node f."""
    e = [("a", "calls", "b"), ("b", "calls", "c"), ("c", "calls", "a"), ("d", "calls", "d"), ("c", "calls", "e"), ("c", "imports", "e"), ("e", "calls", None), ("d", "calls", "a")]
    edges = spark.createDataFrame([(s, k, t, i, 1) for i, (s, k, t) in enumerate(e)], "src string, kind string, dst string, line long, sites long")
    nodes = spark.createDataFrame([(x, "function", x.upper(), f"m::{x}", f"{x}.rs", 1) for x in "abcdef"], "id string, kind string, name string, qualified_name string, path string, line long")
    return nodes, edges


def test_rings_visit_once_and_clamp(g):
    _, edges = g
    at = lambda seeds, n, way: {r.id: r.depth for r in graph.rings(edges, seeds, n, way).collect()}
    assert at(["a"], 9, "out") == {"a": 0, "b": 1, "c": 2, "e": 3}
    assert at(["e"], 2, "in") == {"e": 0, "c": 1, "b": 2}
    assert at(["d"], 1, "both") == {"d": 0, "a": 1}
    assert at(["f"], 2, "both") == {"f": 0}


def test_filters_hide_but_do_not_prune(g):
    nodes, edges = g
    kept, inner = graph.neighborhood(edges, nodes, "a", 3, "out", keep="id <> 'b'")
    assert {r.id for r in kept.collect()} == {"a", "c", "e"}
    assert {(r.src, r.dst) for r in inner.collect()} == {("a", "b"), ("b", "c"), ("c", "a"), ("c", "e")}


def test_symbol_and_target(g):
    nodes, _ = g
    assert [(r.id, r.score) for r in graph.find_symbol(nodes, "A").collect()] == [("a", 1.0)]
    assert [(r.id, r.score) for r in graph.find_symbol(nodes, "m::b").collect()] == [("b", 0.9)]
    assert graph.find_symbol(nodes, "a", kind="struct").count() == 0
    assert graph.resolve_target(nodes, "C") == "c"
    with pytest.raises(LookupError):
        graph.resolve_target(nodes, "nothing")


def test_paths_on_all_three_node_graphs(spark):
    pairs = [(x, y) for x in "abc" for y in "abc" if x < y]
    for n in range(len(pairs) + 1):
        for some in itertools.combinations(pairs, n):
            rows = [(x, "calls", y, 1, 1) for x, y in some] or [("z", "calls", "z", 1, 1)]
            edges = spark.createDataFrame(rows, "src string, kind string, dst string, line long, sites long")
            got = [r.id for r in graph.shortest_path(edges, "a", "c").orderBy("place").collect()]
            near = {frozenset(p) for p in some}
            want = ["a", "c"] if frozenset("ac") in near else ["a", "b", "c"] if {frozenset("ab"), frozenset("bc")} <= near else []
            assert got == want, some


def test_connect_components_closure_and_counts(spark, g):
    nodes, edges = g
    assert {(r.src, r.kind, r.dst) for r in graph.connect(edges, ["b", "e"], 2).collect()} == {("b", "calls", "c"), ("c", "calls", "e"), ("c", "imports", "e")}
    assert {r.id: r.component for r in graph.components(edges).collect()} == {x: "a" for x in "abcde"}
    assert {r.id for r in graph.closure(edges, spark.createDataFrame([("e",)], "id string")).collect()} == set("abcde")
    counts = {(r.what, r.kind): r.n for r in graph.graph_counts(nodes, edges).collect()}
    assert counts["nodes", None] == 6 and counts["edges", "calls"] == 7 and counts["edges", None] == 8
    s = graph.caller_summary(edges, "a", 2).first()
    assert (s.direct, s.total) == (2, 3)
    loop = spark.createDataFrame([("x", "calls", "x", 1, 1)], "src string, kind string, dst string, line long, sites long")
    assert [tuple(r) for r in graph.components(loop).collect()] == [("x", "x")]


def test_components_of_long_chains(spark):
    r = random.Random(0)
    names = [f"n{i:03d}" for i in range(200)]
    r.shuffle(names)
    rows = [(names[i], "calls", names[i + 1], 1, 1) for i in range(199) if i % 50 != 49]
    got = {x.id: x.component for x in graph.components(spark.createDataFrame(rows, "src string, kind string, dst string, line long, sites long")).collect()}
    for b in range(0, 200, 50):
        assert {got[n] for n in names[b : b + 50]} == {min(names[b : b + 50])}


def test_smallest_owner(spark):
    spans = spark.createDataFrame([("p", "outer", 1, 20), ("p", "inner", 5, 9), ("p", "twin", 5, 9), ("q", "end", 3, 3)], "path string, id string, lo int, hi int")
    points = spark.createDataFrame([("p", 6, 7), ("p", 9, 10), ("p", 21, 22), ("q", 3, 3)], "path string, start int, stop int")
    assert [(r.start, r.owner) for r in graph.enclosing(points, spans).orderBy("path", "start").collect()] == [(6, "inner"), (9, "outer"), (21, None), (3, "end")]


def test_index_links_are_credited(spark):
    hits = spark.createDataFrame([("file:index.md", "index.md", 3, 0.5), ("x", "b.md", 1, 0.4)], "id string, path string, line int, score double")
    edges = spark.createDataFrame([("file:index.md", "links_to", "concept", 3)], "src string, kind string, dst string, line int")
    assert {r.id: r.score for r in graph.credit_index_links(hits, edges).collect()} == {"concept": 0.5, "x": 0.4}


def test_scans_tell_when_they_cut(spark):
    files = spark.createDataFrame([(f"src/{i:03d}.en", "en", "one\r\nTwo the\n\nlast" if i % 2 else "", 5) for i in range(7)], "path string, language string, text string, bytes long")
    some = scan.find_files(files, "src/*.en", limit=3).collect()
    assert [r.path for r in some] == ["src/000.en", "src/001.en", "src/002.en"] and all(r.truncated for r in some)
    assert not any(r.truncated for r in scan.find_files(files, limit=7).collect())
    assert [(r.path, r.line, r.content) for r in scan.find_text(files, "the", limit=2).collect()] == [("src/001.en", 2, "Two the"), ("src/003.en", 2, "Two the")]
    assert scan.find_text(files, "two", ignore_case=True, include="*1.en").count() == 1
    assert [(r.line, r.content) for r in scan.lines(files.filter("path = 'src/001.en'")).orderBy("line").collect()] == [(1, "one"), (2, "Two the"), (3, ""), (4, "last")]
    assert scan.in_root(files, "src/../src").count() == 7
    with pytest.raises(ValueError):
        scan.in_root(files, "../x")
    raw = spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"a\0b")), ("c", bytearray(b"\xff\xfe")), ("d", bytearray(b"x" * 50))], "path string, content binary")
    assert scan.coverage(scan.classified(raw, 40)).first().asDict() == {"files": 4, "text": 1, "binary": 1, "invalid_utf8": 1, "oversize": 1}


def test_positions_against_brute_force(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(60)]
    units = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for query, gap in (("a b", 0), ("a b a", 2), ("c", 0), ("a a", 1)):
        q, want = query.split(), set()
        for i, t in enumerate(texts):
            w = t.split()
            for stop in range(len(w)):
                starts = [c[0] for c in itertools.combinations(range(stop + 1), len(q)) if c[-1] == stop and [w[x] for x in c] == q and stop - c[0] < len(q) + gap]
                if starts:
                    want.add((i, max(starts), stop))
        assert {tuple(x) for x in positional.phrase(units, "id", query, gap).collect()} == want, query
    for query, window in (("a b", 3), ("a a b", 4), ("c", 1)):
        q, want = sorted(query.split()), set()
        for i, t in enumerate(texts):
            w = t.split()
            for stop in range(len(w)):
                if w[stop] in q:
                    for start in range(stop, max(-1, stop - window), -1):
                        if all(w[start : stop + 1].count(x) >= q.count(x) for x in q):
                            want.add((i, start, stop))
                            break
        assert {tuple(x) for x in positional.near(units, "id", query, window).collect()} == want, query


def test_ranking(spark):
    lane = lambda *ids: spark.createDataFrame([(x, i, False) for i, x in enumerate(ids)], "id string, rank0 int, exact boolean")
    fused = {r.id: r.score for r in ranking.fuse([lane("a", "b"), lane("b", "c")]).collect()}
    assert fused == {"a": round(1 / 61, 6), "b": round(1 / 62 + 1 / 61, 6), "c": round(1 / 62, 6)}
    hits = spark.createDataFrame([("t", "tests/x.rs", 0.9), ("e", "tests/x.rs", 2.0), ("a", "a.rs", 0.5), ("b", "a.rs", 0.4), ("c", "c.rs", 0.3)], "id string, path string, score double")
    late = ranking.defer_tests(hits, "find it", F.col("path").startswith("tests/"))
    assert [r.id for r in late.orderBy("place").collect()] == ["e", "a", "b", "c", "t"]
    assert [r.id for r in ranking.defer_tests(hits, "the tests", F.lit(True)).orderBy("place").collect()] == ["e", "t", "a", "b", "c"]
    assert [r.id for r in ranking.diverse(late, 4, 1).orderBy("slot").collect()] == ["e", "a", "c", "b"]
    rows = spark.createDataFrame([(i, "x" * 10) for i in range(20)], "n int, t string")
    assert ranking.fitting(rows, ["n"], 100).count() == 100 // len('{"n":0,"t":"xxxxxxxxxx"},')
    assert ranking.truncations(files=(5, 3), text=(2, 2)) == [{"kind": "files", "found": 5, "kept": 3}]


def test_bm25_against_plain_python(spark):
    import math

    texts = ["fooBar baz", "foo foo qux", "", "bar bar bar baz"]
    units = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    docs = {0: ["foo", "bar", "baz"], 1: ["foo", "foo", "qux"], 3: ["bar", "bar", "bar", "baz"]}
    avg, n = sum(map(len, docs.values())) / 3, 3
    idf = lambda t: math.log(1 + (n - sum(t in d for d in docs.values()) + 0.5) / (sum(t in d for d in docs.values()) + 0.5))
    score = lambda d, q: sum(idf(t) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / avg)) for t in q if t in d)
    got = {r.id: r.score for r in lexical.body_search(units, "id", "foo bar").collect()}
    assert got == {i: round(score(d, ["bar", "foo"]), 6) for i, d in docs.items()}
    assert lexical.body_search(units, "id", "foo bar", "all").count() == 1 and lexical.body_search(units, "id", "foo", 2).count() == 0 and lexical.body_search(units, "id", "").count() == 0


def test_context():
    assert context.proximity([(1, 1), (5, 2), (6, 1)]) == 250_000 and context.proximity([(3, 3)]) == 500_000 and context.proximity([(1, 1), (9, 1)]) == 0
    pool = [{"id": 1, "terms": {"a"}, "value": 1.0, "bytes": 10}, {"id": 2, "terms": {"a", "b"}, "value": 1.0, "bytes": 10}, {"id": 3, "terms": {"c"}, "value": 0.1, "bytes": 100}]
    assert [c["id"] for c in context.pack(pool, 25)] == [2, 1]
    out, cut = context.fit({"items": [{"x": "y" * 50}] * 40, "edges": [1] * 10}, 1500)
    assert len(out["items"]) < 40 and {c["kind"] for c in cut} == {"payload_edges", "payload_items"}
    with pytest.raises(ValueError):
        context.fit({"meta": "z" * 100}, 50)


def test_excerpts(spark):
    spans = spark.createDataFrame([("p", "h", "r", 1, 5), ("p", "h", "r", 6, 9), ("p", "h", "r", 12, 14), ("p", "h", "s", 10, 11), ("q", "h", "r", 1, 200)], "path string, hash string, role string, start int, stop int")
    got = {(r.path, r.role, r.start, r.stop) for r in context.merged(spans).collect()}
    assert got == {("p", "r", 1, 9), ("p", "r", 12, 14), ("p", "s", 10, 11), ("q", "r", 1, 80), ("q", "r", 81, 160), ("q", "r", 161, 200)}
    shown = spark.createDataFrame([("p", "h", 0, 1, 3), ("p", "h", 1, 2, 5)], "path string, hash string, rank int, start int, stop int")
    assert {(r.line, r["rank"]) for r in context.uncovered(shown).collect()} == {(1, 0), (2, 0), (3, 0), (4, 1), (5, 1)}


def test_resolution_never_falls_through(spark):
    symbols = [
        ("f1", "a.rs", "function", "go", "a::go", "k1", False), ("f2", "b.rs", "function", "go", "b::go", None, False), ("f3", "b.rs", "function", "only", "b::only", None, False),
        ("l1", "b.rs", "function", "hidden", "b::hidden", None, True), ("s1", "a.rs", "struct", "only", "a::only", None, False), ("c1", "a.rs", "concept", "only", "x", None, False),
    ]
    s = spark.createDataFrame(symbols, "id string, path string, kind string, name string, qualified_name string, lexical_key string, local boolean")
    refs = [
        (1, "a.rs", "calls", "go", None, None, None, False), (2, "c.rs", "calls", "go", None, None, None, False), (3, "c.rs", "calls", "b::go", None, None, None, False), (4, "c.rs", "calls", "hidden", None, None, None, False),
        (5, "a.rs", "calls", "go", "zz", None, None, False), (6, "a.rs", "calls", "go", "k1", None, None, False), (7, "c.rs", "calls", "go", None, "b.rs", "go", False), (8, "a.rs", "calls", "go", None, "b.rs", "no", False),
        (9, "a.rs", "calls", "go", None, None, None, True), (10, "c.rs", "type_uses", "only", None, None, None, False),
    ]
    r = spark.createDataFrame(refs, "ref long, path string, edge_kind string, name string, lexical_key string, import_path string, import_name string, dynamic boolean")
    got = {x.ref: (x.target, x.rule) for x in resolve.resolve(r, s).collect()}
    assert got == {
        1: ("f1", "same_file"), 2: (None, "global"), 3: ("f2", "qualified"), 4: (None, "global"), 5: (None, "lexical"), 6: ("f1", "lexical"), 7: ("f2", "import"), 8: (None, "import"), 9: (None, "dynamic"), 10: ("s1", "global"),
    }


def test_modules_packages_aliases(spark):
    m = spark.createDataFrame(
        [("a", "x", "sx", None, None, False), ("i", "y", None, "a", "x", False), ("i", "*", None, "a", "*", True), ("j", "*", None, "i", "*", True), ("k", "*", None, "a", "*", True), ("k", "*", None, "b", "*", True), ("b", "x", "bx", None, None, False), ("loop", "*", None, "loop", "*", True), ("a", "default", "d", None, None, False)],
        "path string, name string, target string, forward_path string, forward_name string, star boolean",
    )
    w = spark.createDataFrame([(1, "i", "y"), (2, "i", "x"), (3, "j", "x"), (4, "k", "x"), (5, "loop", "x"), (6, "i", "default")], "ref long, path string, name string")
    assert {r.ref: r.target for r in resolve.exports(m, w).collect()} == {1: "sx", 2: "sx", 3: "sx", 4: None, 5: None, 6: None}
    files = spark.createDataFrame([("a/b/c.rs",), ("a/x.rs",), ("z.rs",), ("w/y.rs",)], "path string")
    p = spark.createDataFrame([("a", "pa", "package"), ("a/b", "pb", "package"), ("w", "w1", "package"), ("w", "w2", "package")], "folder string, name string, role string")
    assert {r.path: (r.package, r.state) for r in resolve.package_owner(files, p).collect()} == {"a/b/c.rs": ("pb", "package"), "a/x.rs": ("pa", "package"), "z.rs": (None, "none"), "w/y.rs": (None, "incomplete")}
    refs = spark.createDataFrame([(1, "@app/util"), (2, "@app/ui/button"), (3, "./x"), (4, "exact")], "ref long, specifier string")
    patterns = spark.createDataFrame([("@app/*", 0, "src/*"), ("@app/ui/*", 0, "ui/*"), ("@app/ui/*", 1, "ui2/*"), ("exact", 0, "e.ts"), ("*", 0, "any/*")], "pattern string, no int, substitution string")
    assert {(r.ref, r.no, r.candidate) for r in resolve.aliases(refs, patterns).collect()} == {(1, 0, "src/util"), (2, 0, "ui/button"), (2, 1, "ui2/button"), (4, 0, "e.ts")}
    maps = spark.createDataFrame([("pkg", "./sub", "s.js"), ("pkg", ".", "main.js"), ("", "#in", "i.js"), ("pkg", "./w/*", "w.js")], "package string, key string, target string")
    asked = spark.createDataFrame([(1, "pkg/sub"), (2, "pkg"), (3, "#in"), (4, "pkg/w/x")], "ref long, specifier string")
    assert {r.ref: r.target for r in resolve.package_exports(asked, maps).collect()} == {1: "s.js", 2: "main.js", 3: "i.js", 4: None}
    configs = spark.createDataFrame([("tsconfig.json",), ("a/jsconfig.json",), ("a/b/tsconfig.json",), ("a/b/jsconfig.json",)], "path string")
    assert {r.path: r.config for r in resolve.project_of(files, configs).collect()} == {"a/b/c.rs": "a/b/tsconfig.json", "a/x.rs": "a/jsconfig.json", "z.rs": "tsconfig.json", "w/y.rs": "tsconfig.json"}


def test_markup_edges(spark):
    from skein.extractors.html import elements

    pages = spark.createDataFrame([("site/index.html", '<link rel="stylesheet" href="css/a.css"><div id="top" class="x y"></div><a href="../up.html#z">u</a><a href="https://e.org">e</a><a href="/root.html">r</a>')], "path string, text string")
    rules = spark.createDataFrame([("r1", ".x.z"), ("r2", "#top > p"), ("r3", ".x, .q")], "id string, selector string")
    files = spark.createDataFrame([("site/css/a.css",), ("up.html",)], "path string")
    got = {(r.src.rsplit("#", 1)[1] if "#" in r.src else r.src, r.kind, r.dst and r.dst.rsplit("#", 1)[-1], r.to_name) for r in resolve.markup_edges(elements(pages), rules, files).collect()}
    assert got == {
        ("element:1", "uses_class", "r1", None), ("element:1", "uses_class", "r3", None), ("r2", "selects", "element:1", None),
        ("element:0", "loads_stylesheet", "file:site/css/a.css", None), ("element:2", "links_to", "file:up.html", None), ("element:4", "links_to", None, "/root.html"),
    }
    sites = spark.createDataFrame([("o1", "up"), ("o2", "gone")], "id string, target string")
    assert {r.id: r.target for r in resolve.rebind(sites, spark.createDataFrame([("up",)], "id string")).collect()} == {"o1": "up", "o2": None}


def test_regions_and_anchors(spark):
    regions = spark.createDataFrame([("o", i, s, m) for i, s, m in [(0, 2, 0b011), (1, 3, 0b110), (2, 1, 0b001), (3, 1, 0b100)]], "owner string, unit long, score long, mask long")
    assert [(r.unit, r["rank"]) for r in lexical.complementary(regions, "owner", "unit").orderBy("rank").collect()] == [(1, 0), (0, 1)]
    lines = spark.createDataFrame([("p", 1, "foo"), ("p", 2, "foo bar"), ("p", 3, "bar foo")], "k string, line int, content string")
    assert tuple(lexical.anchor_line(lines, "k", ["foo", "bar"]).first()) == ("p", 2, 2)


def test_owners_by_brute_force_without_all_pairs_of_a_path(spark):
    r = random.Random(4)
    spans = [("p", i, lo, lo + r.choice([0, 1, 2, 7, 8, 30, 99])) for i, lo in enumerate(r.sample(range(-5000, 5000), 800))] + [("p", 900, -4000, 4000), ("q", 901, 5, 6)]
    points = [("p", at, at + r.randint(0, 5)) for at in r.sample(range(-5100, 5100), 800)] + [("q", 5, 6), ("r", 5, 6)]
    p, s = spark.createDataFrame(points, "path string, start long, stop long"), spark.createDataFrame(spans, "path string, id long, lo long, hi long")
    want = {}
    for path, start, stop in points:
        held = [(hi - lo, i) for q, i, lo, hi in spans if q == path and lo <= start and stop <= hi]
        want[path, start, stop] = min(held)[1] if held else None
    assert {(x.path, x.start, x.stop): x.owner for x in graph.enclosing(p, s).collect()} == want
    assert graph.span_pairs(p, s).count() < 20 * len(points)


def test_connect_against_all_paths(spark, tmp_path):
    """Several seeds and lengths on random graphs, each with repeated edges, loops and open ends."""
    r = random.Random(3)
    for hops in (1, 2, 3, 4):
        names = [f"n{i}" for i in range(14)]
        rows = [(r.choice(names), r.choice(["calls", "imports"]), r.choice(names)) for _ in range(17)] + [("n0", "calls", None)]
        rows += rows[:3]
        seeds = ["n0", "n3", "n5", "n9", "alone"]
        near = {n: {(y, e) for e in rows if e[2] and e[0] != e[2] for x, y in (e[::2], e[::-2]) if x == n} for n in names}

        def dist(s, near=near):
            at, front, d = {s: 0}, [s], 0
            while front:
                d += 1
                front = sorted({y for x in front for y, _ in near.get(x, ()) if y not in at})
                at |= dict.fromkeys(front, d)
            return at

        far = {s: dist(s) for s in seeds}
        want = {e for a in seeds for b in seeds if a < b and far[a].get(b, 99) <= hops for x in names for y, e in near[x] if far[a].get(x, 99) + 1 + far[b].get(y, 99) == far[a][b]}
        edges = spark.createDataFrame(rows, "src string, kind string, dst string")
        got = [tuple(x) for x in graph.connect(edges, seeds, hops).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want, hops


def test_rounds_do_not_deal_out_the_edges(spark, tmp_path):
    """The join of a traversal with its seeds reads the edges where they lie."""
    spark.range(1000).selectExpr("concat('a', id) AS src", "'calls' AS kind", "concat('b', id % 9) AS dst").write.parquet(f"{tmp_path}/e")
    edges = spark.read.parquet(f"{tmp_path}/e")
    plans, real = [], graph.settled

    def settled(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    graph.settled = settled
    try:
        plans.append(graph.rings(edges, ["b1"], 1, "in")._jdf.queryExecution().executedPlan().toString())
        assert {r.src for r in graph.connect(edges, ["b1", "a1"], 2).collect()} == {"a1"}
    finally:
        graph.settled = real
    assert not any("SortMergeJoin" in p and f"{tmp_path}/e" in p for p in plans)


def test_last_round_of_a_path_keeps_the_goal_only(spark, tmp_path):
    """A hub that the last round comes by is not spread out, nor are the edges dealt out for the join with the start."""
    spark.range(5000).selectExpr("concat('a', id) AS src", "'calls' AS kind", "'hub' AS dst").write.parquet(f"{tmp_path}/e")
    edges = spark.read.parquet(f"{tmp_path}/e")
    sizes, plans, real = [], [], graph.settled

    def settled(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = real(df)
        sizes.append(out.count())
        return out

    graph.settled = settled
    try:
        got = [tuple(r) for r in graph.shortest_path(edges, "a7", "a9", 2).orderBy("place").collect()]
    finally:
        graph.settled = real
    assert got == [(0, "a7", None), (1, "hub", "calls"), (2, "a9", "calls")]
    assert max(sizes) == 1 and not any("SortMergeJoin" in p and f"{tmp_path}/e" in p for p in plans)


def test_impact_nodes_against_the_whole_cone(spark):
    """Every limit gives the head of the whole order, and rings beyond it are not made."""
    r = random.Random(5)
    names = [f"n{i:02d}" for i in range(30)]
    rows = [(r.choice(names), r.choice(["calls", "imports", "cites"]), r.choice(names)) for _ in range(45)] + [(None, "calls", "n00"), ("n01", "calls", "n00"), ("n01", "calls", "n00")]
    edges = spark.createDataFrame(rows, "src string, kind string, dst string")
    nodes = spark.createDataFrame([(x, "function", x, x, f"{x[-1]}.rs", i % 3) for i, x in enumerate(names) if i != 4], "id string, kind string, name string, qualified_name string, path string, line long")
    kinds, sizes, real = ("calls", "imports"), [], graph.settled
    e = [(s, t) for s, k, t in rows if k in kinds]
    for depth in (1, 2, 3):
        at, front = {"n00": 0}, ["n00"]
        for d in range(1, depth + 1):
            front = sorted({s for s, t in e if t in front and s is not None and s not in at})
            at |= dict.fromkeys(front, d)
        row = {x: (f"{x[-1]}.rs", i % 3) for i, x in enumerate(names) if i != 4}
        want = sorted(((d, -sum(t == x and s in at for s, t in e), *row[x], x) for x, d in at.items() if d and x in row))
        for limit in (1, 3, 500):
            got = [(x.depth, -x.degree, x.path, x.line, x.id) for x in graph.impact_nodes(edges, nodes, "n00", depth, kinds, limit, links=edges.union(edges)).collect()]
            assert got == want[:limit], (depth, limit)
    assert len(want) > 3
    graph.settled = lambda df: sizes.append(1) or real(df)
    try:
        graph.impact_nodes(edges, nodes, "n00", 4, kinds, 1)
    finally:
        graph.settled = real
    assert len(sizes) == 3


def test_unique_edges_are_dealt_by_size_and_grouped_once(spark):
    import re

    def plan(n):
        e = spark.range(n).selectExpr("concat('a', id % 50) AS src", "'calls' AS kind", "concat('b', id % 3) AS dst", "1L AS sites")
        return graph.unique_edges(e)

    n = [int(re.search(r"RepartitionByExpression \[edge_id#\d+\], (\d+)", plan(k)._jdf.queryExecution().optimizedPlan().toString())[1]) for k in (10_000, 10_000_000, 60_000_000)]
    assert n[0] == 4 and 5 < n[2] / n[1] < 7
    assert plan(10)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {r.edge_id: r.sites for r in plan(10_000).collect()}
    assert len(got) == 150 and sum(got.values()) == 10_000 and got["(a0)-[calls]->(b0)"] == 67
