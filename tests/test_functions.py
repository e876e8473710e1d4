import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import names as N
from skein.functions import text as T
from skein.functions.globs import anchored_glob, include_glob

CASES = ["HTTPServer", "camelCaseId2X", "snake_case", "ABCd", "getHTTPResponse2x", "über_Straße", "ÀÉcole", "", "a  b", "x1Y2z", "İstanbul", "foo::bar.baz-qux"]


def one(spark, value, *cols, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(*cols).first()


def test_tokenizers_equal_their_driver_twins(spark):
    rows = spark.createDataFrame([(c,) for c in CASES], "x string").select("x", T.split_tokens(F.col("x")).alias("s"), T.whole_tokens(F.col("x")).alias("w")).collect()
    for r in rows:
        assert r.s == T.py_split_tokens(r.x), r.x
        assert r.w == T.py_whole_tokens(r.x), r.x
    assert T.py_split_tokens("getHTTPResponse2x") == ["get", "http", "response2x"]


def test_query_rules():
    assert T.query_terms("how does the FooBar work") == ["bar", "foo", "work"]
    assert T.query_terms("the") == ["the"] and T.query_terms("") == []
    assert T.exact_query("  `Foo::bar()` ") == "foo::bar"
    assert T.asks_about_tests("unit tests for x") and not T.asks_about_tests("testify")
    assert (T.minimum_terms("any", 3), T.minimum_terms("all", 3), T.minimum_terms(2, 3)) == (1, 3, 2)
    assert T.strip_task("Find the parser. Include file paths and line numbers.") == ("Find the parser.", ["Include file paths and line numbers."])
    assert T.strip_task('say "x. Include file paths and line numbers.')[1] == []


def test_test_ownership_and_spelling(spark):
    rows = [("src/tests/a.rs", "a", True), ("src/test_io.py", "a", True), ("view.test.ts", "a", True), ("spec.rs", "a", False), ("x.spec.ts", "a", True), ("src/a.rs", "m::tests::f", True), ("src/contest.rs", "a", False)]
    out = spark.createDataFrame(rows, "p string, q string, want boolean").select(T.test_owned(F.col("p"), F.col("q")).alias("got"), "want", "p").collect()
    assert all(r.got == r.want for r in out), out
    assert one(spark, "parse_header::tests::of", T.spells_name("the parse header code", F.col("x")).alias("s")).s
    assert not one(spark, "parse_footer", T.spells_name("the parse header code", F.col("x")).alias("s")).s


@pytest.mark.parametrize(
    "glob,yes,no",
    [("*.rs", ["a.rs"], ["src/a.rs"]), ("**/*.rs", ["a.rs", "x/y/a.rs"], ["a.rsx"]), ("src/**", ["src/a", "src/a/b"], ["src"]), ("a?c.[jt]s", ["abc.js", "abc.ts"], ["a/c.js", "abc.cs"]), ("{a,b}/*.md", ["a/x.md", "b/y.md"], ["c/x.md"]), ("a+b(1).txt", ["a+b(1).txt"], ["aab1.txt"]), ("[!a]x", ["bx"], ["ax"])],
)
def test_globs(spark, glob, yes, no):
    pattern = anchored_glob(glob)
    df = spark.createDataFrame([(p,) for p in yes + no], "p string").filter(F.col("p").rlike(pattern))
    assert sorted(r.p for r in df.collect()) == sorted(yes)


def test_include_glob_crosses_and_refuses():
    assert re.match(include_glob("src*.rs"), "src/a/b.rs")
    for bad in ("", "a,b", "!x"):
        with pytest.raises(ValueError):
            include_glob(bad)


@settings(max_examples=60, deadline=None)
@given(st.text("abc/.*?", min_size=1, max_size=8))
def test_any_glob_compiles(glob):
    if glob.strip():
        re.compile(anchored_glob(glob))


def test_names(spark):
    r = one(spark, "a\n  .b ::  c", N.dangling_name(F.col("x")).alias("d"))
    assert r.d == "a.b::c"
    long = "é" * 100
    r = one(spark, long, N.dangling_name(F.col("x")).alias("d"), N.truncate_line(F.col("x"), 41).alias("t"), N.truncate_line(F.col("x"), 400).alias("u"))
    assert len(r.d.encode()) <= 96 and r.d.startswith("é" * 40) and r.t == "é" * 20 + "…" and r.u == long
    for limit in range(1, 12):
        text = "aé日𝄞b"
        got = one(spark, text, N.cut_bytes(F.col("x"), limit).alias("c")).c
        want = text.encode()[:limit].decode(errors="ignore")
        assert got == want, limit
    assert one(spark, "../x/./y.ts", N.join_path(F.lit("a/b"), F.col("x")).alias("p")).p == "a/x/y.ts"
    assert one(spark, "../../../y", N.join_path(F.lit("a/b"), F.col("x")).alias("p")).p is None
    assert one(spark, "a/b/c.py", N.ancestors(F.col("x")).alias("a"), N.folder_of(F.col("x")).alias("f")).asDict() == {"a": ["", "a", "a/b"], "f": "a/b"}
    assert one(spark, ".a.b-c > #id, p.x", N.selector_names(F.col("x"), ".").alias("c"), N.selector_names(F.col("x"), "#").alias("i")).asDict() == {"c": ["a", "b-c", "x"], "i": ["id"]}
    assert one(spark, "a%20b+c", N.percent_decode(F.col("x")).alias("p")).p == "a b+c"
    assert [one(spark, u, N.is_external(F.col("x")).alias("e")).e for u in ("https://x", "//x", "mailto:a", "a/b", "/c")] == [True, True, True, False, False]
    assert (N.clamp_limit(0, 100, 1000), N.clamp_limit(5000, 100, 1000), N.clamp_limit(7, 100, 1000)) == (100, 1000, 7)
