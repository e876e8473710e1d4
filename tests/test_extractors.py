from skein.extractors import css, html, markdown, python, scanner  # noqa: F401
from skein.extractors.base import REGISTRY, extract, language_of, populate
from skein.extractors.scanner import use_leaves


def facts(language, path, text):
    f = REGISTRY[language](path, text)
    return {(s["kind"], s["qualified_name"]) for s in f.symbols}, {(r["kind"], r["name"]) for r in f.references}, f


def test_python():
    symbols, refs, f = facts(
        "python", "pkg/mod.py",
        'import os, a.b as ab\nfrom .near import thing as t\nX = 1\ntype Alias = int\n\nclass A(Base, metaclass=M):\n    """Doc."""\n    y: List[int] = []\n    async def m(self, p: Foo) -> Bar:\n        def inner(): pass\n        return t(p).go(os.path.join())\n',
    )
    assert {("variable", "X"), ("type_alias", "Alias"), ("class", "A"), ("field", "A.y"), ("method", "A.m"), ("function", "A.m.inner")} == symbols
    assert {("imports", "os"), ("imports", "a.b"), ("imports", ".near.thing"), ("extends", "Base"), ("calls", "t"), ("calls", "os.path.join"), ("type_uses", "Foo"), ("type_uses", "Bar")} <= refs
    m = next(s for s in f.symbols if s["name"] == "m")
    assert m["is_async"] and m["start_line"] == 9 and m["end_line"] == 11
    assert next(s for s in f.symbols if s["name"] == "inner")["attributes"]["lexical_local"] == "true"
    assert next(r for r in f.references if r["name"] == ".near.thing")["import_path"] == "pkg/near"


def test_rust():
    symbols, refs, f = facts(
        "rust", "lib.rs",
        '''use std::{fmt, io::{self, Read as R}, x::*};
pub mod inner { pub fn deep() {} }
mod file;
/// doc { not a brace
pub struct S<T> { pub a: Vec<Other>, b: char }
struct Tup(i32, Thing);
enum E { One, Two(Payload), Three { x: u8 } }
pub trait Tr { fn need(&self); fn has(&self) -> Res { helper("}") } }
impl<T: Clone> Tr for S<T> where T: Copy { fn need(&self) { self.go(); Self::new(); println!("{}", mac(1)); } }
type Al = Other; const K: usize = 3; static ST: &str = "x;y";
macro_rules! mm { () => { } }
#[cfg(test)] mod tests { #[test] fn works() { let c = '{'; super::call::<u8>(1); } }
pub use self::inner::deep as shallow;
async fn run<'a>(x: &'a str) -> Option<Out> { fn local() {} local(); None }
''',
    )
    want = {
        ("module", "inner"), ("function", "inner::deep"), ("module", "file"), ("struct", "S"), ("field", "S::a"), ("field", "S::b"), ("struct", "Tup"), ("enum", "E"), ("variant", "E::One"), ("variant", "E::Two"), ("variant", "E::Three"),
        ("trait", "Tr"), ("method", "Tr::need"), ("method", "Tr::has"), ("impl", "Tr for S"), ("method", "Tr for S::need"), ("type_alias", "Al"), ("const", "K"), ("static", "ST"), ("macro", "mm"), ("module", "tests"),
        ("function", "tests::works"), ("export", "shallow"), ("function", "run"), ("function", "run::local"),
    }
    assert symbols == want
    assert {("imports", "std::fmt"), ("imports", "std::io"), ("imports", "std::io::Read"), ("imports", "std::x::*"), ("implements", "Tr"), ("calls", "helper"), ("calls", "Self::new"), ("calls", "println"), ("calls", "mac"), ("calls", "super::call"), ("calls", "local"), ("type_uses", "Other"), ("type_uses", "Payload"), ("type_uses", "Out")} <= refs
    assert next(s for s in f.symbols if s["name"] == "works")["attributes"]["test_owned"] == "true"
    assert next(s for s in f.symbols if s["name"] == "run")["is_async"]
    assert use_leaves(["a", "::", "{", "b", ",", "c", "as", "d", ",", "self", "}"]) == [("a::b", "b"), ("a::c", "d"), ("a", "a")]


def test_scripts():
    symbols, refs, f = facts(
        "typescript", "w.ts",
        '''import D, { a as b, type T } from "./m"; import * as ns from 'n'; import "side";
export interface I extends J { x: Foo; run(p: Bar): void }
type Al = Foo | Bar;
export default class C extends Base implements I, K { private y = make(1); static s(): Foo { return new C(); } async #go(z: Bar) { this.y.go(); helper(z) } }
const arrow = async (q: Foo) => { inner(`}`); function loc() {} };
let v = 1; enum Col { Red, Green = 2 }
export { v as w } from "./other"; export * from "./all";
const lazy = () => import("./lazy");
''',
    )
    assert {("interface", "I"), ("type_alias", "Al"), ("class", "C"), ("field", "C.y"), ("method", "C.s"), ("method", "C.#go"), ("function", "arrow"), ("function", "arrow.loc"), ("variable", "v"), ("enum", "Col"), ("variant", "Col.Red"), ("export", "w"), ("export", "*")} <= symbols
    assert {("imports", "D"), ("imports", "b"), ("imports", "ns"), ("imports", "side"), ("extends", "J"), ("extends", "Base"), ("implements", "I"), ("implements", "K"), ("calls", "make"), ("calls", "helper"), ("calls", "inner"), ("exports", "v"), ("type_uses", "Foo")} <= refs
    by = {r["name"]: r for r in f.references if r["kind"] == "imports"}
    assert (by["D"]["import_name"], by["b"]["import_name"], by["ns"]["import_name"], by["b"]["import_path"]) == ("default", "a", "*", "./m")
    symbols, refs, _ = facts("javascript", "a.js", "const x = require('y'); function f() { g(); obj.h(); } class K { m() {} }")
    assert {("function", "f"), ("class", "K"), ("method", "K.m"), ("const", "x")} == symbols and {("imports", "y"), ("calls", "g"), ("calls", "obj.h")} == refs


def test_markup_and_components():
    symbols, _, f = facts("html", "p.html", '<p>x</p><a href="/q">y</a><div id="top" class="a b"><img src="i.png"/></div>')
    assert [(s["name"], s["attributes"]["tag"]) for s in f.symbols] == [("/q", "a"), ("top", "div"), ("i.png", "img")]
    symbols, refs, _ = facts("css", "s.css", '@import url("b.css");\n.a.b, #id { --main: 1; color: "}" }\n/* .no {} */\n@media print { p > q { x: y } }')
    assert symbols == {("css_rule", ".a.b, #id"), ("css_custom_property", ".a.b, #id::--main"), ("css_at_rule", "@media print"), ("css_rule", "@media print::p > q")} and refs == {("imports", "b.css")}
    symbols, _, f = facts("svelte", "c.svelte", '<h1>t</h1>\n<script lang="ts">\nfunction go(a: Foo) { run(); }\n</script>')
    assert symbols == {("function", "go")} and f.symbols[0]["start_line"] == 3 and f.references[0]["line"] == 3
    assert html.regions("astro", "---\nconst a = 1;\n---\n<p/>")[0][:2] == ("typescript", 1)


def test_markdown():
    text = '---\ntitle: "A \\"B\\""\ntags: [x, y]\nsources:\n  - s1.md\n---\n# Top\npara [l](a.md#q) `[no](b)`\nmore\n\n## Sources ##\n- item <https://e.org>\n\n```rust\n# not a heading\n```\n| a | b |\n|---|:-:|\n| 1 | 2 |\n\nSet\n===\n<!-- # no\n-->\n![i](p.png)\n'
    found = markdown.regions(text)
    assert [(r["kind"], r["start"], r["stop"]) for r in found] == [
        ("frontmatter", 1, 6), ("heading", 7, 7), ("paragraph", 8, 9), ("heading", 11, 11), ("list", 12, 12), ("fence", 14, 16), ("table", 17, 19), ("heading", 21, 22), ("html", 23, 24), ("paragraph", 25, 25),
    ]
    assert markdown.ancestry(found)[4] == ["Top", "Sources"] and markdown.ancestry(found)[-1] == ["Set"]
    assert [(x[0], x[1], x[3]) for x in markdown.links(text)] == [(8, "a.md#q", False), (12, "https://e.org", False), (25, "p.png", True)]
    assert markdown.frontmatter(text) == {"title": 'A "B"', "tags": ["x", "y"], "sources": ["s1.md"]}
    symbols, refs, _ = facts("okf", "k.md", text)
    assert ("concept", 'A "B"') in symbols and {("links_to", "a.md#q"), ("cites", "https://e.org"), ("cites", "s1.md")} == refs


def test_units(spark):
    lines = "\n".join(f"line {i}" for i in range(1, 201))
    u = markdown.cut("a.txt", lines, [])
    assert [(x[3], x[4]) for x in u] == [(1, 80), (73, 152), (145, 200)]
    u = markdown.cut("a.py", lines, [("outer", 10, 60), ("inner", 20, 30)])
    assert {(x[3], x[4], x[5]) for x in u} == {(1, 9, None), (10, 19, "outer"), (20, 30, "inner"), (31, 60, "outer"), (61, 140, None), (133, 200, None)}
    assert markdown.cut("e.md", "", []) == [] and len(markdown.cut("x.txt", "one\r\n", [])) == 1
    files = spark.createDataFrame([("a.md", "# H\ntext\n"), ("b.py", lines)], "path string, text string")
    got = markdown.units(files, spark.createDataFrame([("b.py", "s", 5, 9)], "path string, id string, start_line int, end_line int"))
    assert got.count() == 2 + 5 and markdown.violations(got, files).count() == 0


def test_extract_and_populate(spark):
    files = [("a.py", "python", "def f():\n  pass\ndef f():\n  pass\nclass A:\n  def f(self): g()\n"), ("bad.py", "python", "def ("), ("x.bin", None, None), ("n.zz", "zz", "text")]
    symbols, refs, quarantine = extract(spark.createDataFrame(files, "path string, language string, text string"))
    assert {(r.path, r.reason) for r in quarantine.collect()} == {("bad.py", "parse: SyntaxError"), ("x.bin", "not text")}
    nodes, edges = populate(symbols)
    assert {r.id for r in nodes.collect()} == {"sym:a.py#function:f", "sym:a.py#function:f@3", "sym:a.py#class:A", "sym:a.py#method:A.f"}
    assert {(r.src, r.dst) for r in edges.collect()} == {("file:a.py", "sym:a.py#function:f"), ("file:a.py", "sym:a.py#function:f@3"), ("file:a.py", "sym:a.py#class:A"), ("sym:a.py#class:A", "sym:a.py#method:A.f")}
    assert [(r.kind, r.name) for r in refs.collect()] == [("calls", "g")]
    assert language_of("x/y.TSX") == "typescript" and language_of("Makefile") is None and language_of("a.foo", {"foo": "rust"}) == "rust"


def test_html_elements_come_in_bounded_batches(spark):
    import pyarrow as pa

    from skein.extractors import html

    one = "<p class='a b'>" * 3000
    got = list(html._found(iter([pa.RecordBatch.from_pydict({"path": [f"p{i}" for i in range(9)], "text": [one] * 8 + [None]}, schema=pa.schema([("path", pa.string()), ("text", pa.string())]))])))
    assert sum(b.num_rows for b in got) == 8 * 3000 and max(b.num_rows for b in got) <= html.BATCH_OUT
    files = spark.range(5000).selectExpr("cast(id AS string) AS path", "'<a href=x id=y>' AS text")
    e = html.elements(files)
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= html.BATCH
    assert e.count() == 5000 and tuple(e.first())[2:] == (0, "a", 1, "y", [], "x", None, None)
