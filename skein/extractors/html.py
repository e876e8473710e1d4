"""HTML elements with an id, class, href or src, and the regions of component files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.extractors.base import REGISTRY, Facts, extractor


class _Elements(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, int, dict]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        if any(k in a for k in ("id", "class", "href", "src")):
            self.found.append((tag, self.getpos()[0], a))

    handle_startendtag = handle_starttag


def scan(text: str) -> list[tuple[str, int, dict]]:
    p = _Elements()
    p.feed(text)
    p.close()
    return p.found


@extractor("html")
def html(path: str, text: str) -> Facts:
    facts = Facts()
    for tag, line, a in scan(text):
        name = a.get("id") or a.get("class") or a.get("href") or a.get("src") or tag
        facts.symbol("element", name, line, line, None, f"<{tag}>", tag=tag, **{k if k != "class" else "classes": a[k] for k in ("id", "class", "href", "src", "rel") if k in a})
    return facts


_ELEMENTS = "id string, path string, no int, tag string, line int, element_id string, classes array<string>, href string, src string, rel string"


_TYPES = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in _ELEMENTS.split(", "))])
#: pages that a Python worker is handed, and elements that it hands back, at a time
BATCH, BATCH_OUT = 256, 4096


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements of files (path, text), a bounded number at a time."""
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
    for b in batches:
        rows = []
        for path, text in zip(b.column(0), b.column(1)):
            path = path.as_py()
            for no, (tag, line, a) in enumerate(scan(text.as_py() or "")):
                rows.append((f"sym:{path}#element:{no}", path, no, tag, line, a.get("id"), a.get("class", "").split(), a.get("href"), a.get("src"), a.get("rel")))
                if len(rows) == BATCH_OUT:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


def elements(files: DataFrame) -> DataFrame:
    """The elements of HTML files (path, text) as rows, in document order. A null text has none.

    Lowers the session's rows in an Arrow batch, so that a worker's memory doesn't grow with the files in its task.
    """
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", files.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH:
        conf.set(key, str(BATCH))
    return files.select("path", "text").mapInArrow(_found, _ELEMENTS)


_SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script\s*>", re.S | re.I)
_FRONT = re.compile(r"\A---[ \t]*\r?\n(.*?)^---[ \t]*$", re.S | re.M)


def regions(language: str, text: str) -> list[tuple[str, int, str]]:
    """(language, lines before, source) of script regions, and of an Astro front fence."""
    out = []
    if language == "astro" and (m := _FRONT.search(text)):
        out.append(("typescript", text.count("\n", 0, m.start(1)), m[1]))
    for m in _SCRIPT.finditer(text):
        ts = re.search(r"""lang\s*=\s*["']?(ts|typescript|tsx)""", m[1], re.I)
        out.append(("typescript" if ts or language == "astro" else "javascript", text.count("\n", 0, m.start(2)), m[2]))
    return out


@extractor("svelte", "vue", "astro")
def component(path: str, text: str) -> Facts:
    """The script regions' facts with their lines in the file."""
    facts = Facts()
    language = path.rsplit(".", 1)[-1]
    for inner, before, source in regions(language, text):
        got = REGISTRY[inner](path, source)
        shift = len(facts.symbols)
        moved = {s["key"]: f"{s['key'].rsplit('#', 1)[0]}#{int(s['key'].rsplit('#', 1)[1]) + shift}" for s in got.symbols}
        for s in got.symbols:
            facts.symbols.append({**s, "key": moved[s["key"]], "parent_key": moved.get(s["parent_key"]), "start_line": s["start_line"] + before, "end_line": s["end_line"] + before})
        for r in got.references:
            facts.references.append({**r, "line": r["line"] + before, "from_key": moved.get(r["from_key"])})
    return facts
