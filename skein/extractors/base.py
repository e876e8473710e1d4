"""What an extractor returns and how extractors run over files in Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_NODES = 50_000

SYMBOL = "path string, key string, parent_key string, kind string, name string, qualified_name string, signature string, start_line int, end_line int, visibility string, is_async boolean, attributes map<string,string>"
REFERENCE = "path string, kind string, name string, line int, from_key string, import_path string, import_name string, dynamic boolean"


@dataclass
class Facts:
    symbols: list[dict] = field(default_factory=list)
    references: list[dict] = field(default_factory=list)

    def symbol(self, kind: str, name: str, line: int, end: int, parent: str | None = None, signature: str | None = None, visibility: str | None = None, is_async: bool = False, sep: str = "::", **attributes: str) -> str:
        """Adds a symbol below `parent` (a key this returned before) and returns its key."""
        qualified = f"{parent.rsplit('#', 1)[0]}{sep}{name}" if parent else name
        key = f"{qualified}#{len(self.symbols)}"
        self.symbols.append(
            {
                "key": key, "parent_key": parent, "kind": kind, "name": name, "qualified_name": qualified, "signature": (signature or "").strip()[:200] or None,
                "start_line": line, "end_line": end, "visibility": visibility, "is_async": is_async, "attributes": {k: v for k, v in attributes.items() if v is not None},
            }
        )
        return key

    def ref(self, kind: str, name: str, line: int, owner: str | None = None, import_path: str | None = None, import_name: str | None = None, dynamic: bool = False) -> None:
        if name:
            self.references.append({"kind": kind, "name": name, "line": line, "from_key": owner, "import_path": import_path, "import_name": import_name, "dynamic": dynamic})


Extractor = Callable[[str, str], Facts]
REGISTRY: dict[str, Extractor] = {}
EXTENSIONS = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "html": "html", "htm": "html", "css": "css", "svelte": "svelte", "vue": "vue", "astro": "astro", "py": "python", "pyi": "python", "md": "okf",
}


def extractor(*languages: str):
    """Registers a function (path, text) -> Facts for languages: the place where others plug theirs in."""

    def add(f: Extractor) -> Extractor:
        for language in languages:
            REGISTRY[language] = f
        return f

    return add


def language_of(path: str, more: dict[str, str] | None = None) -> str | None:
    return ({**EXTENSIONS, **(more or {})}).get(path.rsplit(".", 1)[-1].lower()) if "." in path.rsplit("/", 1)[-1] else None


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """symbols, references, quarantine (path, reason) of files (path, language, text).

    One Python pass writes both kinds of fact as one table, which is settled and then split. A file that can't be
    parsed or has too many symbols loses its facts and is named with the reason; a language without an extractor
    has no facts.
    """
    from skein.sources.storage import settled

    registry = dict(REGISTRY)
    schema = f"path string, reason string, symbols array<struct<{_struct(SYMBOL)}>>, refs array<struct<{_struct(REFERENCE)}>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, language, text in zip(b["path"], b["language"], b["text"]):
                facts, reason = Facts(), None
                f = registry.get(language)
                if f is not None and text is not None:
                    try:
                        facts = f(path, text)
                    except (SyntaxError, ValueError, RecursionError) as e:
                        facts, reason = Facts(), f"parse: {type(e).__name__}"
                    if len(facts.symbols) > MAX_NODES:
                        facts, reason = Facts(), "too many nodes"
                elif text is None:
                    reason = "not text"
                out.append((path, reason, [{"path": path, **s} for s in facts.symbols], [{"path": path, **r} for r in facts.references]))
            yield pd.DataFrame(out, columns=["path", "reason", "symbols", "refs"])

    facts = settled(files.select("path", "language", "text").mapInPandas(run, schema))
    return (
        facts.select(F.explode("symbols").alias("s")).select("s.*"), facts.select(F.explode("refs").alias("r")).select("r.*"),
        facts.filter("reason IS NOT NULL").select("path", "reason"),
    )


def _struct(ddl: str) -> str:
    return ", ".join(f"{x.split()[0]}: {x.split(None, 1)[1]}" for x in ddl.replace("map<string,string>", "map<string|string>").split(", ")).replace("|", ",")


def populate(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and contains edges: a clash of path, kind and qualified name gets @line, and #n from the second on one line."""
    base = F.concat(F.lit("sym:"), F.col("path"), F.lit("#"), F.col("kind"), F.lit(":"), F.col("qualified_name"))
    same = W.partitionBy("path", "kind", "qualified_name")
    n = F.row_number().over(same.orderBy("start_line", "key"))
    on_line = F.row_number().over(W.partitionBy("path", "kind", "qualified_name", "start_line").orderBy("key"))
    rows = symbols.withColumns({"_n": n, "_l": on_line})
    ident = F.concat(base, F.when(F.col("_n") > 1, F.concat(F.lit("@"), F.col("start_line").cast("string"))).otherwise(""), F.when(F.col("_l") > 1, F.concat(F.lit("#"), F.col("_l").cast("string"))).otherwise(""))
    nodes = rows.withColumn("id", ident).drop("_n", "_l")
    up = nodes.select(F.col("path"), F.col("key").alias("parent_key"), F.col("id").alias("src"))
    edges = nodes.select("path", "parent_key", F.col("id").alias("dst"), "start_line").join(up, ["path", "parent_key"], "left")
    edges = edges.select(F.coalesce("src", F.concat(F.lit("file:"), F.col("path"))).alias("src"), F.lit("contains").alias("kind"), "dst", F.col("start_line").alias("line"))
    return nodes, edges
