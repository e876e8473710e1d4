"""Markdown structure, knowledge-bundle facts, and the cut of texts into units."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from skein.extractors.base import Facts, extractor

UNIT_LINES, OVERLAP, UNITS_A_FILE = 80, 8, 8_192
LINKS_A_BLOCK, LINKS_A_FILE = 256, 4_096
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`\s]*)")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_LIST = re.compile(r"^ {0,3}(?:[-*+]|\d{1,9}[.)])[ \t]+")
_RULE = re.compile(r"^ {0,3}(?:\|?\s*:?-+:?\s*)(?:\|\s*:?-+:?\s*)*\|?\s*$")
_HTML = [(r"^ {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", r"</(?:script|pre|style|textarea)>"), (r"^ {0,3}<!--", r"-->"), (r"^ {0,3}<\?", r"\?>"), (r"^ {0,3}<![A-Za-z]", r">"), (r"^ {0,3}<!\[CDATA\[", r"\]\]>")]
_LINK = re.compile(r"(!?)\[((?:\\.|[^\]\\])*)\]\(\s*(?:<([^>\n]*)>|([^)\s]*))(?:\s+[\"'(].*?[\"')])?\s*\)|<([A-Za-z][A-Za-z0-9+.-]*:[^<>\s]*)>")


def lines_of(text: str) -> list[str]:
    out = text.split("\n")
    if out[-1] == "":
        out.pop()
    return [x[:-1] if x.endswith("\r") else x for x in out]


def cells(line: str) -> int:
    body = re.sub(r"\\\|", "", line.strip())
    return body.strip("|").count("|") + 1 if "|" in body else 0


def regions(text: str) -> list[dict]:
    """kind, start, stop (lines from 1), level and title of headings, info of fences: front matter, fences, opaque HTML
    blocks, headings, tables, lists and paragraphs, in order and without overlap."""
    lines, out, i = lines_of(text), [], 0
    add = lambda kind, a, b, **x: out.append({"kind": kind, "start": a + 1, "stop": b + 1, **x})
    if lines and lines[0].rstrip() == "---" and "---" in [x.rstrip() for x in lines[1:]]:
        end = next(j for j in range(1, len(lines)) if lines[j].rstrip() == "---")
        add("frontmatter", 0, end)
        i = end + 1
    while i < len(lines):
        x = lines[i]
        if not x.strip():
            i += 1
        elif m := _FENCE.match(x):
            mark, j = m[1], i + 1
            while j < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}\s*$", lines[j]):
                j += 1
            add("fence", i, min(j, len(lines) - 1), info=m[2], closed=j < len(lines))
            i = j + 1
        elif block := next((end for start, end in _HTML if re.match(start, x, re.I)), None):
            j = i
            while j < len(lines) - 1 and not re.search(block, lines[j], re.I):
                j += 1
            add("html", i, j)
            i = j + 1
        elif m := _ATX.match(x):
            add("heading", i, i, level=len(m[1]), title=(m[2] or "").strip())
            i += 1
        elif cells(x) and i + 1 < len(lines) and _RULE.match(lines[i + 1]) and cells(lines[i + 1]) == cells(x):
            j = i + 2
            while j < len(lines) and lines[j].strip() and not _FENCE.match(lines[j]) and not _ATX.match(lines[j]):
                j += 1
            add("table", i, j - 1, columns=cells(x))
            i = j
        else:
            kind, j = ("list" if _LIST.match(x) else "paragraph"), i + 1
            while j < len(lines) and lines[j].strip() and not _FENCE.match(lines[j]) and not _ATX.match(lines[j]):
                if kind == "paragraph" and (m := _SETEXT.match(lines[j])):
                    add("heading", i, j, level=1 if m[1][0] == "=" else 2, title=" ".join(y.strip() for y in lines[i:j]))
                    break
                if kind == "paragraph" and _LIST.match(lines[j]):
                    add(kind, i, j - 1)
                    j -= 1
                    break
                j += 1
            else:
                add(kind, i, j - 1)
                j -= 1
            i = j + 1
    return out


def ancestry(found: list[dict]) -> list[list[str]]:
    """For each region the titles of the headings it stands under."""
    stack: list[tuple[int, str]] = []
    out = []
    for r in found:
        if r["kind"] == "heading":
            stack = [h for h in stack if h[0] < r["level"]] + [(r["level"], r["title"])]
        out.append([t for _, t in stack])
    return out


def links(text: str, found: list[dict] | None = None) -> list[tuple[int, str, str, bool]]:
    """line, target, label, image of links outside code and opaque blocks."""
    lines, out = lines_of(text), []
    for r in regions(text) if found is None else found:
        if r["kind"] in ("fence", "html", "frontmatter"):
            continue
        block = 0
        for no in range(r["start"], r["stop"] + 1):
            plain = re.sub(r"(`+)(?:(?!\1).)*?\1(?!`)", lambda m: " " * len(m[0]), lines[no - 1])
            for m in _LINK.finditer(plain):
                if block < LINKS_A_BLOCK and len(out) < LINKS_A_FILE:
                    out.append((no, m[3] or m[4] or m[5] or "", m[2] or "", bool(m[1])))
                    block += 1
    return out


def frontmatter(text: str) -> dict[str, str | list[str]]:
    """Scalars and lists of scalars of a front matter block; quoted scalars are unescaped, comments left out."""
    first = next((r for r in regions(text) if r["kind"] == "frontmatter"), None)
    out: dict[str, str | list[str]] = {}
    if first is None:
        return out
    key = None
    for x in lines_of(text)[first["start"] : first["stop"] - 1]:
        if m := re.match(r"^([A-Za-z_][\w -]*):[ \t]*(.*)$", x):
            key, value = m[1], m[2].strip()
            if value.startswith("[") and value.endswith("]"):
                out[key] = [scalar(y) for y in value[1:-1].split(",") if y.strip()]
            elif value not in ("", "|", ">"):
                out[key] = scalar(value)
            else:
                out[key] = []
        elif key and (m := re.match(r"^[ \t]+(?:-[ \t]+)?(.*)$", x)):
            if isinstance(out[key], list):
                out[key].append(scalar(m[1]))
    return out


def scalar(x: str) -> str:
    x = x.strip()
    if len(x) > 1 and x[0] == x[-1] == "'":
        return x[1:-1].replace("''", "'")
    if len(x) > 1 and x[0] == x[-1] == '"':
        return re.sub(r'\\(["\\/nt])', lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), x[1:-1])
    return re.sub(r"\s+#.*$", "", x)


@extractor("okf")
def okf(path: str, text: str) -> Facts:
    """A concept with its sections, the links between pages, and what it cites."""
    facts, found, front = Facts(), regions(text), frontmatter(text)
    last = len(lines_of(text)) or 1
    name = str(front.get("title") or next((r["title"] for r in found if r["kind"] == "heading"), None) or path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
    key = facts.symbol("concept", name, 1, last, None, None, **{k: v for k, v in front.items() if isinstance(v, str) and re.fullmatch(r"\w+", k) and k not in ("kind", "name", "line", "end", "parent", "signature", "visibility", "is_async", "sep", "self")})
    heads = [r for r in found if r["kind"] == "heading"]
    stack: list[tuple[int, str]] = []
    for i, h in enumerate(heads):
        stack = [s for s in stack if s[0] < h["level"]]
        end = next((x["start"] - 1 for x in heads[i + 1 :] if x["level"] <= h["level"]), last)
        stack.append((h["level"], facts.symbol("section", h["title"], h["start"], end, stack[-1][1] if stack else key)))
    citing = [(h["start"], next((x["start"] for x in heads[i + 1 :] if x["level"] <= h["level"]), last + 1)) for i, h in enumerate(heads) if h["title"].lower() in ("sources", "references", "citations")]
    for line, target, _, image in links(text, found):
        if not image and target and not target.startswith("#"):
            kind = "cites" if any(a < line < b for a, b in citing) else "links_to"
            facts.ref(kind, target, line, key, target.split("#")[0])
    for c in front.get("sources", []) if isinstance(front.get("sources"), list) else []:
        facts.ref("cites", c, 1, key, c)
    return facts


_UNITS = "path string, unit int, kind string, start_line int, end_line int, owner string, headings array<string>"


def cut(path: str, text: str, symbols: list[tuple[str, int, int]]) -> list[tuple]:
    """Units of a file: Markdown by its regions, other text at the borders of symbols (id, start, end); long ones in windows.

    The owner of a unit is the smallest symbol that holds it. Every line is in a unit.
    """
    n = len(lines_of(text))
    if not n:
        return []
    spans: list[tuple[int, int, str, list[str]]] = []
    if path.endswith(".md"):
        found = regions(text)
        spans = [(r["start"], r["stop"], r["kind"], up) for r, up in zip(found, ancestry(found))]
    else:
        ext = path.rsplit(".", 1)[-1]
        kind = "config" if ext in ("toml", "json", "yaml", "yml", "ini", "cfg") else "code" if symbols else "text"
        borders = sorted({1, n + 1, *(s for _, s, _ in symbols if 1 <= s <= n), *(e + 1 for _, _, e in symbols if 1 <= e <= n)})
        spans = [(a, b - 1, kind, []) for a, b in zip(borders, borders[1:])]
    out = []
    for a, b, kind, up in spans:
        start = a
        while True:
            stop = min(b, start + UNIT_LINES - 1)
            holds = [(e - s, i) for i, s, e in symbols if s <= start and stop <= e]
            out.append((path, len(out), kind, start, stop, min(holds)[1] if holds else None, up))
            if stop == b or len(out) >= UNITS_A_FILE:
                break
            start = stop + 1 - OVERLAP
        if len(out) >= UNITS_A_FILE:
            break
    return out


def units(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Units of files (path, text) with symbols (path, id, start_line, end_line)."""
    from pyspark.sql import functions as F

    per = symbols.groupBy("path").agg(F.collect_list(F.struct("id", "start_line", "end_line")).alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text, s in zip(b["path"], b["text"], b["s"]):
                rows += cut(path, text or "", [(x["id"], x["start_line"], x["end_line"]) for x in s] if s is not None else [])
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _UNITS.split(", ")])

    return files.select("path", "text").join(per, "path", "left").mapInPandas(run, _UNITS)


def violations(units_: DataFrame, files: DataFrame) -> DataFrame:
    """Units that leave their file or are upside down; there must be none."""
    from pyspark.sql import functions as F

    n = files.select("path", (F.size(F.split("text", "\n"))).alias("n"))
    return units_.join(n, "path", "left").filter("n IS NULL OR start_line < 1 OR end_line < start_line OR end_line > n")
