"""CSS rules, at-rules, custom properties and imports by a scanner that skips comments and strings."""

from __future__ import annotations

import re

from skein.extractors.base import Facts, extractor

_SKIP = re.compile(r"/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.S)
_IMPORT = re.compile(r"@import\s+(?:url\(\s*)?[\"']?([^\"')\s;]+)", re.I)


@extractor("css")
def css(path: str, text: str) -> Facts:
    facts = Facts()
    plain = re.sub(r"/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    blank = _SKIP.sub(lambda m: re.sub(r"[^\n]", "_", m[0]), plain)
    line = lambda at: blank.count("\n", 0, at) + 1
    for m in _IMPORT.finditer(plain):
        facts.ref("imports", m[1], line(m.start()), None, m[1])
    stack: list[tuple[str | None, int]] = []
    at = 0
    for m in re.finditer(r"[{};]", blank):
        head = plain[at : m.start()].strip()
        where = line(at + len(plain[at : m.start()]) - len(plain[at : m.start()].lstrip())) if head else line(m.start())
        parent = next((k for k, _ in reversed(stack) if k), None)
        if m[0] == "{":
            depth, end = 1, m.end()
            while end < len(blank) and depth:
                depth += {"{": 1, "}": -1}.get(blank[end], 0)
                end += 1
            kind = "css_at_rule" if head.startswith("@") else "css_rule"
            name = " ".join(head.split())
            stack.append((facts.symbol(kind, name, where, line(end - 1), parent, name, selector=name if kind == "css_rule" else None) if name else None, m.start()))
        else:
            if head.startswith("--") and ":" in head:
                facts.symbol("css_custom_property", head.split(":", 1)[0].strip(), where, where, parent, head)
            if m[0] == "}" and stack:
                stack.pop()
        at = m.end()
    return facts
