"""Rust, JavaScript and TypeScript facts by token scanners: declarations, nesting, imports, calls and type uses.

Without a full parser some shapes are out of reach: macro bodies are read like code, generic arguments of calls are
skipped, and destructured bindings name only their outer pattern.
"""

from __future__ import annotations

import re

from skein.extractors.base import Facts, extractor

_RUST = re.compile(
    r"(?P<skip>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|b?r(?P<h>#*)\".*?\"(?P=h)|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\.[^']*|[^'\\\n])')|(?P<life>'[A-Za-z_]\w*)|(?P<word>[A-Za-z_]\w*!?(?!=))|(?P<num>\d[\w.]*)|(?P<op>::|->|=>|[{}()\[\];,<>&*=:#!?.|+\-/%^@$~])|(?P<nl>\n)|(?P<ws>[^\S\n]+)|(?P<other>.)",
    re.S,
)
_JS = re.compile(
    r"(?P<skip>//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<word>[#@]?[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)|(?P<op>=>|\.\.\.|\?\.|[{}()\[\];,<>=:?!.|&*+\-/%^~])|(?P<nl>\n)|(?P<ws>[^\S\n]+)|(?P<other>.)",
    re.S,
)


class Tokens:
    """Tokens (text, line, kind) without white space; comments are left out, strings stay as kind 'skip'."""

    def __init__(self, pattern: re.Pattern, text: str):
        self.t: list[tuple[str, int, str]] = []
        line = 1
        for m in pattern.finditer(text):
            kind = m.lastgroup if m.lastgroup != "h" else "skip"
            if kind not in ("ws", "nl") and not (kind == "skip" and m[0][:2] in ("//", "/*")):
                self.t.append((m[0], line, kind))
            line += m[0].count("\n")
        self.close: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        for i, (x, _, kind) in enumerate(self.t):
            if kind == "op" and x in "{([":
                stack.append(("})]"["{([".index(x)], i))
            elif kind == "op" and x in "})]" and stack:
                while stack and stack[-1][0] != x:
                    stack.pop()
                if stack:
                    self.close[stack.pop()[1]] = i

    def __len__(self) -> int:
        return len(self.t)

    def text(self, i: int) -> str:
        return self.t[i][0] if 0 <= i < len(self.t) else ""

    def kind(self, i: int) -> str:
        return self.t[i][2] if 0 <= i < len(self.t) else ""

    def line(self, i: int) -> int:
        return self.t[min(max(i, 0), len(self.t) - 1)][1] if self.t else 1

    def find(self, i: int, end: int, *what: str) -> int:
        """The next token of `what` at this nesting before `end`, or `end`."""
        while i < end:
            if self.text(i) in what and self.kind(i) == "op":
                return i
            i = self.close.get(i, i) + 1
        return end

    def join(self, i: int, j: int) -> str:
        return " ".join(x for x, _, _ in self.t[i:j])


def use_leaves(tokens: list[str]) -> list[tuple[str, str]]:
    """(path, name it is known by) of each leaf of a use tree like a::{b, c as d, *}."""
    def tree(i: int, prefix: list[str]) -> tuple[int, list[tuple[str, str]]]:
        path, out = list(prefix), []
        while i < len(tokens):
            x = tokens[i]
            if x == "{":
                i += 1
                while i < len(tokens) and tokens[i] != "}":
                    i, got = tree(i, path)
                    out += got
                    if i < len(tokens) and tokens[i] == ",":
                        i += 1
                return i + 1, out
            if x in (",", "}", ";"):
                break
            if x == "as":
                return i + 2, [("::".join(path), tokens[i + 1])]
            if x != "::":
                path.append(x)
            i += 1
        last = path[-1] if path else ""
        if last == "self" and len(path) > 1:
            path = path[:-1]
        return i, [("::".join(path), "*" if last == "*" else path[-1])] if path else []

    return tree(0, [])[1]


_RUST_ITEMS = {"struct": "struct", "enum": "enum", "trait": "trait", "type": "type_alias", "const": "const", "static": "static", "mod": "module", "union": "struct"}
_RUST_WORDS = set("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split())
_PRIMITIVE = set("bool char str u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64 String Vec Option Result Box Self self mut dyn impl where for in ref const".split())


@extractor("rust")
def rust(path: str, text: str) -> Facts:
    t, facts = Tokens(_RUST, text), Facts()

    def types(i: int, end: int, owner: str | None) -> None:
        for j in range(i, end):
            w = t.text(j)
            if t.kind(j) == "word" and w[:1].isupper() and w not in _PRIMITIVE and t.text(j + 1) != "::":
                facts.ref("type_uses", w, t.line(j), owner)

    def body(i: int, end: int, parent: str | None, inside: str) -> None:
        visibility, is_async, test = "private", False, False
        while i < end:
            w, kind = t.text(i), t.kind(i)
            if w == "#":
                j = i + 2 if t.text(i + 1) == "!" else i + 1
                stop = t.close.get(j, j)
                test = test or "test" in [t.text(x) for x in range(j, stop)]
                i = stop + 1
                continue
            if w == "pub":
                visibility, i = "public", i + 1
                if t.text(i) == "(":
                    visibility = "crate" if "crate" in t.join(i, t.close.get(i, i)) else "super"
                    i = t.close.get(i, i) + 1
                continue
            if w in ("async", "unsafe", "extern", "default") and inside != "fn":
                is_async, i = is_async or w == "async", i + 1
                continue
            own = {"test_owned": "true" if test else None}
            if w == "const" and t.text(i + 1) in ("fn", "unsafe", "async", "extern"):
                i += 1
                continue
            if w == "fn" and t.kind(i + 1) == "word":
                stop = t.find(i, end, "{", ";")
                last = t.close.get(stop, stop)
                k = "method" if inside in ("impl", "trait") else "function"
                key = facts.symbol(k, t.text(i + 1), t.line(i), t.line(last), parent, t.join(i, stop), visibility, is_async, lexical_local="true" if inside == "fn" else None, **own)
                types(i + 2, stop, key)
                if t.text(stop) == "{":
                    body(stop + 1, last, key, "fn")
                i = last + 1
            elif w == "impl":
                stop = t.find(i, end, "{", ";")
                head = [t.text(x) for x in range(i + 1, stop)]
                plain, depth = [], 0
                for x in head:
                    depth += {"<": 1, ">": -1}.get(x, 0)
                    if depth == 0 and x not in "<>":
                        plain.append(x)
                if "where" in plain:
                    plain = plain[: plain.index("where")]
                cut = plain.index("for") if "for" in plain else -1
                trait, target = ("".join(plain[:cut]), "".join(plain[cut + 1 :])) if cut >= 0 else ("", "".join(plain))
                last = t.close.get(stop, stop)
                key = facts.symbol("impl", f"{trait} for {target}" if trait else target, t.line(i), t.line(last), parent, t.join(i, stop), **own)
                if trait:
                    facts.ref("implements", trait, t.line(i), key)
                body(stop + 1, last, key, "impl")
                i = last + 1
            elif w in _RUST_ITEMS and t.kind(i + 1) == "word" and not (inside == "fn" and w in ("type", "union")):
                name = t.text(i + 1)
                stop = t.find(i, end, "{", ";", "(") if w != "const" and w != "static" else t.find(i, end, ";")
                last = t.close.get(stop, stop)
                key = facts.symbol(_RUST_ITEMS[w], name, t.line(i), t.line(last), parent, t.join(i, stop), visibility, **own)
                if w == "mod" and t.text(stop) == ";":
                    facts.ref("imports", name, t.line(i), key, name)
                elif w == "mod" or w == "trait":
                    body(stop + 1, last, key, w)
                elif w in ("struct", "union") and t.text(stop) == "{":
                    j = stop + 1
                    while j < last:
                        c = t.find(j, last, ",")
                        colon = t.find(j, c, ":")
                        if colon < c and t.kind(colon - 1) == "word":
                            facts.symbol("field", t.text(colon - 1), t.line(colon), t.line(c - 1), key, t.join(j, c))
                            types(colon, c, key)
                        j = c + 1
                elif w == "enum":
                    j = stop + 1
                    while j < last:
                        while t.text(j) == "#":
                            j = t.close.get(j + 1, j + 1) + 1
                        c = t.find(j, last, ",")
                        if t.kind(j) == "word":
                            facts.symbol("variant", t.text(j), t.line(j), t.line(c - 1), key, t.join(j, c))
                            types(j + 1, c, key)
                        j = c + 1
                else:
                    types(i + 2, t.find(i, end, ";") if w != "struct" else last, key)
                    if t.text(stop) == "(":
                        last = t.find(last, end, ";")
                i = last + 1
            elif w == "use":
                stop = t.find(i, end, ";")
                for full, known in use_leaves([t.text(x) for x in range(i + 1, stop)]):
                    facts.ref("imports", full, t.line(i), parent, full.rsplit("::", 1)[0], known)
                    if visibility != "private":
                        facts.symbol("export", known, t.line(i), t.line(stop), parent, t.join(i, stop), visibility)
                i = stop + 1
            elif w == "macro_rules!" and t.kind(i + 1) == "word":
                last = t.close.get(i + 2, i + 2)
                facts.symbol("macro", t.text(i + 1), t.line(i), t.line(last), parent, f"macro_rules! {t.text(i + 1)}")
                i = last + 1
            elif kind == "word" and inside == "fn" and (w not in _RUST_WORDS or w in ("Self", "self", "super", "crate") and t.text(i + 1) == "::"):
                j = i
                while t.text(j + 1) == "::" and t.kind(j + 2) == "word":
                    j += 2
                called = j + 1
                if t.text(called) == "::" and t.text(called + 1) == "<":
                    called = t.find(called, end, "(")
                if t.text(j).endswith("!"):
                    facts.ref("calls", t.join(i, j + 1).replace(" ", "")[:-1], t.line(i), parent)
                elif t.text(called) == "(":
                    facts.ref("calls", t.join(i, j + 1).replace(" ", ""), t.line(i), parent, dynamic=t.text(i - 1) == ".")
                i = j + 1
            else:
                i += 1
                continue
            visibility, is_async, test = "private", False, False

    body(0, len(t), None, "file")
    return facts


_JS_WORDS = set("if for while switch catch return typeof new await function class super import export default const let var throw delete void in of instanceof else do try finally case yield async static get set extends this with".split())


@extractor("javascript", "typescript")
def script(path: str, text: str) -> Facts:
    t, facts = Tokens(_JS, text), Facts()
    ts = path.rsplit(".", 1)[-1] in ("ts", "tsx", "mts", "cts", "svelte", "vue", "astro")

    def quoted(i: int) -> str:
        return t.text(i)[1:-1]

    def types(i: int, end: int, owner: str | None) -> None:
        for j in range(i, end):
            if ts and t.kind(j) == "word" and t.text(j)[:1].isupper():
                facts.ref("type_uses", t.text(j), t.line(j), owner)

    def heritage(i: int, stop: int, key: str) -> None:
        kind = None
        for j in range(i, stop):
            if t.text(j) in ("extends", "implements"):
                kind = t.text(j)
            elif kind and t.kind(j) == "word" and t.text(j - 1) in (kind, ","):
                facts.ref(kind, t.text(j), t.line(j), key)

    def names(i: int, end: int) -> list[tuple[str, str]]:
        out = []
        while i < end:
            c = t.find(i, end, ",")
            ws = [t.text(x) for x in range(i, c) if t.kind(x) == "word" and t.text(x) != "type"]
            if ws:
                out.append((ws[0], ws[-1] if "as" in ws else ws[0]))
            i = c + 1
        return out

    def members(i: int, end: int, key: str) -> None:
        while i < end:
            first = i
            while t.text(i) in ("public", "private", "protected", "static", "readonly", "async", "get", "set", "abstract", "override", "declare", "*") and t.text(i + 1) not in ("(", "=", ":", ";"):
                i += 1
            mods = [t.text(x) for x in range(first, i)]
            if t.kind(i) == "word" and not t.text(i).startswith("@"):
                name = t.text(i)
                j = i + 1
                if t.text(j) == "<":
                    j = t.find(j, end, "(", "=", ";", ":")
                if t.text(j) == "(":
                    close = t.close.get(j, j)
                    stop = close + 1
                    while stop < end and t.text(stop) not in ("{", ";") and t.line(stop) == t.line(close):
                        stop += 1
                    last = t.close.get(stop, stop) if t.text(stop) == "{" else max(close, stop - 1)
                    m = facts.symbol("method", name, t.line(first), t.line(last), key, t.join(first, stop), "private" if "private" in mods or name[0] == "#" else "public", "async" in mods, sep=".", static="true" if "static" in mods else None)
                    types(j, stop, m)
                    if t.text(stop) == "{":
                        body(stop + 1, last, m, "fn")
                    i = last + 1
                    continue
                stop = j
                while stop < end and t.text(stop) != ";" and not (t.line(stop) > t.line(stop - 1) and t.text(stop - 1) not in ("=", ",", "=>", ":")):
                    stop = t.close.get(stop, stop) + 1
                f = facts.symbol("field", name, t.line(first), t.line(stop - 1), key, t.join(first, min(stop, first + 12)), sep=".")
                types(j, min(stop, t.find(j, stop, "=")), f)
                body(t.find(j, stop, "="), stop, f, "fn")
                i = stop
            else:
                i = t.close.get(i, i) + 1

    def body(i: int, end: int, parent: str | None, inside: str) -> None:
        is_async = exported = False
        while i < end:
            w, kind = t.text(i), t.kind(i)
            own = {"lexical_local": "true" if inside == "fn" else None, "exported": "true" if exported else None}
            if w == "import" and t.text(i + 1) != "(" and inside == "file":
                j = i + 1
                while j < end and not (t.kind(j) == "skip" and t.text(j)[0] in "\"'"):
                    j += 1
                source = quoted(j)
                brace = t.find(i, j, "{")
                if t.text(i + 1) not in ("{", "*", "type") and t.kind(i + 1) == "word":
                    facts.ref("imports", t.text(i + 1), t.line(i), parent, source, "default")
                if brace < j:
                    for name, known in names(brace + 1, t.close.get(brace, j)):
                        facts.ref("imports", known, t.line(i), parent, source, name)
                elif "*" in [t.text(x) for x in range(i, j)]:
                    facts.ref("imports", t.text(j - 2), t.line(i), parent, source, "*")
                elif j == i + 1:
                    facts.ref("imports", source, t.line(i), parent, source)
                i = j + 1
            elif w == "export":
                if t.text(i + 1) in ("{", "*"):
                    close = t.close.get(i + 1, i + 1)
                    frm = close + 1
                    while frm < end and t.text(frm) not in ("from", ";") and t.line(frm) == t.line(close):
                        frm += 1
                    source = quoted(frm + 1) if t.text(frm) == "from" else None
                    for name, known in names(i + 2, close) if t.text(i + 1) == "{" else [("*", "*")]:
                        facts.symbol("export", known, t.line(i), t.line(close), parent, None, source=source)
                        facts.ref("exports", name, t.line(i), parent, source, name)
                    i = (frm + 2) if source else close + 1
                else:
                    exported, i = True, i + 1
                continue
            elif w in ("default", "declare", "abstract"):
                i += 1
                continue
            elif w == "async":
                is_async, i = True, i + 1
                continue
            elif w == "function" and (t.kind(i + 1) == "word" or t.text(i + 1) == "*"):
                n = i + 1 if t.kind(i + 1) == "word" else i + 2
                stop = t.find(t.close.get(t.find(n, end, "("), n) + 1, end, "{", ";")
                last = t.close.get(stop, stop)
                key = facts.symbol("function", t.text(n), t.line(i), t.line(last), parent, t.join(i, stop), None, is_async, sep=".", **own)
                types(n + 1, stop, key)
                body(stop + 1, last, key, "fn")
                i = last + 1
            elif w in ("class", "interface") and t.kind(i + 1) == "word":
                stop = t.find(i, end, "{")
                last = t.close.get(stop, stop)
                key = facts.symbol(w, t.text(i + 1), t.line(i), t.line(last), parent, t.join(i, stop), sep=".", **own)
                heritage(i, stop, key)
                members(stop + 1, last, key)
                i = last + 1
            elif w == "enum" and t.kind(i + 1) == "word":
                stop = t.find(i, end, "{")
                last = t.close.get(stop, stop)
                key = facts.symbol("enum", t.text(i + 1), t.line(i), t.line(last), parent, f"enum {t.text(i + 1)}", sep=".", **own)
                for name, _ in names(stop + 1, last):
                    facts.symbol("variant", name, t.line(stop), t.line(last), key, sep=".")
                i = last + 1
            elif ts and w == "type" and t.kind(i + 1) == "word" and t.text(i + 2) in ("=", "<"):
                stop = t.find(i, end, ";")
                key = facts.symbol("type_alias", t.text(i + 1), t.line(i), t.line(stop - 1), parent, t.join(i, min(stop, i + 20)), sep=".", **own)
                eq = t.find(i, stop, "=")
                types(eq, min(stop, eq + 20), key)
                i = min(stop, eq + 20)
            elif w in ("const", "let", "var") and t.kind(i + 1) == "word":
                eq = i + 2
                while eq < end and t.text(eq) not in ("=", ";", ",") and t.line(eq) == t.line(i):
                    eq = t.close.get(eq, eq) + 1
                arrow = t.text(eq) == "=" and ("=>" in (t.text(t.close.get(eq + 1, eq) + 1), t.text(eq + 2), t.text(t.close.get(eq + 2, eq) + 1)) or t.text(eq + 1) == "function")
                k = "function" if arrow else "const" if w == "const" else "variable"
                key = facts.symbol(k, t.text(i + 1), t.line(i), t.line(eq), parent, t.join(i, min(eq + 6, end)), None, t.text(eq + 1) == "async", sep=".", **own)
                if arrow:
                    stop = t.find(eq, end, "{", ";")
                    last = t.close.get(stop, stop)
                    facts.symbols[-1]["end_line"] = t.line(last)
                    body(stop + 1, last, key, "fn")
                    i = last + 1
                else:
                    i = eq + 1
            elif kind == "word" and w not in _JS_WORDS:
                j = i
                while t.text(j + 1) in (".", "?.") and t.kind(j + 2) == "word":
                    j += 2
                if t.text(j + 1) == "(":
                    name = t.join(i, j + 1).replace(" ", "").replace("?", "")
                    if name == "require" and t.kind(j + 2) == "skip":
                        facts.ref("imports", quoted(j + 2), t.line(i), parent, quoted(j + 2))
                    else:
                        facts.ref("calls", name, t.line(i), parent, dynamic=t.text(i - 1) in (".", "?."))
                i = j + 1
            elif w == "import" and t.text(i + 1) == "(":
                fixed = t.kind(i + 2) == "skip"
                facts.ref("imports", quoted(i + 2) if fixed else "import()", t.line(i), parent, quoted(i + 2) if fixed else None, None, not fixed)
                i += 2
            else:
                i += 1
                continue
            is_async = exported = False

    body(0, len(t), None, "file")
    return facts
