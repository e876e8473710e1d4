"""Globs as Java regular expressions for rlike, made on the driver."""

from __future__ import annotations

MAX_QUERY_BYTES = 8192


def _body(glob: str, crosses: bool) -> str:
    out, i = "", 0
    star = ".*" if crosses else "[^/]*"
    while i < len(glob):
        c = glob[i]
        if glob[i : i + 3] == "**/" and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i : i + 2] == "**" and i + 2 == len(glob) and i and glob[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            while glob[i : i + 1] == "*":
                i += 1
            out += star
        elif c == "?":
            out, i = out + ("." if crosses else "[^/]"), i + 1
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed class in glob {glob!r}")
            inner = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]"
            i = end + 1
        elif c == "{":
            end = glob.find("}", i)
            if end < 0:
                raise ValueError(f"unclosed choice in glob {glob!r}")
            out += "(?:" + "|".join(_body(x, crosses) for x in glob[i + 1 : end].split(",")) + ")"
            i = end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + _quote(glob[i + 1]), i + 2
        else:
            out, i = out + _quote(c), i + 1
    return out


def _quote(c: str) -> str:
    return c if c.isalnum() or c in "/_- " else "\\" + c if ord(c) < 128 else c


def _checked(pattern: str) -> str:
    if len(pattern.encode()) > MAX_QUERY_BYTES:
        raise ValueError("pattern too long")
    if not pattern.strip():
        raise ValueError("the pattern is empty")
    return pattern.strip()


def anchored_glob(pattern: str) -> str:
    """A whole-path glob: `*` stays within a folder, `**` does not."""
    return "(?s)^" + _body(_checked(pattern), crosses=False) + "$"


def include_glob(pattern: str) -> str:
    """One positive glob for text search; `*` may cross folders. Use it on the path and on the file name."""
    p = _checked(pattern)
    if "," in p or p.startswith("!"):
        raise ValueError("one positive glob is expected")
    return "(?s)^" + _body(p, crosses=True) + "$"
