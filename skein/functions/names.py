"""Identities, paths and limits."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DANGLING_BYTES, DANGLING_HEX = 96, 12


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def symbol_id(path: Column, kind: Column, qualified: Column, line: Column | None = None) -> Column:
    base = F.concat(F.lit("sym:"), path, F.lit("#"), kind, F.lit(":"), qualified)
    return base if line is None else F.concat(base, F.coalesce(F.concat(F.lit("@"), line.cast("string")), F.lit("")))


def edge_id(src: Column, kind: Column, dst: Column) -> Column:
    return F.concat(F.lit("("), src, F.lit(")-["), kind, F.lit("]->("), dst, F.lit(")"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def occurrence_id(*parts: Column) -> Column:
    """Hash of the site: everything that tells one reference from another."""
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def dangling_name(name: Column) -> Column:
    """An unresolved name on one line; beyond the byte limit a prefix with a hash of the whole."""
    one = F.trim(F.regexp_replace(name, r"\s+", " "))
    one = F.regexp_replace(F.regexp_replace(one, r" ([.:])", "$1"), r"([.:]) ", "$1")
    mark = F.concat(F.lit("…"), F.substring(F.sha2(name.cast("binary"), 256), 1, DANGLING_HEX))
    return F.when(F.octet_length(one) <= DANGLING_BYTES, one).otherwise(F.concat(cut_bytes(one, DANGLING_BYTES - DANGLING_HEX - 3), mark))


def cut_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters within `limit` bytes of UTF-8."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, limit + 1)
    whole = F.octet_length(text) <= limit
    head = F.hex(F.substring(raw, 1, limit))
    # a following continuation byte (80..BF) means the last character is cut: drop it with its lead byte
    broken = F.hex(F.substring(raw, limit + 1, 1)).rlike("^[89AB]")
    head = F.when(broken, F.regexp_replace(head, "(?:[C-F][0-9A-F])(?:[89AB][0-9A-F])*$", "")).otherwise(head)
    return F.when(whole, text).otherwise(F.decode(F.unhex(head), "UTF-8"))


def truncate_line(line: Column, limit: int = 400) -> Column:
    return F.when(F.octet_length(line) <= limit, line).otherwise(F.concat(cut_bytes(line, limit), F.lit("…")))


def join_path(folder: Column, spec: Column) -> Column:
    """spec resolved against a folder; null when it climbs out of the root."""
    parts = F.filter(F.split(F.concat_ws("/", folder, spec), "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", up(acc)).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(walked, "/")


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """All folders of a path, the root '' first."""
    parts = F.split(folder_of(path), "/")
    deep = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), deep))


def is_external(link: Column) -> Column:
    return link.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)")


def percent_decode(link: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.regexp_replace(link, r"\+", "%2B")), link)


def selector_names(selector: Column, sign: str) -> Column:
    """Class ('.') or id ('#') names in a CSS selector."""
    return F.regexp_extract_all(selector, F.lit(re.escape(sign) + r"([\p{L}_-][\p{L}\p{N}_-]*)"), F.lit(1))


def clamp_limit(asked: int, default: int, ceiling: int) -> int:
    """0 asks for the default; nothing goes beyond the ceiling."""
    return min(asked or default, ceiling)
