"""Requests, options and the envelope of results."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

SCHEMA_VERSION = 1
MAX_QUERY_BYTES, MAX_TERMS = 8_192, 128


@dataclass(frozen=True)
class RetrievalOptions:
    mode: str = "auto"  # auto, terms, exact, name, prefix, path, phrase, near
    analysis: str = "split"  # or identifiers
    ranking: str = "auto"  # auto, metadata, body, fusion
    bm25f: bool = False
    match: str | int = "any"
    phrase_gap: int = 0
    near_window: int = 8
    exact_fast_path: bool = True
    per_file: int = 0
    tests: str = "defer"  # or neutral
    graph_context: str = "semantic"  # or none, calls
    task: bool = False


GRAPH_CONTEXT = {"none": ((), False), "calls": (("calls",), True), "semantic": (("calls", "references", "type_uses", "extends", "implements", "imports"), True)}


@dataclass(frozen=True)
class ExploreRequest:
    query: str
    k: int = 8
    hops: int = 1
    language: str | None = None
    path: str | None = None
    detail: str = "compact"
    options: RetrievalOptions = field(default_factory=RetrievalOptions)

    def __post_init__(self):
        if len(self.query.encode()) > MAX_QUERY_BYTES:
            raise ValueError("query too long")


@dataclass
class Envelope:
    command: str
    query: dict
    results: list
    edges: list = field(default_factory=list)
    truncations: list = field(default_factory=list)
    stats: dict = field(default_factory=dict)
    stale: str = "unknown"

    def to_json(self) -> str:
        return json.dumps({"schema_version": SCHEMA_VERSION, **asdict(self)}, ensure_ascii=False, default=str)

    def to_text(self) -> str:
        """Lines grouped by file, then notices."""
        out, last = [], None
        for r in self.results:
            path = r.get("path")
            if path and path != last:
                out.append(path)
                last = path
            out.append("  " + " ".join(f"{v}" for k, v in r.items() if k != "path" and v is not None))
        out += [f"cut: {t['kind']} ({t['kept']} of {t['found']})" for t in self.truncations]
        return "\n".join(out)
