"""Python facts by the standard library's parser."""

from __future__ import annotations

import ast

from skein.extractors.base import Facts, extractor


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    return ""


class _Walk(ast.NodeVisitor):
    def __init__(self, path: str):
        self.facts, self.path, self.owner, self.kinds = Facts(), path, None, []

    def _body(self, key: str, kind: str, body: list[ast.stmt]) -> None:
        keep, self.owner = self.owner, key
        self.kinds.append(kind)
        for x in body:
            self.visit(x)
        self.kinds.pop()
        self.owner = keep

    def _types(self, node: ast.AST | None) -> None:
        for x in ast.walk(node) if node is not None else ():
            if isinstance(x, (ast.Name, ast.Attribute)) and _dotted(x):
                self.facts.ref("type_uses", _dotted(x), x.lineno, self.owner)
                if isinstance(x, ast.Attribute):
                    break

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        key = self.facts.symbol("class", node.name, node.lineno, node.end_lineno, self.owner, f"class {node.name}", sep=".", doc=(ast.get_docstring(node) or "")[:80] or None)
        for base in node.bases:
            self.facts.ref("extends", _dotted(base), base.lineno, key)
        self._body(key, "class", node.body)

    def visit_FunctionDef(self, node) -> None:
        kind = "method" if self.kinds and self.kinds[-1] == "class" else "function"
        local = "true" if self.kinds and self.kinds[-1] != "class" else None
        key = self.facts.symbol(
            kind, node.name, node.lineno, node.end_lineno, self.owner, f"def {node.name}({ast.unparse(node.args)})", "private" if node.name.startswith("_") else "public",
            isinstance(node, ast.AsyncFunctionDef), sep=".", lexical_local=local, doc=(ast.get_docstring(node) or "")[:80] or None,
        )
        for d in node.decorator_list:
            self.visit(d)
        keep, self.owner = self.owner, key
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            self._types(a.annotation)
        self._types(node.returns)
        self.owner = keep
        self._body(key, kind, node.body)

    visit_AsyncFunctionDef = visit_FunctionDef

    def _bind(self, target: ast.AST, node: ast.stmt) -> None:
        if isinstance(target, ast.Name) and (not self.kinds or self.kinds[-1] == "class"):
            self.facts.symbol("field" if self.kinds else "variable", target.id, node.lineno, node.end_lineno, self.owner, sep=".")
        elif isinstance(target, (ast.Tuple, ast.List)):
            for x in target.elts:
                self._bind(x, node)

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            self._bind(t, node)
        self.visit(node.value)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if _dotted(node.annotation).endswith("TypeAlias") and isinstance(node.target, ast.Name):
            self.facts.symbol("type_alias", node.target.id, node.lineno, node.end_lineno, self.owner, sep=".")
        else:
            self._bind(node.target, node)
            self._types(node.annotation)
        if node.value is not None:
            self.visit(node.value)

    def visit_TypeAlias(self, node) -> None:
        self.facts.symbol("type_alias", node.name.id, node.lineno, node.end_lineno, self.owner, sep=".")

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.facts.ref("imports", a.name, node.lineno, self.owner, a.name.replace(".", "/"), None)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        folder = self.path.split("/")[:-1]
        head = folder[: len(folder) - node.level + 1] if node.level else []
        module = "/".join([*head, *(node.module or "").split(".")]).strip("/")
        for a in node.names:
            self.facts.ref("imports", f"{'.' * node.level}{node.module or ''}.{a.name}".replace("..", "..") if node.module else "." * node.level + a.name, node.lineno, self.owner, module, a.name)

    def visit_Call(self, node: ast.Call) -> None:
        self.facts.ref("calls", _dotted(node.func), node.lineno, self.owner, dynamic=not _dotted(node.func))
        self.generic_visit(node)


@extractor("python")
def python(path: str, text: str) -> Facts:
    walk = _Walk(path)
    for x in ast.parse(text).body:
        walk.visit(x)
    return walk.facts
