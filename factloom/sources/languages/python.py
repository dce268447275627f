"""Facts of a Python file, from the standard library's own parser.

Lines count from 1, columns from 0 in UTF-8 bytes; definitions begin after their decorators. In a file
with syntax errors the lines where the parser stops are left out, one after the other, and the rest is read.
"""

from __future__ import annotations

import ast
import io
import keyword
import tokenize
from collections.abc import Iterator

Row = dict[str, object]
_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)


def _dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of names and attributes only."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (head := _dotted(node.value)):
        return f"{head}.{node.attr}"
    return None


def _parsed(text: str) -> tuple[ast.Module, str]:
    """The tree of a text and the text that it is of; where the parser stops, the line becomes ``pass`` at its indentation, then nothing, and lines keep their numbers."""
    lines, tried = text.split("\n"), {}
    while True:
        try:
            return ast.parse(left := "\n".join(lines)), left
        except SyntaxError as broken:
            k = min(max(0, (broken.lineno or 1) - 1), len(lines) - 1)
            while tried.get(k) == 2 or k not in tried and not lines[k].strip():  # spent or empty: the trouble began before
                tried[k] = 2
                k -= 1
                if k < 0:
                    raise
            tried[k] = tried.get(k, 0) + 1
            old = lines[k]
            lines[k] = old[: len(old) - len(old.lstrip())] + "pass" if tried[k] == 1 and old.strip() != "pass" else ""
            if not lines[k]:
                tried[k] = 2


class _File:
    def __init__(self, text: str) -> None:
        self.tree, self.text = _parsed(text)
        self.lines = self.text.splitlines(keepends=True)
        self.up: dict[ast.AST, ast.AST] = {c: p for p in ast.walk(self.tree) for c in ast.iter_child_nodes(p)}

    def source(self, node: ast.AST) -> str:
        return ast.get_source_segment(self.text, node) or ""

    def above(self, node: ast.AST) -> Iterator[ast.AST]:
        while (node := self.up.get(node)) is not None:
            yield node

    def around(self, node: ast.AST) -> tuple[ast.AST | None, ast.ClassDef | None]:
        """The innermost function and class that hold a node in their bodies (not in decorators, bases or defaults)."""
        fn = cls = None
        child = node
        for p in self.above(node):
            if isinstance(p, (*_DEF, ast.ClassDef)) and child in p.body:
                if isinstance(p, ast.ClassDef):
                    cls = cls or p
                else:
                    fn = fn or p
            child = p
        return fn, cls

    def names(self, node: ast.AST) -> tuple[str | None, str | None]:
        fn, cls = self.around(node)
        return (fn.name if fn is not None else None, cls.name if cls is not None else None)

    def span(self, node: ast.AST) -> Row:
        return {"start_line": node.lineno, "end_line": node.end_lineno}


def _params(f: _File, node: ast.FunctionDef) -> list[Row]:
    a = node.args
    order = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
    return [{"name": x.arg, "param_type": f.source(x.annotation) if x.annotation else None, "position": k} for k, x in enumerate(order)]


def _inside(cls: ast.ClassDef) -> Iterator[ast.AST]:
    """Nodes of a class without those of nested classes, in order."""
    stack = list(reversed(cls.body))
    while stack:
        node = stack.pop()
        yield node
        if not isinstance(node, ast.ClassDef):
            stack.extend(reversed(list(ast.iter_child_nodes(node))))


def _fields(f: _File, cls: ast.ClassDef) -> list[Row]:
    found: dict[str, Row] = {}

    def add(target: ast.AST, note: ast.AST | None, at: ast.AST, own: bool) -> None:
        if isinstance(target, (ast.Tuple, ast.List)):
            for x in target.elts:
                add(x, None, at, own)
            return
        name = target.id if own and isinstance(target, ast.Name) else target.attr if not own and isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self" else None
        if name:
            found.setdefault(name, {"class_name": cls.name, "name": name, "field_type": f.source(note) if note is not None else None, **f.span(at)})

    for node in _inside(cls):
        own = f.up.get(node) is cls
        if isinstance(node, ast.Assign):
            for t in node.targets:
                add(t, None, node, own)
        elif isinstance(node, ast.AnnAssign):
            add(node.target, node.annotation, node, own)
    return list(found.values())


def _calls(f: _File) -> list[Row]:
    out = []
    for node in ast.walk(f.tree):
        if not isinstance(node, ast.Call):
            continue
        if isinstance(node.func, ast.Name):
            bare_super = node.func.id == "super" and isinstance(f.up.get(node), ast.Attribute)
            callee, target = (None, None) if bare_super else (node.func.id, None)
        elif isinstance(node.func, ast.Attribute):
            callee, target = node.func.attr, f.source(node.func.value)
        else:
            callee = target = None
        if callee:
            caller, cls = f.names(node)
            out.append((node.lineno, node.col_offset, -node.end_lineno, {"callee": callee, "caller": caller, "caller_class_name": cls, "object_name": target, **f.span(node)}))
    return [r for *_, r in sorted(out, key=lambda x: x[:3])]


def _imports(f: _File) -> list[Row]:
    out = []
    for node in ast.walk(f.tree):
        if isinstance(node, ast.Import):
            out += [{"module": a.name, **f.span(node)} for a in node.names if a.asname is None]
        elif isinstance(node, ast.ImportFrom):
            out.append({"module": "." * node.level + (node.module or ""), **f.span(node)})
    return sorted(out, key=lambda r: (r["start_line"], r["end_line"]))


def _annotations(f: _File) -> list[Row]:
    out = []
    for node in ast.walk(f.tree):
        if not isinstance(node, (*_DEF, ast.ClassDef)):
            continue
        kind = "class" if isinstance(node, ast.ClassDef) else "method" if f.around(node)[1] is not None else "function"
        body = node.body[0]
        first = min([body.lineno, *[d.lineno for d in getattr(body, "decorator_list", [])]])
        header = "".join(f.lines[node.lineno - 1 : max(node.lineno, first - 1)]).strip()
        for d in node.decorator_list:
            named = d.func if isinstance(d, ast.Call) else d
            name = f.source(named) if isinstance(d, ast.Call) or isinstance(named, (ast.Name, ast.Attribute)) else None
            if name:
                signature = "@" + f.source(d)
                out.append({"name": name, "signature": signature, **f.span(d), "target_name": node.name, "target_type": kind, "target_signature": f"{signature}\n{header}"})
    return sorted(out, key=lambda r: (r["start_line"], r["target_name"]))


def _refs(text: str) -> list[Row]:
    out: list[Row] = []
    lines = text.splitlines(keepends=True)
    width = lambda line, col: len(lines[line - 1][:col].encode()) if line <= len(lines) else col
    importing: list[tokenize.TokenInfo] | None = None

    def add(kind: str, name: str, a: tuple[int, int], b: tuple[int, int]) -> None:
        out.append({"name": name, "node_type": kind, "start_line": a[0], "end_line": b[0], "start_column": width(*a), "end_column": width(*b)})

    tokens: list[tokenize.TokenInfo] = []
    try:
        tokens.extend(tokenize.generate_tokens(io.StringIO(text).readline))
    except (tokenize.TokenError, SyntaxError):
        pass  # what stands before counts
    for k, t in enumerate(tokens):
        begins = k == 0 or tokens[k - 1].type in (tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING)
        if begins and t.type == tokenize.NAME and t.string in ("import", "from"):
            importing = []
            continue
        if importing is not None:
            # Names of modules and of what is imported are dotted names; leading dots make a relative import.
            if t.type == tokenize.NAME and t.string not in ("import", "as") or t.string in (".", "..."):
                importing.append(t)
                continue
            if importing:
                name = "".join(x.string for x in importing)
                add("relative_import" if name[0] == "." else "dotted_name", name, importing[0].start, importing[-1].end)
            importing = None if t.type in (tokenize.NEWLINE, tokenize.ENDMARKER) else []
            continue
        if t.type == tokenize.NAME and not keyword.iskeyword(t.string):
            add("identifier", t.string, t.start, t.end)
    return out


def _properties(f: _File) -> list[Row]:
    found = set()
    for node in ast.walk(f.tree):
        if isinstance(node, _DEF) and any(isinstance(d, ast.Name) and d.id == "property" for d in node.decorator_list):
            cls = f.around(node)[1]
            found.add((node.name, cls.name if cls is not None else None))
    return [{"property_name": p, "class_name": c} for p, c in sorted(found, key=lambda x: (x[0], x[1] or ""))]


def _property_reads(f: _File, properties: list[Row], classes: list[Row], fields: list[Row]) -> list[Row]:
    owners: dict[str, set[str | None]] = {}
    for p in properties:
        owners.setdefault(p["property_name"], set()).add(p["class_name"])
    if not owners:
        return []
    supers = {c["name"]: set(c["super_classes"]) for c in classes}
    field_type = {(x["class_name"], x["name"]): x["field_type"] for x in fields}
    module: dict[str, str | None] = {}
    for node in f.tree.body:
        if isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
            module[node.target.id] = f.source(node.annotation).rsplit(".", 1)[-1]
        elif isinstance(node, ast.Assign):
            value = node.value.func if isinstance(node.value, ast.Call) else node.value
            kind = (_dotted(value) or "").rsplit(".", 1)[-1] or None
            module |= {t.id: kind for t in node.targets if isinstance(t, ast.Name)}
    holds = lambda text, cls: cls in "".join(c if c.isalnum() or c == "_" else " " for c in text or "").split()

    def lineage(cls: str | None) -> set[str]:
        seen, stack = set(), [cls] if cls else []
        while stack:
            if (c := stack.pop()) not in seen:
                seen.add(c)
                stack.extend(supers.get(c, ()))
        return seen

    out: dict[tuple, Row] = {}
    for node in ast.walk(f.tree):
        if not (isinstance(node, ast.Attribute) and isinstance(node.ctx, ast.Load) and node.attr in owners):
            continue
        if isinstance(call := f.up.get(node), ast.Call) and call.func is node:
            continue
        target, (fn, cls) = f.source(node.value), f.around(node)
        first = target.removeprefix("self.").removeprefix("cls.").split(".")[0]
        kind = module.get(target)
        types = [field_type.get((cls.name, first))] if cls is not None and target not in ("self", "cls") else []
        if fn is not None:
            types += [p["param_type"] for p in _params(f, fn) if p["name"] == first]
        types += [kind] if kind else []
        own = lineage(cls.name) if cls is not None and target in ("self", "cls") else set()
        if any(o in own or any(holds(t, o) for t in types) for o in owners[node.attr] if o):
            row = {"property_name": node.attr, "caller": fn.name if fn is not None else "<module>", "caller_class_name": cls.name if cls is not None else None, "object_name": target, "object_type": kind, **f.span(node)}
            out.setdefault(tuple(row.values()), row)
    return sorted(out.values(), key=lambda r: (r["start_line"], r["property_name"]))


def snapshot(text: str) -> dict[str, list[Row]]:
    """All facts of a file. Functions carry their params, classes their methods and super classes."""
    try:
        f = _File(text)
    except (SyntaxError, ValueError, RecursionError):
        return {"refs": _refs(text)}
    functions, classes, fields = [], [], []
    same_name: dict[str, list[ast.ClassDef]] = {}
    for node in ast.walk(f.tree):
        if isinstance(node, _DEF):
            cls = f.around(node)[1]
            functions.append({"name": node.name, "class_name": cls.name if cls is not None else None, **f.span(node), "params": _params(f, node)})
        elif isinstance(node, ast.ClassDef):
            methods = [x.name for x in _inside(node) if isinstance(x, _DEF)]
            supers = [d for b in node.bases if (d := _dotted(b))]
            classes.append({"name": node.name, "kind": "class", **f.span(node), "methods": methods, "super_classes": supers})
            same_name.setdefault(node.name, []).append(node)
    for nodes in same_name.values():  # classes of one name all have the fields of the smallest of them, the first of equal ones
        smallest = min(nodes, key=lambda n: (len(f.source(n).encode()), n.lineno, n.col_offset))
        fields += _fields(f, smallest) * len(nodes)
    by_place = lambda r: (r["start_line"], r["end_line"])
    functions.sort(key=by_place)
    classes.sort(key=by_place)
    properties = _properties(f)
    return {
        "functions": functions, "classes": classes, "fields": fields, "calls": _calls(f), "imports": _imports(f), "annotations": _annotations(f), "refs": _refs(f.text),
        "python_properties": properties, "python_property_callers": _property_reads(f, properties, classes, fields),
    }
