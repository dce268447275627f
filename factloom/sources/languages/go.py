"""Facts of a Go file, from a lexer and bracket matching.

Lines count from 1, columns from 0 in UTF-8 bytes. Methods belong to the base type of their receiver,
and so do the calls in their bodies. Names of references have the kinds ``package_identifier`` (imports' own names too),
``field_identifier`` (after a dot, members, methods), ``type_identifier`` (in declarations, parameters and results) and
``identifier`` (all others: a lexer does not tell the use of a type from that of a value). Constants of the language are no references.
"""

from __future__ import annotations

import re

from .tokens import CLOSE, OPEN, File, Row, lex

_TOKEN = re.compile(r"(?P<skip>//[^\n]*|/\*.*?\*/|[ \t\r]+)|(?P<line>\n)|(?P<text>`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<name>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<mark>\.\.\.|.)", re.DOTALL)
#: The constants and the keywords of the language.
CONSTANTS = frozenset("true false nil iota".split())
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())


class _File(File):
    def __init__(self, text: str) -> None:
        super().__init__(text, lex(text, _TOKEN, KEYWORDS))

    def base(self, a: int, b: int) -> str | None:
        """The last name of a type before its type arguments: ``*p.T[K]`` gives ``T``."""
        found = None
        for k in range(a, b):
            if self.at(k) in OPEN and found:
                break
            if self.kind(k) == "name":
                found = self.at(k)
        return found


def _typed_name(f: _File, x: int, y: int) -> bool:
    """Whether a piece of a parameter list is a name with a type."""
    return y - x > 1 and f.kind(x) == "name" and f.at(x + 1) != "." and not (f.at(x + 1) == "[" and f.pair.get(x + 1) == y - 1 and f.pair[x + 1] > x + 2)


def _params(f: _File, a: int, b: int) -> list[Row]:
    parts = f.pieces(a, b, (",",))
    if not any(_typed_name(f, x, y) for x, y in parts):
        return [{"name": "", "param_type": f.source(x, y), "position": k} for k, (x, y) in enumerate(parts)]
    out: list[Row] = []
    kind = None
    for x, y in reversed(parts):  # a, b int: names without a type take the next one's
        if _typed_name(f, x, y):
            kind = f.source(x + 1, y)
        out.append({"name": f.at(x), "param_type": kind})
    return [{**row, "position": k} for k, row in enumerate(reversed(out))]


def _functions(f: _File) -> list[tuple[int, int, Row]]:
    """(first token, last token, row) of every declared function and method."""
    out = []
    for k, t in enumerate(f.tokens):
        if t.text != "func" or t.kind != "keyword":
            continue
        at, owner = k + 1, None
        if f.at(at) == "(":
            close = f.pair.get(at)
            if close is None or f.kind(close + 1) != "name":
                continue  # a literal
            names = f.pieces(at + 1, close, (",",))
            if names:
                x, y = names[0]
                owner = f.base(x + 1 if y - x > 1 and f.kind(x) == "name" and f.at(x + 1) not in (".", "[") else x, y)
            at = close + 1
        if f.kind(at) != "name":
            continue
        name, at = f.at(at), at + 1
        if f.at(at) == "[":
            at = f.pair.get(at, at) + 1
        if f.at(at) != "(" or at not in f.pair:
            continue
        close = end = f.pair[at]
        k2 = close + 1
        while k2 < len(f.tokens) and f.kind(k2) != "line":  # the result, then the body on the same line
            if f.at(k2) == "{" and f.at(k2 - 1) not in ("struct", "interface"):
                end = f.pair.get(k2, k2)
                break
            k2 = f.pair.get(k2, k2) if f.at(k2) in OPEN else k2
            end, k2 = k2, k2 + 1
        out.append((k, end, {"name": name, "class_name": owner, **f.span(k, end), "params": _params(f, at + 1, close)}))
    return out


def _types(f: _File) -> list[tuple[int, int, int, int, str]]:
    """(first, last, opening brace, name, kind) of struct and interface types, without those inside another."""
    out: list[tuple[int, int, int, int, str]] = []
    for k, t in enumerate(f.tokens):
        if t.kind != "keyword" or t.text != "type":
            continue
        specs = f.pieces(k + 2, f.pair.get(k + 1, k + 2), ("\n", ";")) if f.at(k + 1) == "(" else [(k + 1, len(f.tokens))]
        for a, _ in specs:
            at = a + 1
            if f.at(at) == "[" and f.kind(at + 1) == "name":
                at = f.pair.get(at, at) + 1
            at += f.at(at) == "="
            if f.kind(a) == "name" and f.at(at) in ("struct", "interface") and at + 1 in f.pair and not (out and a < out[-1][1]):
                out.append((a, f.pair[at + 1], at + 1, a, f.at(at)))
    return out


def _members(f: _File, owner: str, kind: str, a: int, b: int) -> tuple[list[Row], list[str], list[str]]:
    """Fields, methods and embedded types between the braces of a type."""
    fields, methods, embedded = [], [], []
    for x, y in f.pieces(a, b, ("\n", ";")):
        if f.kind(x) == "name" and f.at(x + 1) == "(" and kind == "interface":
            methods.append(f.at(x))
            continue
        if kind == "interface":
            continue
        end = y - 1 if f.kind(y - 1) == "text" and y - x > 1 else y  # without the tag
        if f.at(x) == "*" or end - x == 1 or f.at(x + 1) == "." or (f.at(x + 1) == "[" and f.pair.get(x + 1) == end - 1 and f.pair[x + 1] > x + 2):
            if base := f.base(x, end):
                embedded.append(base)
                fields.append({"class_name": owner, "name": base, "field_type": f.source(x, end), **f.span(x, y - 1)})
            continue
        names = [x]
        while f.at(names[-1] + 1) == ",":
            names.append(names[-1] + 2)
        fields += [{"class_name": owner, "name": f.at(n), "field_type": f.source(names[-1] + 1, end), **f.span(x, y - 1)} for n in names]
    return fields, methods, embedded


def _operand(f: _File, dot: int) -> int:
    """The first token of the operand that ends before the dot."""
    k = dot - 1
    while True:
        while f.at(k) in CLOSE and k in f.pair:
            k = f.pair[k] - 1
        if f.kind(k) != "name":
            return k + 1
        if f.at(k - 1) != ".":
            return k
        k -= 2


def _calls(f: _File, functions: list[tuple[int, int, Row]]) -> list[Row]:
    out = []
    for k in range(len(f.tokens)):
        at = k + 1
        if f.kind(k) != "name":
            continue
        if f.at(at) == "[":  # type arguments
            at = f.pair.get(at, at) + 1
        if f.at(at) != "(" or at not in f.pair or f.at(k - 1) == "]":
            continue
        inner = next(((a, b, r) for a, b, r in reversed(functions) if a <= k <= b), None)
        if inner is None and f.at(k - 1) in ("func", ")", "\n", "{", ""):
            continue  # the head of a function, or a method of an interface
        if inner is not None and (k == inner[0] + 1 or f.at(inner[0] + 1) == "(" and k == f.pair[inner[0] + 1] + 1):
            continue
        first = _operand(f, k - 1) if f.at(k - 1) == "." else k
        caller = inner[2] if inner else {"name": None, "class_name": None}
        out.append({"callee": f.at(k), "caller": caller["name"], "caller_class_name": caller["class_name"], "object_name": f.source(first, k - 1) if first < k else None, **f.span(first, f.pair[at])})
    return out


def _imports(f: _File) -> list[Row]:
    out = []
    for k, t in enumerate(f.tokens):
        if t.kind == "keyword" and t.text == "import":
            stop = f.pair.get(k + 1) if f.at(k + 1) == "(" else next((j for j in range(k, len(f.tokens)) if f.kind(j) == "line"), len(f.tokens))
            out += [{"module": f.at(j)[1:-1] if f.at(j)[0] == '"' else f.at(j), **f.span(j, j)} for j in range(k, stop or k) if f.kind(j) == "text"]
    return out


def _typed(f: _File, kinds: dict[int, str], a: int, b: int) -> None:
    """Mark the names of a type: packages before a dot, types elsewhere."""
    for k in range(a, b):
        if f.kind(k) == "name":
            kinds.setdefault(k, "package_identifier" if f.at(k + 1) == "." else "type_identifier")


def _signed(f: _File, kinds: dict[int, str], at: int) -> None:
    """Mark the names of the parameter list that opens at ``at`` and of the results after it."""
    if f.at(at) != "(" or at not in f.pair:
        return
    after = f.pair[at] + 1
    for a in (at, after):
        if f.at(a) == "(" and a in f.pair:
            parts = f.pieces(a + 1, f.pair[a], (",",))
            named = any(_typed_name(f, x, y) for x, y in parts)
            for x, y in parts:
                if named and f.kind(x) == "name":
                    kinds.setdefault(x, "identifier")
                _typed(f, kinds, x, y)
    end = after
    while f.at(end) in ("*", "<", "-", "chan", "map") or f.at(end) == "[" and end in f.pair:
        end = f.pair.get(end, end) + 1
    while f.kind(end) == "name":
        end += 2 if f.at(end + 1) == "." else 1
        if f.at(end - 1) != ".":
            break
    _typed(f, kinds, after, f.pair.get(end, end) if f.at(end) == "[" else end)


def _kinds(f: _File) -> dict[int, str]:
    """Kinds of the names in declarations: imports, members, receivers, parameters, results."""
    kinds: dict[int, str] = {}
    for k, t in enumerate(f.tokens):
        if t.kind != "keyword" or t.text not in ("func", "import"):
            continue
        at = k + 1
        if t.text == "import":
            for x, _ in f.pieces(at + 1, f.pair[at], ("\n", ";")) if f.at(at) == "(" and at in f.pair else [(at, at + 1)]:
                if f.kind(x) == "name":
                    kinds[x] = "package_identifier"
            continue
        close = f.pair.get(at, at)
        if f.at(at) == "(" and f.kind(close + 1) == "name" and f.at(close + 2) == "(" and close > at:  # a method; else a literal or a type
            if f.kind(at + 1) == "name" and close - at > 2 and f.at(at + 2) not in (".", "["):
                kinds.setdefault(at + 1, "identifier")
            _typed(f, kinds, at + 1, close)
            kinds[close + 1] = "field_identifier"
            at = close + 1
        at += f.kind(at) == "name"
        if f.at(at) == "[":
            at = f.pair.get(at, at) + 1
        _signed(f, kinds, at)
    for _, last, brace, _, kind in _types(f):
        for x, y in f.pieces(brace + 1, last, ("\n", ";")):
            if kind == "interface":
                if f.kind(x) == "name" and f.at(x + 1) == "(":
                    kinds[x] = "field_identifier"
                    _signed(f, kinds, x + 1)
                else:
                    _typed(f, kinds, x, y)
                continue
            names = [x]
            while f.at(names[-1] + 1) == ",":
                names.append(names[-1] + 2)
            embedded = f.at(x) == "*" or f.kind(x + 1) != "name" and len(names) == 1 and f.at(x + 1) not in ("[", "*", "map", "func", "chan", "struct", "interface", "(")
            if not embedded:
                kinds |= dict.fromkeys(names, "field_identifier")
            _typed(f, kinds, x if embedded else names[-1] + 1, y)
    return kinds


def _refs(f: _File) -> list[Row]:
    out, kinds = [], _kinds(f)
    for k, t in enumerate(f.tokens):
        if t.kind == "name" and t.text not in CONSTANTS:
            kind = {"package": "package_identifier", ".": "field_identifier", "type": "type_identifier"}.get(f.at(k - 1), "identifier")
            out.append(f.place(k, kinds.get(k, kind)))
    return out


def snapshot(text: str) -> dict[str, list[Row]]:
    """All facts of a file. Functions carry their params, classes their methods and super classes."""
    f = _File(text)
    functions = _functions(f)
    classes, fields = [], []
    for first, last, brace, name, kind in _types(f):
        owner = f.at(name)
        own, methods, embedded = _members(f, owner, kind, brace + 1, last)
        methods = sorted({*methods, *(r["name"] for *_, r in functions if r["class_name"] == owner)})
        classes.append({"name": owner, "kind": kind, **f.span(first, last), "methods": methods, "super_classes": list(dict.fromkeys(embedded))})
        fields += own
    return {"functions": [r for *_, r in functions], "classes": classes, "fields": fields, "calls": _calls(f, functions), "imports": _imports(f), "refs": _refs(f)}
