"""Facts of JavaScript, TypeScript and TSX files, from a lexer, bracket matching and a scan for declarations.

Functions are declarations, methods of classes and object literals, named function expressions, and
variables that hold an arrow or function expression; the span of the last begins at the variable. A
call's caller is the innermost function with a name of its own or from an assignment, an object key or
a default export. A plain call of an alias (``const a = b``, ``[f, g]``, ``for (x of fs)``) gives a row
for each function that the alias can stand for there; a receiver whose class is known there (a new
object, a typed field of ``this``) is told by that class. Names of references have the kinds
``property_identifier`` (after a dot, and names of members), ``private_property_identifier``,
``type_identifier`` (in types) and ``identifier``. Text between the tags of JSX is read as code.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from .tokens import OPEN, File, Row, Token, innermost

_SKIP = re.compile(r"(?://[^\n]*|/\*.*?\*/|\s+|\A#![^\n]*)+", re.DOTALL)
_TEXT = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.DOTALL)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*", re.DOTALL)
_WORD = re.compile(r"#?[^\W\d][\w$]*|#?\$[\w$]*|(?P<number>\d[\w.]*)")
_MARK = re.compile(r"\.\.\.|===|!==|=>|==|!=|<=|&&=?|\|\|=?|\?\?=?|\?\.(?!\d)|\*\*=?|\+\+|--|[-+*/%&|^]=|.", re.DOTALL)
#: Reserved words, and those of them after which a value begins.
KEYWORDS = frozenset(
    "await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof let new null return super switch this throw true try typeof var void while with yield".split()
)
#: Words that are keywords before a name alone, and types that the language has.
_BEFORE_NAME = frozenset("abstract as async declare enum get implements infer interface is keyof namespace of override private protected public readonly satisfies set static type".split())
_OWN_TYPES = frozenset("any boolean never number object string symbol unknown".split())
_BEFORE_VALUE = frozenset("await case delete do else in instanceof new return throw typeof void yield".split())
_ACCESS = frozenset("public private protected readonly".split())
_MEMBER = _ACCESS | {"static", "async", "get", "set", "abstract", "override", "declare", "accessor"}
_OPERATORS = frozenset(". ?. = + - * / % & | ^ < > ? : , && || ?? => == === != !== <= += -= *= /= ( [ ! ~ ...".split())
#: Calls whose first argument is the class of the result.
_FACTORIES = frozenset(("inject", "forwardRef", "signal", "computed"))


def _lex(text: str) -> list[Token]:
    out: list[Token] = []
    at, line, open_templates, depth = 0, 1, [], 0

    def add(kind: str, end: int, shown: str | None = None) -> None:
        nonlocal at, line
        out.append(Token(kind, text[at:end] if shown is None else shown, line, at, end))
        line += text.count("\n", at, end)
        at = end

    def template() -> None:
        """The literal part that begins here, and what follows it."""
        if (end := _TEMPLATE.match(text, at).end()) > at:
            add("text", end)
        if text.startswith("${", at):
            open_templates.append(depth)
            add("mark", at + 2, "{")
        elif at < len(text):
            add("text", at + 1)

    while at < len(text):
        if m := _SKIP.match(text, at):
            line += m[0].count("\n")
            at = m.end()
            continue
        c, last = text[at], out[-1] if out else None
        if c == "`":
            add("text", at + 1)
            template()
        elif m := _TEXT.match(text, at):
            add("text", m.end())
        elif m := _WORD.match(text, at):
            add("number" if m["number"] else "keyword" if m[0] in KEYWORDS and not (last and last.text in (".", "?.")) else "name", m.end())
        elif c == "/" and (last is None or last.kind == "mark" and last.text not in (")", "]", "}") or last.text in _BEFORE_VALUE and last.kind == "keyword") and (m := _REGEX.match(text, at)):
            add("text", m.end())
        elif c == "}" and open_templates and open_templates[-1] == depth:
            open_templates.pop()
            add("mark", at + 1)
            template()
        else:
            depth += (c == "{") - (c == "}")
            add("mark", _MARK.match(text, at).end())
    return out


class _File(File):
    def __init__(self, text: str, language: str) -> None:
        super().__init__(text, _lex(text))
        self.language = language
        self.functions: list[tuple[int, int, Row]] = []
        self.scopes: list[tuple[int, int, str]] = []  # functions by the names that calls see
        self.classes: list[tuple[int, int, Row]] = []
        self.fields: dict[tuple[str, str], Row] = {}
        self.owners: list[int] | None = None
        self.heads: set[int] = set()
        self.types: set[int] = set()
        self.members: set[int] = set()
        self.waiting: list[tuple[str, int, Row]] = []  # fields set from an untyped constructor parameter

    # ---- places -------------------------------------------------------------------------------

    def angle(self, k: int) -> int:
        """The token after the type arguments that open at ``k``; ``k`` itself if none do."""
        if self.at(k) != "<":
            return k
        depth, j = 0, k
        while j < len(self.tokens):
            t = self.at(j)
            if t in ("<", ">"):
                depth += 1 if t == "<" else -1
                if depth == 0:
                    return j + 1
            elif t in (";", "}", ")", "]", "&&", "||", "===", "!==") or self.kind(j) == "number":
                return k
            j = self.pair.get(j, j) + 1 if t in OPEN else j + 1
        return k

    def type_end(self, k: int) -> int:
        """The token after the type that begins at ``k``."""
        begin, wanted = k, True  # an operand is wanted
        while k < len(self.tokens):
            t = self.at(k)
            if not wanted and t in ("|", "&", "=>", ".", "is", "extends", "?", ":") and not (t == "=>" and self.at(k - 1) != ")") and not (t in ("?", ":") and "extends" not in self.source(begin, k)):
                wanted, k = True, k + 1
            elif not wanted and t == "<" and self.angle(k) > k:
                k = self.angle(k)
            elif not wanted and t == "[" and self.tokens[k].line == self.tokens[k - 1].line:
                k = self.pair.get(k, k) + 1
            elif not wanted:
                break
            elif t in ("|", "&"):
                k += 1
            elif t in ("keyof", "typeof", "infer", "readonly", "unique", "asserts", "new", "abstract") and (self.kind(k + 1) in ("name", "keyword") or self.at(k + 1) in OPEN):
                k += 1
            elif t in OPEN and k in self.pair:
                k, wanted = self.pair[k] + 1, False
            elif t == "<" and self.angle(k) > k:
                k = self.angle(k)
            elif self.kind(k) in ("name", "keyword", "text", "number") or t == "-":
                wanted = t == "-"
                k += 1
            else:
                break
        self.types.update(j for j in range(begin, k) if self.kind(j) == "name")
        return k

    def value_end(self, k: int, stop: int) -> int:
        """The token after the expression that begins at ``k``, at most ``stop``."""
        begin = k
        while k < stop and self.at(k) not in (",", ";", ")", "]", "}"):
            if k > begin and self.tokens[k].line > self.tokens[k - 1].line and self.at(k) not in _OPERATORS - {"!", "~", "..."} and self.at(k) not in ("in", "instanceof") and self.at(k - 1) not in _OPERATORS and self.at(k - 1) not in _BEFORE_VALUE:
                break
            if self.at(k) == "<" and self.language != "javascript" and self.at(self.angle(k)) == "(":
                k = self.angle(k)
                continue
            if self.at(k) == "(" and self.at(k - 1) in _OPERATORS and self.at(self.pair.get(k, k) + 1) == ":" and self.language != "javascript":
                arrow = self.type_end(self.pair[k] + 2)
                if self.at(arrow) == "=>":
                    k = arrow
                    continue
            k = self.pair.get(k, k) + 1 if self.at(k) in OPEN else k + 1
        return min(k, stop)

    def statement(self, k: int) -> bool:
        """Whether a statement begins at ``k``."""
        return k == 0 or self.at(k - 1) in (";", "{", "}", "export", "default", "declare", ")", "else") or self.tokens[k - 1].line < self.tokens[k].line and self.at(k - 1) not in _OPERATORS

    def class_of(self, k: int) -> str | None:
        """The class around token ``k``, when all are known."""
        if self.owners is None:
            self.owners = innermost(len(self.tokens), [x[:2] for x in self.classes])
        return self.classes[self.owners[k]][2]["name"] if self.owners[k] >= 0 else None

    # ---- functions ----------------------------------------------------------------------------

    def params(self, bracket: int) -> list[Row]:
        out: list[Row] = []
        k, last = bracket + 1, self.pair.get(bracket, bracket)
        while k < last:
            property_of, first = False, k
            while self.at(k) == "@":
                k += 2
                while self.at(k) == ".":
                    k += 2
                k = self.pair.get(k, k) + 1 if self.at(k) == "(" else k
            while self.at(k) in _MEMBER and (self.kind(k + 1) in ("name", "keyword") or self.at(k + 1) in ("{", "[")):
                property_of, k = property_of or self.at(k) in _ACCESS, k + 1
            k += self.at(k) == "..."
            end = self.pair.get(k, k) + 1 if self.at(k) in ("{", "[") else k + 1
            name, kind = self.source(k, end), None
            k = end + (self.at(end) == "?")
            if self.at(k) == ":":
                k = self.type_end(k + 1)
                kind = self.source(end + 1 + (self.at(end) == "?"), k)
            while k < last and self.at(k) != ",":
                k = self.pair.get(k, k) + 1 if self.at(k) in OPEN else k + 1
            if name not in (",", ")"):
                out.append({"name": name, "param_type": kind, "position": len(out), "_property": property_of, "_span": (first, k - 1)})
            k += 1
        return out

    def add(self, first: int, last: int, name: str, bracket: int | None, single: int | None = None) -> Row:
        params = self.params(bracket) if bracket is not None else [{"name": self.at(single), "param_type": None, "position": 0, "_property": False, "_span": (single, single)}] if single is not None else []
        row = {"name": name, "class_name": None, **self.span(first, last), "params": params}
        self.functions.append((first, last, row))
        return row

    def after_params(self, bracket: int) -> int:
        """The token after a parameter list and its result type."""
        k = self.pair[bracket] + 1
        return self.type_end(k + 1) if self.at(k) == ":" else k

    def lambda_at(self, k: int) -> tuple[int, int | None, int | None] | None:
        """(last token, bracket of the parameters, lone parameter) of the arrow or function expression at ``k``."""
        k += self.at(k) == "async" and self.at(k + 1) not in ("=>", ",", ")")
        if self.at(k) == "function":
            at = k + 1
            if self.at(at) == "*":
                return None
            at += self.kind(at) == "name"
            at = self.angle(at)
            if self.at(at) != "(" or at not in self.pair:
                return None
            brace = self.after_params(at)
            return (self.pair[brace], at, None) if self.at(brace) == "{" and brace in self.pair else None
        at = self.angle(k)
        if self.at(at) == "(" and at in self.pair:
            arrow = self.pair[at] + 1
            if self.at(arrow) == ":" and self.language != "javascript":
                arrow = self.type_end(arrow + 1)
            found = (at, None)
        elif self.kind(at) == "name":
            arrow, found = at + 1, (None, at)
        else:
            return None
        if self.at(arrow) != "=>":
            return None
        if self.at(arrow + 1) == "{" and arrow + 1 in self.pair:
            return (self.pair[arrow + 1], *found)
        return (max(arrow, self.value_end(arrow + 1, len(self.tokens)) - 1), *found)

    def scan(self) -> None:
        for k in range(len(self.tokens)):
            word = self.at(k)
            if word == "function" and self.kind(k) == "keyword":
                self.declared_function(k)
            elif word in ("const", "let", "var") and self.at(k + 1) != "enum":
                self.variables(k)
            elif word in ("class", "interface", "type", "enum", "namespace") and self.at(k - 1) not in (".", "?."):
                self.declared_class(k)
            elif word == "(" and k in self.pair and self.kind(k - 1) in ("name", "text") or word == "(" and self.at(k - 1) == ">":
                self.method(k)
            elif word in (":", "=", "default") and (found := self.lambda_at(k + 1)):
                before = self.at(k - 1)
                if word == "default":
                    self.scopes.append((k + 1, found[0], "<default_export>"))
                elif self.kind(k - 1) in ("name", "text") and self.at(k - 2) not in (".", "?."):
                    self.scopes.append((k + 1, found[0], before.strip("\"'")))
        for first, last, row in self.functions:
            row["class_name"] = self.class_of(first)
            self.scopes.append((first, last, row["name"]))

    def declared_function(self, k: int) -> None:
        star = self.at(k + 1) == "*"
        name = k + 1 + star
        bracket = self.angle(name + 1)
        if self.kind(name) != "name" or self.at(bracket) != "(" or bracket not in self.pair:
            return
        self.heads.add(name)
        brace, first = self.after_params(bracket), k - (self.at(k - 1) == "async")
        if self.at(brace) == "{" and brace in self.pair and not (star and (self.language == "tsx" or not self.statement(first))):
            self.add(first, self.pair[brace], self.at(name), bracket)

    def variables(self, k: int) -> None:
        k += 1
        while k < len(self.tokens):
            name = k
            k = self.pair.get(k, k) + 1 if self.at(k) in OPEN else k + 1
            k += self.at(k) == "!"
            if self.at(k) == ":":
                k = self.type_end(k + 1)
            if self.at(k) == "=":
                found = self.lambda_at(k + 1) if self.kind(name) == "name" else None
                if found:
                    self.add(name, found[0], self.at(name), found[1], found[2])
                elif self.at(k + 1) == "class" and self.kind(name) == "name":
                    self.class_body(name, k + 1, self.at(name), "class")
                k = found[0] + 1 if found else self.value_end(k + 1, len(self.tokens))
            if self.at(k) != ",":
                return
            k += 1

    def method(self, bracket: int) -> None:
        """A method of a class or an object literal whose parameters open at ``bracket``."""
        name = bracket - 1
        if self.at(name) == ">":
            depth = 0
            while name >= 0 and self.at(name) not in (";", "{", "}"):
                depth += (self.at(name) == ">") - (self.at(name) == "<")
                name -= 1
                if depth == 0:
                    break
        first = name
        while self.at(first - 1) in _MEMBER or self.at(first - 1) == "*" and self.at(first - 2) != "function":
            first -= 1
        before = self.at(first - 1)
        newline = first > 0 and self.tokens[first - 1].line < self.tokens[first].line
        if self.kind(name) not in ("name", "text") or bracket not in self.pair or before not in ("{", ",", ";", "}", "", ")") and not newline:
            return
        brace = self.after_params(bracket)
        if self.at(brace) != "{" or brace not in self.pair or self.at(brace - 1) == "=>":
            return
        self.heads.add(name)
        if self.kind(name) == "name":
            self.members.add(name)
            self.add(first, self.pair[brace], self.at(name), bracket)

    # ---- classes ------------------------------------------------------------------------------

    def declared_class(self, k: int) -> None:
        word, name = self.at(k), k + 1
        typed = self.language != "javascript"
        if self.kind(name) != "name" or self.at(name) in ("extends", "implements"):
            return
        if word == "class":
            if not any(x[0] <= k <= x[1] and self.at(x[0] + 1) == "=" and self.at(x[0] + 2) == "class" and x[0] + 2 == k for x in self.classes):
                abstract = typed and self.at(k - 1) == "abstract"
                self.class_body(k - abstract, k, self.at(name), "abstract_class" if abstract else "class")
        elif typed and self.statement(k) or typed and word == "enum" and self.at(k - 1) == "const":
            after = self.angle(name + 1)
            if word == "type" and self.at(after) == "=":
                self.opened(k, max(self.type_end(after + 1) - 1, after), self.at(name), "alias")
            elif word in ("interface", "enum"):
                brace = after
                while brace < len(self.tokens) and self.at(brace) not in ("{", ";", "}"):
                    brace += 1
                if self.at(brace) == "{" and brace in self.pair:
                    first = k - (self.at(k - 1) == "const")
                    if (row := self.opened(first, self.pair[brace], self.at(name), word)) and word == "interface":
                        row["methods"] = self.signatures(brace)

    def opened(self, first: int, last: int, name: str, kind: str) -> Row | None:
        if any(a <= first <= b for a, b, _ in self.classes):
            return None  # inside another class
        row = {"name": name, "kind": kind if self.language != "javascript" else "class", **self.span(first, last), "methods": [], "super_classes": []}
        self.classes.append((first, last, row))
        return row

    def signatures(self, brace: int) -> list[str]:
        out = []
        for k in range(brace + 1, self.pair[brace]):
            bracket = self.angle(k + 1 + (self.at(k + 1) == "?"))
            if self.kind(k) == "name" and self.at(bracket) == "(" and (self.at(k - 1) in ("{", ";", ",", "get", "set") or self.tokens[k - 1].line < self.tokens[k].line):
                self.heads.add(k)
                self.members.add(k)
                out.append(self.at(k))
        return out

    def class_body(self, first: int, k: int, name: str, kind: str) -> None:
        k += 1 + (self.kind(k + 1) == "name" and self.at(k + 1) not in ("extends", "implements"))
        k = self.angle(k)
        supers: list[str] = []
        while k < len(self.tokens) and self.at(k) not in ("{", ";", "}"):
            if self.kind(k) == "name" and self.at(k) != "implements":
                end = k
                while self.at(end + 1) == "." and self.kind(end + 2) == "name":
                    end += 2
                supers += [self.source(k, end + 1), self.at(end)]
                k = end + 1
            elif self.at(k) == "<" and self.angle(k) > k:
                begin, k = k, self.angle(k)
                self.types.update(j for j in range(begin, k) if self.kind(j) == "name")
            else:
                k = self.pair.get(k, k) + 1 if self.at(k) in OPEN else k + 1
        if self.at(k) != "{" or k not in self.pair or (row := self.opened(first, self.pair[k], name, kind)) is None:
            return
        row["super_classes"] = list(dict.fromkeys(supers))
        row["methods"] = self.body(k, name)

    def body(self, brace: int, owner: str) -> list[str]:
        methods, k, last = [], brace + 1, self.pair[brace]
        while k < last:
            if self.at(k) == ";":
                k += 1
                continue
            first = k
            while self.at(k) == "@":
                k += 2
                while self.at(k) == ".":
                    k += 2
                k = self.pair.get(k, k) + 1 if self.at(k) == "(" else k
            while self.at(k) in _MEMBER and self.at(k + 1) not in ("(", "=", ";", ":", "?", "!", "}", "<") or self.at(k) == "*":
                k += 1
            name = k
            if self.at(k) == "{":  # a static block
                k = self.pair.get(k, k) + 1
                continue
            k = self.pair.get(k, k) + 1 if self.at(k) in OPEN else k + 1
            k += self.at(k) in ("?", "!")
            bracket = self.angle(k)
            if self.at(bracket) == "(" and bracket in self.pair:
                if self.kind(name) == "name" or self.at(name) not in OPEN and self.kind(name) == "keyword":
                    methods.append(self.at(name))
                    self.heads.add(name)
                    self.members.add(name)
                k = self.after_params(bracket)
                if self.at(k) == "{" and k in self.pair:
                    if self.at(name) == "constructor":
                        self.constructed(owner, bracket, k)
                    k = self.pair[k] + 1
                continue
            kind = None
            if self.at(k) == ":":
                begin, k = k + 1, self.type_end(k + 1)
                kind = self.source(begin, k)
            if self.at(k) == "=":
                begin, k = k + 1, self.value_end(k + 1, last)
                kind = kind or self.made(begin)
            if self.kind(name) == "name":
                self.members.add(name)
                self.field(owner, self.at(name), kind, first, max(first, k - 1))
            k = max(k, name + 1)
        return methods

    def field(self, owner: str, name: str, kind: str | None, a: int, b: int) -> Row:
        row = self.fields.setdefault((owner, name), {"class_name": owner, "name": name, "field_type": None, **self.span(a, b)})
        row["field_type"] = row["field_type"] or kind
        return row

    def made(self, k: int) -> str | None:
        """The class of the value at ``k`` where the text tells it."""
        if self.at(k) == "new" and self.kind(k + 1) == "name":
            end = k + 1
            while self.at(end + 1) == "." and self.kind(end + 2) == "name":
                end += 2
            return self.source(k + 1, end + 1)
        if self.at(k) in _FACTORIES:
            if self.at(k + 1) == "<" and (end := self.angle(k + 1)) > k + 1:
                return self.source(k + 2, end - 1)
            if self.at(k + 1) == "(" and self.kind(k + 2) == "name" and self.at(k + 3) in (")", ","):
                return self.at(k + 2)
        return None

    def constructed(self, owner: str, bracket: int, brace: int) -> None:
        """Fields from a constructor: parameters with an access word, and ``this.x = ...``."""
        params = self.params(bracket)
        for p in params:
            if p["_property"]:
                self.field(owner, p["name"], p["param_type"], *p["_span"])
        known = {p["name"]: p for p in params}
        for k in range(brace + 1, self.pair[brace]):
            if self.at(k) == "this" and self.at(k + 1) == "." and self.at(k + 3) == "=" and self.at(k - 1) not in (".",):
                end = self.value_end(k + 4, self.pair[brace])
                given = known.get(self.at(k + 4)) if end == k + 5 else None
                row = self.field(owner, self.at(k + 2), given["param_type"] if given else self.made(k + 4), k, max(k, end - 1))
                if given and not given["param_type"]:
                    self.waiting.append((owner, given["position"], row))

    def infer(self) -> None:
        """Types of fields from what ``new C(...)`` is given, if all such places agree on one class."""
        if not self.waiting:
            return
        sites: dict[str, list[int]] = {}
        made: dict[str, list[tuple[int, str]]] = {}
        for k in range(len(self.tokens)):
            if self.at(k) == "new" and self.at(k + 2) == "(" and k + 2 in self.pair:
                sites.setdefault(self.at(k + 1), []).append(k)
            elif self.at(k) == "=" and (kind := self.made(k + 1)):
                made.setdefault(self.at(k - 1), []).append((k, kind))

        def argument(k: int, position: int) -> str | None:
            parts = self.pieces(k + 3, self.pair[k + 2], (",",))
            if position >= len(parts):
                return None
            a, b = parts[position]
            had = made.get(self.at(a), []) if b == a + 1 else []
            n = bisect_left(had, k, key=lambda e: e[0])
            return self.made(a) or (had[n - 1][1] if n else None)

        known: dict[tuple[str, int], str | None] = {}
        for owner, position, row in self.waiting:
            if (owner, position) not in known:
                found = {argument(k, position) for k in sites.get(owner, [])}
                known[owner, position] = found.pop() if len(found) == 1 else None
            row["field_type"] = row["field_type"] or known[owner, position]


class _Bindings:
    """What the names of a function stand for at each place."""

    def __init__(self, f: _File, a: int, b: int) -> None:
        self.aliases: dict[str, list[tuple[int, tuple[str, ...]]]] = {}  # by name: place, what it can stand for from there on
        self.objects: dict[str, list[tuple[int, str]]] = {}  # by name: place, what the assignment gives

        def put(at: int, name: str, targets: tuple[str, ...], adds: bool) -> None:
            had = self.aliases.setdefault(name, [])
            before = had[-1][1] if had else ()
            new = tuple(dict.fromkeys((*before, *targets))) if adds else targets
            if new and new != before:
                had.append((at, new))

        def give(at: int, name: str, what: str) -> None:
            self.objects.setdefault(name, []).append((at, what))

        for k in range(a, b + 1):
            if f.at(k) == "=" and f.kind(k - 1) == "name" and f.at(k - 2) not in (".", "?."):
                name, v = f.at(k - 1), k + 1
                end = f.value_end(v, b + 1)
                text = f.source(v, end)
                if f.at(v) == "new" and (made := f.made(v)):
                    give(k, name, made)
                elif f.at(v) == "[" and f.pair.get(v) == end - 1:
                    put(k, name, tuple(f.at(x) for x, y in f.pieces(v + 1, end - 1, (",",)) if y == x + 1 and f.kind(x) == "name"), True)
                elif f.kind(v) == "name" and re.fullmatch(r"[\w$]+(?:\.[\w$]+)*", text):
                    put(k, name, (text,), True)
                    give(k, name, text)
                elif re.fullmatch(r"this(?:\.#?[\w$]+)+", text):
                    give(k, name, text)
            elif f.at(k) == "of" and f.kind(k - 1) == "name" and f.at(k - 2) in ("const", "let", "var", "(") and f.kind(k + 1) == "name" and f.at(k + 2) == ")":
                put(k, f.at(k - 1), (self.aliases.get(f.at(k + 1)) or [(0, ())])[-1][1], False)

    def leaves(self, at: int, name: str) -> list[str]:
        seen, out, queue = set(), set(), [name]
        while queue:
            x = queue.pop()
            if x not in seen:
                seen.add(x)
                had = self.aliases.get(x, [])
                if n := bisect_left(had, at, key=lambda e: e[0]):
                    queue.extend(had[n - 1][1])
                else:
                    out.add(x)
        return sorted(out)

    def receiver(self, f: _File, at: int, target: str, owner: str | None, classes: set[str]) -> str | None:
        """The class of a receiver; None where it is not known."""
        seen: set[str] = set()
        while True:
            if target in classes:
                return target
            head, *rest = target.split(".")
            if head == "this":
                kind = owner
                for name in rest:
                    row = f.fields.get((kind or "", name))
                    kind = row["field_type"] if row else None
                return kind if rest and kind in classes else None
            had = self.objects.get(head, [])
            n = bisect_left(had, at, key=lambda e: e[0])
            if not n or head in seen:  # x = x.next makes ever longer targets, so the heads tell of a circle
                return None
            seen.add(head)
            target = ".".join((had[n - 1][1], *rest))


def _operand(f: _File, dot: int) -> int:
    """The first token of the expression before the dot."""
    k = dot - 1
    while k >= 0:
        while f.at(k) in (")", "]") and k in f.pair:
            k = f.pair[k] - 1
            if f.kind(k) not in ("name", "keyword") and f.at(k) not in (")", "]"):
                return k + 1
        if f.at(k) in ("}", ">") or f.kind(k) == "mark":
            return f.pair.get(k, k) if f.at(k) == "}" else k + 1
        if f.at(k - 1) == "new":
            return k - 1
        if f.kind(k) == "keyword" and f.at(k) not in ("this", "super", "null", "true", "false", "import"):
            return k + 1
        if f.at(k - 1) not in (".", "?."):
            return k
        k -= 2
        k -= f.at(k) == "!"
    return 0


def _calls(f: _File) -> list[Row]:
    out: list[tuple[int, int, Row]] = []
    classes = {r["name"] for *_, r in f.classes}
    bindings: dict[tuple[int, int], _Bindings] = {}
    inner = innermost(len(f.tokens), [x[:2] for x in f.scopes])

    def add(first: int, last: int, callee: str, target: str | None) -> None:
        scope = f.scopes[inner[first]] if inner[first] >= 0 else None
        owner, told = f.class_of(first), [(callee, target)]
        if scope is not None:
            if scope[:2] not in bindings:
                bindings[scope[:2]] = _Bindings(f, *scope[:2])
            known = bindings[scope[:2]]
            if target is None:
                told = [(x.rpartition(".")[2], x.rpartition(".")[0] or None) for x in known.leaves(first, callee)]
            elif target not in ("this", "super()") and (kind := known.receiver(f, first, target, owner, classes)):
                told = [(callee, kind)]
        for name, where in told:
            row = {"callee": name, "caller": scope[2] if scope else None, "caller_class_name": owner, "object_name": where, **f.span(first, last)}
            out.append((f.tokens[first].start, -f.tokens[last].end, row))

    for k in range(len(f.tokens)):
        word = f.at(k)
        if word == "new" and f.kind(k + 1) == "name":
            text = f.made(k)
            end = k + 1
            while f.at(end + 1) == "." and f.kind(end + 2) == "name":
                end += 2
            after = f.angle(end + 1)
            add(k, f.pair.get(after, end) if f.at(after) == "(" else end, "constructor", text)
            continue
        bracket = f.angle(k + 1) if f.language != "javascript" else k + 1
        bracket += f.at(bracket) == "?." and f.at(bracket + 1) == "("
        if f.at(bracket) != "(" or bracket not in f.pair:
            continue
        if word == "super":
            add(k, f.pair[bracket], "constructor", "super()")
        elif f.kind(k) == "name" and k not in f.heads and not (word == "async" and f.at(f.pair[bracket] + 1) == "=>") and f.at(k - 1) != "@":
            if f.at(k - 1) in (".", "?."):
                first = _operand(f, k - 1)
                target = f.source(first, k - 1)
                if f.at(first) != "new" and (first == 0 or f.at(first - 1) != "new"):
                    add(first, f.pair[bracket], word, target)
                elif f.at(first) == "new" and ")" in target:
                    add(first, f.pair[bracket], word, target)
            elif f.at(k - 1) != "new" and word[0] != "#" and k not in f.types:
                add(k, f.pair[bracket], word, None)
    return [r for *_, r in sorted(out, key=lambda x: x[:2])]


def _imports(f: _File) -> list[Row]:
    out = []
    for k, t in enumerate(f.tokens):
        if t.text in ("require", "import") and f.at(k + 1) == "(" and f.at(k - 1) not in (".", "?."):
            if f.kind(k + 2) == "text" and f.at(k + 2)[0] in "\"'":
                out.append({"module": f.at(k + 2)[1:-1], **f.span(k, f.pair.get(k + 1, k + 2))})
        elif t.kind == "keyword" and t.text in ("import", "export") and f.statement(k):
            j = k + 1
            if t.text == "export" and f.at(j) not in ("{", "*", "type"):
                continue
            while j < len(f.tokens) and f.kind(j) != "text" and f.at(j) not in (";", "=", "("):
                j = f.pair.get(j, j) + 1 if f.at(j) in OPEN else j + 1
                if j < len(f.tokens) and f.at(j - 1) == "}" and f.at(j) != "from":
                    break
            if f.kind(j) == "text" and f.at(j)[0] in "\"'" and f.at(j - 1) in ("from", "import"):
                out.append({"module": f.at(j)[1:-1], **f.span(k, j + (f.at(j + 1) == ";"))})
    return sorted(out, key=lambda r: (r["start_line"], r["end_line"]))


def _declared(f: _File) -> set[int]:
    """Names of types where TypeScript declares, implements or (an interface) extends them."""
    out: set[int] = set()
    for k, t in enumerate(f.tokens):
        if f.at(k - 1) in (".", "?."):
            continue
        if t.text in ("class", "interface") or t.text == "type" and f.at(k + 2) in ("=", "<"):
            out.add(k + 1)
        if t.text == "implements" or t.text == "extends" and f.at(k - 2) == "interface":
            j = k + 1
            while j < len(f.tokens) and f.at(j) not in ("{", ";"):
                out.add(j)
                j += 1
    return out


def _is_word(f: _File, k: int, types: set[int]) -> bool:
    """Whether a name is a word of the language where it stands."""
    t = f.tokens[k]
    if f.at(k - 1) in (".", "?."):
        return False
    follows = f.kind(k + 1) == "name" and f.tokens[k + 1].line == t.line
    return t.text in _BEFORE_NAME and follows or t.text == "from" and f.at(k + 1)[:1] in ("'", '"') or t.text in _OWN_TYPES and k in types


def _refs(f: _File) -> list[Row]:
    out = []
    types = f.types if f.language == "javascript" else f.types | _declared(f)
    for k, t in enumerate(f.tokens):
        if t.kind == "name" and not _is_word(f, k, types):
            key = f.at(k + 1) == ":" and f.at(k - 1) in ("{", ",") or k in f.members
            kind = "private_property_identifier" if t.text[0] == "#" else "property_identifier" if f.at(k - 1) in (".", "?.") or key else "type_identifier" if k in types else "identifier"
            out.append(f.place(k, kind))
    return out


def _snapshot(text: str, language: str) -> dict[str, list[Row]]:
    f = _File(text, language)
    f.scan()
    f.infer()
    by_place = lambda r: (r["start_line"], r["end_line"])
    functions, seen = [], set()
    for first, last, row in sorted(f.functions, key=lambda x: (f.tokens[x[0]].start, -x[1])):
        key = (first, last, row["name"])
        if key not in seen:
            seen.add(key)
            functions.append({**row, "params": [{n: p[n] for n in ("name", "param_type", "position")} for p in row["params"]]})
    return {"functions": sorted(functions, key=by_place), "classes": sorted((r for *_, r in f.classes), key=by_place), "fields": list(f.fields.values()), "calls": _calls(f), "imports": _imports(f), "refs": _refs(f)}


def javascript(text: str) -> dict[str, list[Row]]:
    """All facts of a JavaScript file. Functions carry their params, classes their methods and super classes."""
    return _snapshot(text, "javascript")


def typescript(text: str) -> dict[str, list[Row]]:
    """All facts of a TypeScript file."""
    return _snapshot(text, "typescript")


def tsx(text: str) -> dict[str, list[Row]]:
    """All facts of a TSX file; declarations of generators are not among its functions."""
    return _snapshot(text, "tsx")
