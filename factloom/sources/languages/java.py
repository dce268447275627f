"""Facts of a Java file, from a lexer, bracket matching and a reader of class bodies.

Declarations begin with their annotations and modifiers. Methods and calls in anonymous classes belong
to the named class around them. Names of references have the kinds ``type_identifier`` (in declared
types, after ``new``, ``extends``, ``implements`` and ``throws``, in type arguments),
``scoped_identifier`` (the dotted names of ``package`` and ``import``) and ``identifier``. Parameters
of variable arity are left out, as are constants of interfaces.
"""

from __future__ import annotations

import re

from .tokens import CLOSE, OPEN, File, Row, innermost, lex

_TOKEN = re.compile(
    r"(?P<skip>//[^\n]*|/\*.*?\*/|\s+)|(?P<text>\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>\.\.\.|->|::|.)", re.DOTALL
)
#: The keywords of the language, and those that can stand before a declaration.
KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
)
MODIFIERS = frozenset("abstract default final native private protected public static strictfp synchronized transient volatile sealed non".split())
PRIMITIVES = frozenset("boolean byte char double float int long short void".split())
_KINDS = {"class": "class", "interface": "interface", "enum": "enum", "record": "record", "@interface": "annotation"}


class _File(File):
    def __init__(self, text: str) -> None:
        super().__init__(text, lex(text, _TOKEN, KEYWORDS))
        self.functions: list[tuple[int, int, Row]] = []
        self.classes: list[tuple[int, int, Row]] = []
        self.fields: list[Row] = []
        self.annotations: list[tuple[int, Row]] = []
        self.types: set[int] = set()  # tokens that stand in a type
        self.heads: set[int] = set()  # names before a bracket that are declared there, not called

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
            elif t in (";", "{", "}", "(", ")", "=") or self.kind(j) in ("text", "number"):
                return k  # a comparison
            j += 1
        return k

    def typed(self, a: int, b: int) -> None:
        self.types.update(j for j in range(a, b) if self.kind(j) == "name")

    def type_end(self, k: int) -> int:
        """The token after the type that begins at ``k``; ``k`` itself if none does."""
        begin = k
        while True:
            while self.at(k) == "@" and self.kind(k + 1) == "name":
                k = self.annotation(k)
            if self.kind(k) != "name" and self.at(k) not in PRIMITIVES:
                return begin
            k = self.angle(k + 1)
            if self.at(k) != ".":
                break
            k += 1
        while self.at(k) == "[" and self.pair.get(k) == k + 1:
            k += 2
        return k

    def annotation(self, k: int) -> int:
        """The token after the annotation whose ``@`` is ``k``."""
        k += 2
        while self.at(k) == "." and self.kind(k + 1) == "name":
            k += 2
        return self.pair[k] + 1 if self.at(k) == "(" and k in self.pair else k

    def modifiers(self, k: int) -> tuple[int, list[tuple[int, int]], int]:
        """After annotations and modifiers: the next token, the annotations, the first token that is none."""
        notes, head = [], -1
        while True:
            if self.at(k) == "@" and self.kind(k + 1) == "name":
                end = self.annotation(k)
                notes.append((k, end))
                k = end
                continue
            if self.at(k) not in MODIFIERS or self.at(k) == "default" and self.at(k + 1) in (":", "->") or self.at(k) in ("sealed", "non") and self.kind(k + 1) == "mark" and self.at(k + 1) != "-":
                return k, notes, k if head < 0 else head
            head = k if head < 0 else head
            k += 3 if self.at(k) == "non" else 1

    def note(self, notes: list[tuple[int, int]], name: str, kind: str, told: str, joined: bool = True) -> None:
        for a, b in notes:
            dotted = a + 2
            while self.at(dotted) == "." and self.kind(dotted + 1) == "name":
                dotted += 2
            text = self.source(a, b)
            row = {"name": self.source(a + 1, dotted), "signature": text, **self.span(a, b - 1), "target_name": name, "target_type": kind, "target_signature": f"{text}\n{told}" if joined else told}
            self.annotations.append((a, row))

    # ---- declarations -------------------------------------------------------------------------

    def kind_at(self, k: int) -> str | None:
        """The kind of type that is declared at ``k``."""
        if self.at(k) == "@" and self.at(k + 1) == "interface":
            return "@interface"
        if self.at(k) in ("class", "interface", "enum") and self.at(k - 1) != "." and self.kind(k + 1) == "name":
            return self.at(k)
        if self.at(k) == "record" and self.kind(k + 1) == "name" and self.at(self.angle(k + 2)) == "(":
            return "record"
        return None

    def type(self, first: int, k: int, notes: list[tuple[int, int]], head: int) -> int:
        """Read the type declared at ``k``; the token after it."""
        kind = self.kind_at(k)
        name = k + (2 if kind == "@interface" else 1)
        self.heads.add(name)
        brace, supers, collecting = self.angle(name + 1), [], False
        if self.at(brace) == "(":
            self.params(brace, "")
            brace = self.pair.get(brace, brace) + 1
        while brace < len(self.tokens) and self.at(brace) not in ("{", ";", "}"):
            word = self.at(brace)
            if word in ("extends", "implements", "permits"):
                collecting = word == "implements" or word == "extends" and kind != "interface"
                brace += 1
                continue
            end = self.type_end(brace)
            if end > brace:
                self.typed(brace, end)
                if collecting and self.at(brace + 1) != ".":
                    supers.append(self.at(brace))
            brace = max(end, brace + 1)
        if self.at(brace) != "{" or brace not in self.pair:
            return brace + 1
        last, owner = self.pair[brace], self.at(name)
        self.note(notes, owner, "annotation_type" if kind == "@interface" else kind, self.source(head, brace).split("\n")[0].rstrip())
        place = len(self.classes)
        self.classes.append((first, last, {"name": owner, "kind": _KINDS[kind], **self.span(first, last), "methods": [], "super_classes": list(dict.fromkeys(supers))}))
        self.classes[place][2]["methods"] = self.body(brace, owner, kind)
        return last + 1

    def body(self, brace: int, owner: str, kind: str) -> list[str]:
        """Read the members between the braces; the names of the methods."""
        last, k, methods = self.pair[brace], brace + 1, []
        if kind == "enum":
            k = self.constants(k, last, owner)
        first = -1
        while k < last:
            first = k = max(k, first + 1)
            k, notes, head = self.modifiers(k)
            if k >= last:
                break
            if self.kind_at(k):
                k = self.type(first, k, notes, head)
                continue
            if self.at(k) == "{" and k in self.pair:
                self.code(k + 1, self.pair[k], owner)
                k = self.pair[k] + 1
                continue
            start = self.angle(k)
            if self.kind(start) == "name" and self.at(start + 1) in ("(", "{"):
                name = start  # a constructor (of a record maybe without parameters)
            else:
                name = self.type_end(start)
                self.typed(start, name)
            if self.kind(name) != "name" or name == start and self.at(name + 1) not in ("(", "{"):
                k = max(first, k) + 1
                continue
            if self.at(name + 1) == "(" and name + 1 in self.pair:
                k = self.method(first, head, name, start == name, owner, notes)
                methods.append(self.at(name))
            elif self.at(name + 1) == "{":
                k = self.pair.get(name + 1, name + 1)
                self.code(name + 2, k, owner)
                k += 1
            else:
                k = self.field(first, start, name, last, owner, kind, notes)
        return methods

    def constants(self, k: int, last: int, owner: str) -> int:
        while k < last and self.at(k) != ";":
            if self.kind(k) == "name" and self.at(k - 1) != "@":
                self.heads.add(k)
            elif self.at(k) == "(":
                self.code(k + 1, self.pair.get(k, k), owner)
            elif self.at(k) == "{" and k in self.pair:
                self.body(k, owner, "class")
            k = self.pair.get(k, k) + 1 if self.at(k) in OPEN else k + 1
        return k + 1

    def method(self, first: int, head: int, name: int, constructor: bool, owner: str, notes: list[tuple[int, int]]) -> int:
        self.heads.add(name)
        at = self.pair[name + 1]
        while at + 1 < len(self.tokens) and self.at(at) not in ("{", ";", "}"):
            at += 1
            if self.at(at) not in ("{", ";"):
                self.typed(at, at + 1)
            elif self.at(at - 1) == "default":  # an array as the default of an annotation's element
                at = self.pair.get(at, at) + 1
        end = self.pair.get(at, at) if self.at(at) == "{" else at
        told = self.source(head, at).rstrip()
        row = {"name": self.at(name), "class_name": owner, **self.span(first, end), "params": self.params(name + 1, told)}
        self.functions.append((first, end, row))
        self.note(notes, self.at(name), "constructor" if constructor else "method", told)
        if self.at(at) == "{":
            self.code(at + 1, end, owner)
        return end + 1

    def params(self, bracket: int, told: str) -> list[Row]:
        out: list[Row] = []
        k, last = bracket + 1, self.pair.get(bracket, bracket)
        while k < last:
            k, notes, _ = self.modifiers(k)
            end = self.type_end(k)
            self.typed(k, end)
            if self.at(end) == "...":
                self.note(notes, "", "parameter", told, joined=False)
            elif end > k and (self.kind(end) == "name" or self.at(end) == "this"):
                self.note(notes, self.at(end), "parameter", told, joined=False)
                out.append({"name": self.at(end), "param_type": self.source(k, end), "position": len(out)})
            k = max(k, end)
            while k < last and self.at(k) != ",":
                k = self.pair.get(k, k) + 1 if self.at(k) in OPEN else k + 1
            k += 1
        return out

    def field(self, first: int, start: int, name: int, last: int, owner: str, kind: str, notes: list[tuple[int, int]]) -> int:
        names, k, begins = [], name, True
        while k < last and self.at(k) != ";":
            if begins and self.kind(k) == "name":
                names.append(k)
                begins = False
            elif self.at(k) == ",":
                begins = True
            k = max(self.angle(k), self.pair.get(k, k) + 1 if self.at(k) in OPEN else k + 1)
        self.code(name, k, owner)
        self.note(notes, self.at(name), "field", self.source(first, min(k + 1, last)), joined=False)
        if kind not in ("interface", "@interface"):
            self.fields += [{"class_name": owner, "name": self.at(n), "field_type": self.source(start, name), **self.span(first, min(k, last - 1))} for n in names]
        return k + 1

    def code(self, a: int, b: int, owner: str) -> None:
        """Read local and anonymous classes and local variables between two tokens."""
        k = a
        while k < b:
            begins = self.at(k - 1) in ("{", "}", ";", "(", ")", "->", ":")
            if begins and (self.at(k) == "@" or self.at(k) in MODIFIERS or self.kind(k) == "name" or self.at(k) in PRIMITIVES or self.kind_at(k)):
                at, notes, head = self.modifiers(k)
                if self.kind_at(at):
                    k = self.type(k, at, notes, head)
                    continue
                end = self.type_end(at)
                if end > at and self.kind(end) == "name" and self.at(end + 1) in ("=", ";", ":", ",", ")"):
                    self.typed(at, end)
                    stop = end
                    while stop < b and self.at(stop) not in (";", ")"):
                        stop = self.pair.get(stop, stop) + 1 if self.at(stop) in OPEN else stop + 1
                    self.note(notes, self.at(end), "variable", self.source(k, min(stop + 1, b)), joined=False)
                    k = end
                else:
                    k = max(at, k + 1) if at < b else b
                    continue
            if self.at(k) == "new":
                end = self.type_end(k + 1)
                self.typed(k + 1, end)
                close = self.pair.get(end) if self.at(end) == "(" else None
                if close is not None and self.at(close + 1) == "{" and close + 1 in self.pair:
                    self.code(end + 1, close, owner)
                    self.body(close + 1, owner, "class")
                    k = self.pair[close + 1]
            k += 1


def _operand(f: _File, dot: int) -> int:
    """The first token of the expression before the dot."""
    k = dot - 1
    while True:
        while f.at(k) in CLOSE and k in f.pair:
            k = f.pair[k] - 1
            if f.kind(k) != "name" and f.at(k) not in CLOSE and f.at(k) not in ("this", "super"):
                return k + 1
        if f.at(k) == ">":  # type arguments of a created object or a call
            while k >= 0 and f.at(k) not in ("<", ";", "{", "}"):
                k -= 1
            k -= 1
        if f.kind(k) not in ("name", "text", "number") and f.at(k) not in ("this", "super", "class"):
            return k + 1
        if f.at(k - 1) == "new":
            return k - 1
        if f.at(k - 1) != ".":
            return k
        k -= 2


def _calls(f: _File) -> list[Row]:
    out: list[tuple[int, int, Row]] = []
    functions, classes = (innermost(len(f.tokens), [x[:2] for x in of]) for of in (f.functions, f.classes))

    def add(first: int, end: int, callee: str, target: str | None) -> None:
        fn = f.functions[functions[first]] if functions[first] >= 0 else None
        cls = f.classes[classes[first]] if classes[first] >= 0 else None
        row = {"callee": callee, "caller": fn[2]["name"] if fn else None, "caller_class_name": cls[2]["name"] if cls else None, "object_name": target, **f.span(first, end)}
        out.append((f.tokens[first].start, -f.tokens[end].end, row))

    noted = {j for k in range(len(f.tokens)) if f.at(k) == "@" and f.kind(k + 1) == "name" for j in range(k, f.annotation(k)) if f.at(j + 1) == "("}
    for k in range(len(f.tokens)):
        word = f.at(k)
        if word == "new":
            end = f.type_end(k + 1)
            if f.at(end) == "(" and end in f.pair and end > k + 1:
                generic = next((j for j in range(k + 1, end) if f.at(j) == "<"), end)
                close = f.pair[end]
                last = f.pair.get(close + 1, close) if f.at(close + 1) == "{" else close
                add(k, last, f.source(k + 1, generic), None)
        elif word in ("this", "super") and f.at(k + 1) == "(" and k + 1 in f.pair:
            close = f.pair[k + 1]
            add(k, close + 1 if f.at(close + 1) == ";" else close, word, None)
        elif f.kind(k) == "name" and f.at(k + 1) == "(" and k + 1 in f.pair and k not in f.heads and k not in noted:
            before = k - 1
            if f.at(before) == ">":  # type arguments of the call
                while before >= 0 and f.at(before) != "<":
                    before -= 1
                before -= 1
            if f.at(before) == "new" or k in f.types and f.at(before) != ".":
                continue
            if f.at(before) == "." and k in f.types:
                continue  # new a.B(
            first = _operand(f, before) if f.at(before) == "." else k
            target = f.source(first, before) if first < k else None
            add(first, f.pair[k + 1], word, "super()" if target == "super" else target)
    return [r for *_, r in sorted(out, key=lambda x: x[:2])]


def _dotted(f: _File, k: int) -> int:
    while f.at(k + 1) == "." and f.kind(k + 2) == "name":
        k += 2
    return k


def _imports_and_refs(f: _File) -> tuple[list[Row], list[Row]]:
    imports, refs, k = [], [], 0
    while k < len(f.tokens):
        if f.at(k) in ("import", "package"):
            at = k + 1 + (f.at(k + 1) == "static")
            end = _dotted(f, at)
            if f.kind(at) == "name":
                stop = end
                while stop + 1 < len(f.tokens) and f.at(stop) != ";":
                    stop += 1
                if f.at(k) == "import":
                    imports.append({"module": f.source(at, end + 1), **f.span(k, stop)})
                refs.append(f.place(at, "scoped_identifier" if end > at else "identifier", end))
                refs += [f.place(j, "identifier") for j in range(at, end + 1, 2)] if end > at else []
                k = end
        elif f.kind(k) == "name" and not (f.at(k) == "record" and f.kind_at(k)):
            refs.append(f.place(k, "type_identifier" if k in f.types else "identifier"))
        k += 1
    return imports, refs


def snapshot(text: str) -> dict[str, list[Row]]:
    """All facts of a file. Functions carry their params, classes their methods and super classes."""
    f = _File(text)
    k = 0
    while k < len(f.tokens):
        at, notes, head = f.modifiers(k)
        k = f.type(k, at, notes, head) if f.kind_at(at) else max(at, k + 1)
    by_place = lambda r: (r["start_line"], r["end_line"])
    imports, refs = _imports_and_refs(f)
    return {
        "functions": sorted((r for *_, r in f.functions), key=by_place), "classes": sorted((r for *_, r in f.classes), key=by_place), "fields": f.fields,
        "calls": _calls(f), "imports": imports, "annotations": [r for _, r in sorted(f.annotations, key=lambda x: x[0])], "refs": refs,
    }
