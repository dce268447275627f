"""Tokens of source files and the brackets among them, for engines without a parser.

Lines count from 1, columns from 0 in UTF-8 bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

Row = dict[str, object]
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass
class Token:
    kind: str
    text: str
    line: int
    start: int
    end: int


def lex(text: str, pattern: re.Pattern[str], keywords: frozenset[str]) -> list[Token]:
    """Tokens by the pattern's groups ``skip``, ``line``, ``text``, ``name``, ``number`` and ``mark``; what is skipped is left out."""
    out, line = [], 1
    for m in pattern.finditer(text):
        if m.lastgroup != "skip":
            kind = "keyword" if m.lastgroup == "name" and m[0] in keywords else m.lastgroup
            out.append(Token(kind, m[0], line, m.start(), m.end()))
        line += m[0].count("\n")
    return out


class File:
    """Tokens of a file and the pairs of brackets among them."""

    def __init__(self, text: str, tokens: list[Token]) -> None:
        self.text, self.tokens = text, tokens
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for k, t in enumerate(self.tokens):
            if t.kind == "mark" and t.text in OPEN:
                stack.append(k)
            elif t.kind == "mark" and t.text in CLOSE and stack and OPEN[self.tokens[stack[-1]].text] == t.text:
                self.pair[k] = stack[-1]
                self.pair[stack.pop()] = k

    def at(self, k: int) -> str:
        return self.tokens[k].text if 0 <= k < len(self.tokens) else ""

    def kind(self, k: int) -> str:
        return self.tokens[k].kind if 0 <= k < len(self.tokens) else ""

    def source(self, a: int, b: int) -> str:
        """The text of tokens a..b-1."""
        return self.text[self.tokens[a].start : self.tokens[b - 1].end] if a < b else ""

    def span(self, a: int, b: int) -> Row:
        last = self.tokens[b]
        return {"start_line": self.tokens[a].line, "end_line": last.line + last.text.count("\n") * (last.kind == "text")}

    def pieces(self, a: int, b: int, marks: tuple[str, ...]) -> list[tuple[int, int]]:
        """Token ranges between the marks, brackets kept whole, without empty ones."""
        out, begin, k = [], a, a
        while k < b:
            if self.at(k) in marks:
                out.append((begin, k))
                begin = k + 1
            k = self.pair.get(k, k) + 1 if self.at(k) in OPEN else k + 1
        return [self._trim(x, y) for x, y in [*out, (begin, b)] if any(self.kind(k) != "line" for k in range(x, y))]

    def _trim(self, a: int, b: int) -> tuple[int, int]:
        while self.kind(a) == "line":
            a += 1
        while self.kind(b - 1) == "line":
            b -= 1
        return a, b

    def place(self, k: int, node_type: str, last: int | None = None) -> Row:
        """A reference row for token ``k`` (to token ``last``)."""
        a, b = self.tokens[k], self.tokens[k if last is None else last]
        begin, end = (self.text.rfind("\n", 0, t.start) + 1 for t in (a, b))
        return {"name": self.text[a.start : b.end], "node_type": node_type, "start_line": a.line, "end_line": b.line, "start_column": len(self.text[begin : a.start].encode()), "end_column": len(self.text[end : b.end].encode())}


def innermost(n: int, ranges: list[tuple[int, int]]) -> list[int]:
    """For each of n tokens the place in ``ranges`` of the innermost range (first and last token) around it, or -1."""
    out = [-1] * n
    for place in sorted(range(len(ranges)), key=lambda x: (ranges[x][0], -ranges[x][1])):
        first, last = ranges[place][0], min(ranges[place][1], n - 1)
        out[first : last + 1] = [place] * (last + 1 - first)
    return out
