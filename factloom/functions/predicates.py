"""Column predicates: regular expressions with a literal prefilter, call targets, receiver types."""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser as P

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_LITERAL, MOST_LITERALS = 3, 8
SELVES = ("self", "this", "cls")


def mandatory_literals(pattern: str) -> list[str]:
    """Literals (3 characters at least, 8 at most) that every match of the pattern contains; longest first."""
    try:
        tree = P.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return []
    found = {x for x in _runs(tree) if len(x) >= LEAST_LITERAL}
    kept: list[str] = []
    for x in sorted(found, key=lambda v: (-len(v), v)):
        if not any(x in k for k in kept):
            kept.append(x)
    return kept[:MOST_LITERALS]


def _substrings(x: str) -> set[str]:
    return {x[i:j] for i in range(len(x)) for j in range(i + LEAST_LITERAL, len(x) + 1)}


def _runs(tree: object) -> set[str]:
    """Literal runs of a parsed pattern that no match can do without."""
    out: set[str] = set()
    run = ""
    for op, arg in tree:  # type: ignore[attr-defined]
        if op is C.LITERAL:
            run += chr(arg)
            continue
        if op is C.SUBPATTERN and not (arg[1] or arg[2]):
            inner = list(arg[3])
            if all(o is C.LITERAL for o, _ in inner):
                run += "".join(chr(a) for _, a in inner)
                continue
        out.add(run)
        run = ""
        if op is C.SUBPATTERN and not (arg[1] or arg[2]):
            out |= _runs(arg[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
            out |= _runs(arg[2])
        elif op is C.BRANCH:
            common: set[str] | None = None
            for branch in arg[1]:
                parts = set().union(*(_substrings(x) for x in _runs(branch)))
                common = parts if common is None else common & parts
            out |= common or set()
    out.add(run)
    return out


def matches(column: Column | str, pattern: str) -> Column:
    """Unanchored, case-sensitive match with Unicode classes. An empty pattern matches all.

    Literals that the pattern cannot do without are tested first; look-around and back references are refused.
    """
    column = F.col(column) if isinstance(column, str) else column
    if not pattern:
        return F.lit(True)
    if re.search(r"\(\?(?:[=!]|<[=!])|(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise ValueError("look-around and back references are not supported")
    test = F.rlike(column, F.lit(f"(?U){pattern}"))
    if not pattern.startswith("(?"):
        for literal in reversed(mandatory_literals(pattern)):
            test = F.contains(column, F.lit(literal)) & test
    return test


def split_target(name: str) -> tuple[str, str | None]:
    """``a.b.c`` as (callee ``c``, object ``a.b``)."""
    head, dot, last = name.rpartition(".")
    return (last, head) if dot and head and last else (name, None)


def attribute(target: Column) -> Column:
    """The instance attribute that an object expression begins with: ``self.a.b`` and ``a.b`` give ``a``."""
    found = F.regexp_extract(target, r"^(?:(?:self|this|cls)\.(?=.))?([^.]*)", 1)
    return F.when(found != "", found)


def foreign_object(target: Column) -> Column:
    """There is an object and it is not the instance itself (``super()`` counts)."""
    return target.isNotNull() & ~target.isin(*SELVES)


def type_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[^A-Za-z0-9_]+"), lambda t: t != "")


def last_segment(target: Column) -> Column:
    """The last dotted part of what stands before the first parenthesis."""
    return F.substring_index(F.substring_index(target, "(", 1), ".", -1)
