"""Command line: one JSON object with ``meta`` and ``results`` on standard output, exit code 1 on errors."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import asdict

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .operators import edges, graph, hierarchy, lookup
from .plans.store import SCHEMA_VERSION, FactStore
from .sources import scan
from .sources.languages import EXTENSIONS

STORE = "factloom.db"


def _place(r: Row, root: str) -> dict:
    path = r["path"]
    return {"file": os.path.relpath(path, root) if path.startswith(root) else path, "start_line": r["start_line"], "end_line": r["end_line"]}


def _present(**values: object) -> dict:
    return {k: v for k, v in values.items() if v is not None}


def hydrated(found: DataFrame) -> DataFrame:
    """``found`` (path, start_line, end_line) with ``source``: the lines as their files have them now, null if a file is gone."""
    text = scan.with_content(found.select("path").distinct()).select("path", F.split(F.decode("content", "UTF-8"), "\n").alias("_lines"))
    lines = F.slice("_lines", F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int"))
    return found.join(text, "path", "left").withColumn("source", F.trim(F.array_join(lines, "\n"))).drop("_lines")


_VIEWS = {
    "functions": lambda r, p: _present(name=r["name"], location=p, class_name=r["class_name"], params=[_present(name=x["name"], type=x["type"]) for x in r["params"]]),
    "classes": lambda r, p: {"name": r["name"], "kind": r["kind"], "location": p, "methods": r["methods"], "fields": r["fields"]},
    "fields": lambda r, p: _present(name=r["name"], location=p, type=r["field_type"]),
    "imports": lambda r, p: {"module": r["module"], "location": p},
    "annotations": lambda r, p: {"name": r["name"], "source": r["signature"], "location": p, "target": {"name": r["target_name"], "kind": r["target_type"], "source": r["target_signature"]}},
    "refs": lambda r, p: {"name": r["name"], "kind": r["node_type"], "location": p, "source": r["source"] or ""},
    "callers": lambda r, p: {"caller": r["caller"], "location": p},
    "callees": lambda r, p: {"callee": r["callee"], "location": p},
}
_VIEWS |= {"super-classes": _VIEWS["classes"], "sub-classes": _VIEWS["classes"]}


def _depth(text: str) -> int:
    if (n := int(text)) < 1:
        raise argparse.ArgumentTypeError("depth must be 1 or more")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factloom")
    p.add_argument("--store", default=STORE)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "functions", "classes", "fields", "imports", "annotations", "callers", "callees", "graph", "refs", "definition", "super-classes", "sub-classes"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("-l", "--language", choices=sorted(EXTENSIONS))
        if name in ("functions", "classes", "imports", "annotations"):
            c.add_argument("-q", "--query", default="")
        if name in ("callers", "callees", "graph", "definition"):
            c.add_argument("-f", "--function", required=True)
        if name in ("callers", "callees", "graph", "definition"):
            c.add_argument("-c", "--class-name")
        if name in ("fields", "super-classes", "sub-classes"):
            c.add_argument("-c", "--class-name", required=True)
        if name == "refs":
            c.add_argument("-n", "--name", required=True)
        if name == "graph":
            c.add_argument("-d", "--depth", type=_depth, default=3)
            way = c.add_mutually_exclusive_group(required=True)
            way.add_argument("--forward", action="store_true")
            way.add_argument("--backward", action="store_true")
    return p


def _ask(a: argparse.Namespace, facts: object) -> DataFrame:
    return {
        "functions": lambda: lookup.functions(facts, a.query), "classes": lambda: lookup.classes(facts, a.query), "fields": lambda: lookup.fields(facts, a.class_name),
        "imports": lambda: lookup.imports(facts, a.query), "annotations": lambda: lookup.annotations(facts, a.query), "refs": lambda: lookup.refs(facts, a.name),
        "callers": lambda: edges.callers(facts, a.function, a.class_name), "callees": lambda: edges.callees(facts, a.function, a.class_name),
        "graph": lambda: graph.find_paths(facts, a.function, a.class_name, a.depth, a.forward),
        "super-classes": lambda: hierarchy.super_classes(facts, a.class_name), "sub-classes": lambda: hierarchy.sub_classes(facts, a.class_name),
        "definition": lambda: lookup.definition(facts, a.function, a.class_name),
    }[a.command]()


def run(spark: SparkSession, argv: list[str]) -> dict:
    a = parser().parse_args(argv)
    root = os.path.realpath(a.path)
    store = FactStore(spark, a.store)
    if a.command == "index":
        if not os.path.isdir(root):
            raise NotADirectoryError(root)
        report = store.sync(root, a.language)
        return {"meta": {"root": root, "files": report.candidates, "count": 1}, "results": [asdict(report)]}
    meta = store.meta()
    wanted = {a.language} if a.language else {kind for _, kind, *_ in scan.walk(root)}
    if meta.get("root") != root or meta.get("schema_version") != SCHEMA_VERSION:
        store.sync(root, a.language)
    else:
        for language in sorted(wanted - set(meta["languages"])):
            store.sync(root, language)
    facts = store.facts().of_language(a.language)
    found = _ask(a, facts)
    if a.command in ("refs", "definition"):
        found = hydrated(found).orderBy("path", "start_line", "end_line")
    rows = found.collect()
    if a.command == "graph":
        results = [{"depth": r["depth"], "stacktrace": r["stacktrace"]} for r in rows]
    elif a.command == "definition":
        if not rows:
            raise LookupError(f"Function '{a.function}' not found")
        results = [_present(name=r["name"], location=_place(r, root), class_name=r["class_name"], source=r["source"] or None) for r in rows]
    else:
        results = [_VIEWS[a.command](r, _place(r, root)) for r in rows]
    files = len({r["path"] for r in rows}) if a.command == "definition" else lookup.file_count(facts).first()["n"]
    return {"meta": {"root": root, "files": files, "count": len(results)}, "results": results}


def main() -> int:
    spark = SparkSession.builder.appName("factloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        out = run(spark, sys.argv[1:])
    except Exception as broken:  # noqa: BLE001  the contract is an error object
        out = {"error": str(broken)}
    print(json.dumps(out, indent=2, sort_keys=True, ensure_ascii=False))
    return int("error" in out)


if __name__ == "__main__":
    sys.exit(main())
