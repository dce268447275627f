"""Extraction leaves no reference and no file out."""

import pytest
from factloom.sources import extraction, scan
from factloom.sources.languages.go import snapshot
from factloom.sources.languages.javascript import tsx

SF = "/root/testdata/sf0.001"
FILES = "path string, language string, mtime_nanos long, size_bytes long, content_hash string, content binary"


@pytest.mark.parametrize(("language", "names"), [("go", {"shop", "Base", "ID", "rate", "ToUpper", "Println"}), ("tsx", {"View", "Component", "title", "p"})])
def test_references_without_an_underscore_are_told(spark, language, names):
    rows = extraction.QUERIES[f"extract_{language}"](spark, SF).filter("kind = 'ref'").groupBy("path").agg({"name": "collect_set"}).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/part.parquet").count()
    assert all(names <= set(r[1]) for r in rows)
    assert all(f"('ref', '{name}'," in extraction.ORACLE_SQL[f"extract_{language}"] for name in names)


def test_a_file_that_cannot_be_read_has_a_row(spark):
    made = spark.createDataFrame([("a.go", "go", 0, 0, "", b"package a\n"), ("a.zig", "zig", 0, 0, "", b"")], FILES)
    assert [tuple(r) for r in extraction.told(scan.extract(made)).collect()] == [("a.go", "ref", "a", "package_identifier", None, 1, 1), ("a.zig", "error", "no engine for zig", None, None, 0, 0)]


def _kinds(rows):
    return [(r["name"], r["node_type"].removesuffix("_identifier")) for r in rows]


def test_go_kinds_in_signatures_and_imports():
    code = 'import (\n\tstr "strings"\n)\ntype S struct {\n\tnext func(x int) error\n}\ntype L interface {\n\tLoad(id p.K, n []int) (out map[K]V, err error)\n}\nfunc f(ids []int) *T {\n\treturn nil\n}\n'
    assert _kinds(snapshot(code)["refs"]) == [
        ("str", "package"), ("S", "type"), ("next", "field"), ("x", "identifier"), ("int", "type"), ("error", "type"), ("L", "type"), ("Load", "field"), ("id", "identifier"), ("p", "package"), ("K", "type"),
        ("n", "identifier"), ("int", "type"), ("out", "identifier"), ("K", "type"), ("V", "type"), ("err", "identifier"), ("error", "type"), ("f", "identifier"), ("ids", "identifier"), ("int", "type"), ("T", "type"),
    ]


def test_tsx_words_of_the_language_are_no_references():
    code = "import { View } from './v';\ntype Props = { title: string };\nconst from = (type: number) => type + from;\n"
    assert _kinds(tsx(code)["refs"]) == [("View", "identifier"), ("Props", "type"), ("title", "property"), ("from", "identifier"), ("type", "identifier"), ("type", "identifier"), ("from", "identifier")]
