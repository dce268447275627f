"""Edges of all functions against brute force over the calls of the smallest tables."""

import re

from factloom import catalog
from factloom.sources import fixtures

SF = "/root/testdata/sf0.001"


def test_all_forward_edges_equal_brute_force(spark):
    f = fixtures.facts(spark, SF)
    functions = f.functions.collect()
    by_name, tokens = {}, {}
    for g in functions:
        by_name.setdefault(g["name"], []).append(g)
    for r in f.fields.filter("field_type IS NOT NULL").collect():
        tokens.setdefault((r["file_id"], r["class_name"], r["name"]), set()).update(re.findall(r"\w+", r["field_type"]))
    supers = {}
    for r in f.classes.join(f.class_super_classes.withColumnRenamed("class_id", "id"), "id").collect():
        supers.setdefault((r["file_id"], r["name"]), set()).add(r["super_class_name"])
    want = set()
    for c in set(f.calls.select("file_id", "callee", "caller", "caller_class_name", "object_name", "start_line", "end_line").collect()):
        around = [g for g in by_name.get(c["caller"], []) if g["file_id"] == c["file_id"] and g["start_line"] <= c["start_line"] <= g["end_line"] and c["caller_class_name"] in (None, g["class_name"])]
        if not around:
            continue
        fn = min(around, key=lambda g: (-g["start_line"], g["end_line"], g["id"]))
        if fn["class_name"] != c["caller_class_name"]:
            continue
        obj, met = c["object_name"], by_name.get(c["callee"], [])
        free = [g for g in met if g["class_name"] is None]
        own = [g for g in met if g["class_name"] is not None and g["class_name"] == fn["class_name"]]
        if obj is None:
            took = own + ([g for g in free if g["file_id"] == c["file_id"]] or free) or met
        elif obj == "self":
            took = own
        elif obj == "super()":
            took = [g for g in met if g["class_name"] in supers.get((c["file_id"], fn["class_name"]), ())]
        else:
            known = {obj} | tokens.get((c["file_id"], fn["class_name"], obj.split(".")[-1]), set())
            held = [g for g in met if g["class_name"] is not None]
            took = [g for g in held if g["class_name"] in known] or (held if len({g["class_name"] for g in held}) == 1 else [])
        text = c["callee"] if obj is None else f"{obj}.{c['callee']}"
        want |= {(fn["id"], g["id"], g["name"], c["start_line"]) for g in took} or {(fn["id"], -1, text, c["start_line"])}
    typed = {}
    for r in f.function_params.filter("param_type IS NOT NULL").collect():
        typed.setdefault((r["function_id"], r["name"]), set()).update(re.findall(r"\w+", r["param_type"]))
    properties = {(r["property_name"], r["class_name"]) for r in f.python_properties.collect()}
    named = {p for p, _ in properties}

    def above(file, cls):
        seen, stack = set(), [cls]
        while stack:
            for x in supers.get((file, stack.pop()), ()):
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        return seen | {cls}

    for c in set(f.python_property_callers.filter("caller <> '<module>'").select("file_id", "property_name", "caller", "caller_class_name", "object_name", "start_line").collect()):
        for fn in by_name.get(c["caller"], []):
            if fn["file_id"] != c["file_id"] or not fn["start_line"] <= c["start_line"] <= fn["end_line"] or fn["class_name"] != c["caller_class_name"]:
                continue
            obj, met = c["object_name"], [g for g in by_name.get(c["property_name"], []) if (g["name"], g["class_name"]) in properties or g["class_name"] is None and g["name"] in named]
            if obj == "self":
                held = above(c["file_id"], fn["class_name"]) if fn["class_name"] is not None else set()
            elif obj is None:
                held = {fn["class_name"]}
            else:
                held = (tokens.get((c["file_id"], fn["class_name"], obj.split(".")[-1]), set()) | typed.get((fn["id"], obj.split(".")[-1]), set())) - {obj}
            took = [g for g in met if g["class_name"] is not None and g["class_name"] in held]
            text = c["property_name"] if obj is None else f"{obj}.{c['property_name']}"
            want |= {(fn["id"], g["id"], g["name"], c["start_line"]) for g in took} or {(fn["id"], -1, text, c["start_line"])}
    got = {(r["src"], r["dst"], r["dst_name"], r["site_line"]) for r in catalog.QUERIES["forward_edges_all"](spark, SF).collect()}
    assert got == want
    assert len({s for s, *_ in want}) > 100
