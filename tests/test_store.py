"""A small source tree through scan, extraction, store and commands."""

import os

from factloom import cli
from factloom.plans import store as store_module
from factloom.plans.store import FactStore
from factloom.sources.languages.python import snapshot
from factloom.sources.scan import walk

BASE = '''import os.path
from .util import helper


class Base:
    limit: int = 3

    def __init__(self, name: str):
        self.name = name

    @property
    def label(self):
        return self.name

    def run(self):
        helper()
        return self.label


class Child(Base):
    def run(self, *args, **kw):
        super().run()
        return self.step(1)

    def step(self, n: int = 2):
        return os.path.join(self.label, str(n))


def main():
    Child("x").run()
'''


def test_python_snapshot():
    s = snapshot(BASE)
    assert [(f["name"], f["class_name"], f["start_line"]) for f in s["functions"]] == [("__init__", "Base", 8), ("label", "Base", 12), ("run", "Base", 15), ("run", "Child", 21), ("step", "Child", 25), ("main", None, 29)]
    assert s["functions"][3]["params"] == [{"name": "self", "param_type": None, "position": 0}, {"name": "args", "param_type": None, "position": 1}, {"name": "kw", "param_type": None, "position": 2}]
    assert s["classes"][1]["super_classes"] == ["Base"] and s["classes"][0]["methods"] == ["__init__", "label", "run"]
    assert [(f["name"], f["field_type"]) for f in s["fields"]] == [("limit", "int"), ("name", None)]
    assert ("run", "super()", "run", "Child") in [(c["callee"], c["object_name"], c["caller"], c["caller_class_name"]) for c in s["calls"]]
    assert not any(c["callee"] == "super" for c in s["calls"])
    assert [i["module"] for i in s["imports"]] == ["os.path", ".util"]
    assert s["python_properties"] == [{"property_name": "label", "class_name": "Base"}]
    assert [(r["caller"], r["caller_class_name"]) for r in s["python_property_callers"]] == [("run", "Base"), ("step", "Child")]
    broken = snapshot("def broken(:\n  pass\n\ndef whole(a):\n    return work(a)\n\nclass C:\n    x = (1\n    def m(self):\n        pass\n")
    assert [f["name"] for f in broken["functions"]][:1] == ["whole"] and [c["callee"] for c in broken["calls"]] == ["work"] and broken["refs"]
    for cut in range(0, len(BASE), 5):
        snapshot(BASE[:cut])
        snapshot(BASE[cut:])


def test_classes_of_one_name_share_the_fields_of_the_smallest():
    s = snapshot("if a:\n    class A:\n        x = 1\n        y = 2\nelse:\n    class A:\n        z = 3\n")
    assert [(f["class_name"], f["name"]) for f in s["fields"]] == [("A", "z"), ("A", "z")]


def test_walk_honours_ignore_files_and_inodes(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_text("x")
    os.link(tmp_path / "a.py", tmp_path / "b.py")
    (tmp_path / "sub/gen.py").write_text("")
    (tmp_path / "sub/keep.py").write_text("")
    (tmp_path / "sub/.gitignore").write_text("*.py\n!keep.py\n")
    (tmp_path / "c.go").write_text("")
    assert [os.path.relpath(p, tmp_path) for p, *_ in walk(str(tmp_path))] == ["a.py", "c.go", "sub/keep.py"]
    assert [k for _, k, *_ in walk(str(tmp_path), "go")] == ["go"]


def test_ignore_rules_know_folders(tmp_path):
    for name in ("src/a.py", "src/b/c.py", "a/x/b/y.py", "a/b/z.py", "logs/q.py", "keep/[x].py", "docs/d.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("src/*.py\na/**/b\nlogs/\n/docs/**\n")
    assert [os.path.relpath(p, tmp_path) for p, *_ in walk(str(tmp_path))] == ["keep/[x].py", "src/b/c.py"]


def test_commands_and_incremental_sync(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "MOST_PARTS", 3)
    tree, store = tmp_path / "tree", str(tmp_path / "store")
    tree.mkdir()
    (tree / "base.py").write_text(BASE)
    (tree / "util.py").write_text("def helper():\n    pass\n")
    ask = lambda *argv: cli.run(spark, ["--store", store, *argv])["results"]
    report = ask("index", str(tree))[0]
    assert (report["candidates"], report["indexed"], report["reparsed"], report["failed"]) == (2, 2, 2, 0)
    assert [f["name"] for f in ask("functions", str(tree), "-q", "^ru")] == ["run", "run"]
    assert [c["name"] for c in ask("super-classes", str(tree), "-c", "Child")] == ["Base"]
    assert [c["name"] for c in ask("sub-classes", str(tree), "-c", "Base")] == ["Child"]
    assert [c["caller"] for c in ask("callers", str(tree), "-f", "helper")] == ["run"]
    assert "Base.run" in [c["callee"] for c in ask("callees", str(tree), "-f", "run", "-c", "Child")]
    paths = [p["stacktrace"] for p in ask("graph", str(tree), "-f", "run", "-c", "Child", "-d", "2", "--forward")]
    assert ["helper(base.py:16)", "Base.run(base.py:22)", "Child.run(base.py:21)"] in paths
    assert ask("definition", str(tree), "-f", "helper")[0]["source"] == "def helper():\n    pass"
    (tree / "util.py").write_text("def helper2():\n    pass\n\n")
    (tree / "new.py").write_text("def fresh():\n    pass\n")
    (tree / "base.py").unlink()
    report = ask("index", str(tree))[0]
    assert (report["indexed"], report["reparsed"]) == (2, 2)
    assert sorted(r["name"] for r in FactStore(spark, store).facts().functions.collect()) == ["fresh", "helper2"]
    for k in range(3):  # parts pile up, then are written as one
        (tree / f"more{k}.py").write_text(f"class C{k}:\n    def m{k}(self, a: int):\n        pass\n")
        assert ask("index", str(tree))[0]["reparsed"] == 1
    kept = FactStore(spark, store)
    assert len(kept.meta()["parts"]) <= 3
    facts = kept.facts()
    assert sorted(r["name"] for r in facts.functions.collect()) == sorted(["fresh", "helper2", *(f"m{k}" for k in range(3))])
    assert facts.function_params.count() == 6 and facts.class_methods.count() == 3
    (tree / "more1.py").unlink()
    assert ask("index", str(tree))[0]["reparsed"] == 0 and kept.facts().function_params.count() == 4
    (tree / "new.go").write_text("package x\nfunc late() {}\n")
    assert [f["name"] for f in ask("functions", str(tree), "-l", "go")] == ["late"]  # a language that the index lacks is read first


def test_property_reads_are_edges(spark, tmp_path):
    tree, store = tmp_path / "tree", str(tmp_path / "store")
    tree.mkdir()
    (tree / "base.py").write_text(BASE)
    ask = lambda *argv: cli.run(spark, ["--store", store, *argv])["results"]
    forward = [p["stacktrace"] for p in ask("graph", str(tree), "-f", "run", "-c", "Base", "-d", "1", "--forward")]
    assert ["Base.label(base.py:17)", "Base.run(base.py:15)"] in forward
    backward = [p["stacktrace"] for p in ask("graph", str(tree), "-f", "label", "-c", "Base", "-d", "1", "--backward")]
    assert sorted(backward) == [["Base.label(base.py:12)", "Base.run(base.py:17)"], ["Base.label(base.py:12)", "Child.step(base.py:26)"]]


def test_every_language_is_indexed(spark, tmp_path):
    tree, store = tmp_path / "tree", str(tmp_path / "store")
    tree.mkdir()
    (tree / "a.py").write_text("def work():\n    pass\n")
    (tree / "b.js").write_text("class Up { work() {} }\nclass Down extends Up { work() { super.work(); } }\n")
    (tree / "c.ts").write_text("export class Repo { constructor(private api: Api) {} work() { this.api.send(); } }\nclass Api { send() {} }\n")
    (tree / "d.tsx").write_text("const View = () => <p title={name()}>Don't</p>;\n")
    (tree / "e.java").write_text("class Left { int size; @Override void work() { new Left(); } }\n")
    (tree / "f.go").write_text("package x\nfunc work() { help() }\n")
    ask = lambda *argv: cli.run(spark, ["--store", store, *argv])["results"]
    report = ask("index", str(tree))[0]
    assert (report["candidates"], report["failed"], report["errors"]) == (6, 0, [])
    assert [(f["location"]["file"], f.get("class_name")) for f in ask("functions", str(tree), "-q", "^work$")] == [("a.py", None), ("b.js", "Up"), ("b.js", "Down"), ("c.ts", "Repo"), ("e.java", "Left"), ("f.go", None)]
    assert [c["caller"] for c in ask("callers", str(tree), "-f", "send", "-c", "Api")] == ["work"]
    assert [c["caller"] for c in ask("callers", str(tree), "-f", "name")] == ["View"]
    assert [c["name"] for c in ask("super-classes", str(tree), "-c", "Down")] == ["Up"]
    assert [a["target"]["kind"] for a in ask("annotations", str(tree), "-l", "java")] == ["method"]
    assert [r["source"] for r in ask("refs", str(tree), "-n", "help")] == ["func work() { help() }"]
