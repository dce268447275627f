"""The stream that keeps a store up to date."""

from factloom.plans.store import FactStore
from factloom.streaming.watch import watch


def test_watch_follows_new_files(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "sub").mkdir(parents=True)
    (tree / "a.py").write_text("def one():\n    pass\n")
    (tree / "note.txt").write_text("not a source file")
    store = FactStore(spark, str(tmp_path / "store"))
    names = lambda: sorted(r["name"] for r in store.facts().functions.collect())

    def turn():
        query = watch(store, str(tree), str(tmp_path / "checkpoint"))
        assert query.awaitTermination(120) and query.exception() is None

    turn()
    assert names() == ["one"]
    (tree / "sub/b.go").write_text("package b\nfunc two() {}\n")
    (tree / "a.py").unlink()
    turn()
    assert names() == ["two"]
    version = store.meta()["version"]
    turn()  # nothing new
    assert store.meta()["version"] == version
    (tree / "c.java").write_text("class C { void three() {} }\n")
    turn()
    assert names() == ["three", "two"]
    assert sorted(p.name for p in (tmp_path / "store").glob("v*")) == [f"v{version}", f"v{version + 1}"]
