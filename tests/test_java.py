"""Facts of a Java file."""

import random
import re

from factloom.sources.languages.java import snapshot

CODE = '''package shop.core;

import java.util.List;
import static java.lang.Math.*;

@Entity
@Table(name = "carts")
public final class Cart<T extends Item> extends Base<T> implements Priced, a.b.Scoped {
    private static final List<String> NAMES = List.of("a(", "b"), OTHER = null;
    @Inject Map<String, List<T>> held;
    int[] sizes;

    public Cart(@Named("x") int n, final String s, T... more) {
        super(n);
        this.sizes = new int[n];
    }

    // int hidden() {}
    @Override
    public <R> R total(Function<T, R> f) throws IOException {
        @Checked Item item = new Item(NAMES.get(0));
        if (a < b && check(c > d)) { run(); }
        Runnable r = new Runnable() {
            public void run() { item.touch().twice(); }
        };
        return super.total(f);
    }

    enum Size { SMALL(1), LARGE(2) { int cost() { return helper(); } }; final int n; Size(int n) { this.n = n; } }

    interface Priced extends Comparable<Priced> { int MAX = 3; int price(); }

    record Pair(int left, String right) implements Priced { Pair { check(left); } public int price() { return left; } }

    @interface Mark { String[] value() default {}; }
}
'''


def test_java_declarations():
    s = snapshot(CODE)
    assert [(c["name"], c["kind"], c["methods"], c["super_classes"], c["start_line"], c["end_line"]) for c in s["classes"]] == [
        ("Cart", "class", ["Cart", "total"], ["Base", "Priced"], 6, 36),
        ("Size", "enum", ["Size"], [], 29, 29),
        ("Priced", "interface", ["price"], [], 31, 31),
        ("Pair", "record", ["price"], ["Priced"], 33, 33),
        ("Mark", "annotation", ["value"], [], 35, 35),
    ]
    assert [(x["name"], x["class_name"], x["start_line"], x["end_line"]) for x in s["functions"]] == [
        ("Cart", "Cart", 13, 16), ("total", "Cart", 19, 27), ("run", "Cart", 24, 24), ("cost", "Size", 29, 29), ("Size", "Size", 29, 29), ("price", "Priced", 31, 31), ("price", "Pair", 33, 33), ("value", "Mark", 35, 35),
    ]
    assert [(p["name"], p["param_type"]) for p in s["functions"][0]["params"]] == [("n", "int"), ("s", "String")]
    assert [(p["name"], p["param_type"]) for p in s["functions"][1]["params"]] == [("f", "Function<T, R>")]
    assert [(x["class_name"], x["name"], x["field_type"]) for x in s["fields"]] == [("Cart", "NAMES", "List<String>"), ("Cart", "OTHER", "List<String>"), ("Cart", "held", "Map<String, List<T>>"), ("Cart", "sizes", "int[]"), ("Size", "n", "int")]


def test_java_calls():
    told = [(c["callee"], c["object_name"], c["caller"], c["caller_class_name"]) for c in snapshot(CODE)["calls"]]
    assert told == [
        ("of", "List", None, "Cart"), ("super", None, "Cart", "Cart"), ("Item", None, "total", "Cart"), ("get", "NAMES", "total", "Cart"), ("check", None, "total", "Cart"), ("run", None, "total", "Cart"),
        ("Runnable", None, "total", "Cart"), ("twice", "item.touch()", "run", "Cart"), ("touch", "item", "run", "Cart"), ("total", "super()", "total", "Cart"), ("helper", None, "cost", "Size"), ("check", None, None, "Pair"),
    ]


def test_java_imports_annotations_refs():
    s = snapshot(CODE)
    assert [(i["module"], i["start_line"]) for i in s["imports"]] == [("java.util.List", 3), ("java.lang.Math", 4)]
    assert [(a["name"], a["target_name"], a["target_type"], a["target_signature"]) for a in s["annotations"]] == [
        ("Entity", "Cart", "class", "@Entity\npublic final class Cart<T extends Item> extends Base<T> implements Priced, a.b.Scoped"),
        ("Table", "Cart", "class", '@Table(name = "carts")\npublic final class Cart<T extends Item> extends Base<T> implements Priced, a.b.Scoped'),
        ("Inject", "held", "field", "@Inject Map<String, List<T>> held;"),
        ("Named", "n", "parameter", 'public Cart(@Named("x") int n, final String s, T... more)'),
        ("Override", "total", "method", "@Override\npublic <R> R total(Function<T, R> f) throws IOException"),
        ("Checked", "item", "variable", "@Checked Item item = new Item(NAMES.get(0));"),
    ]
    kinds = {(r["name"], r["node_type"]) for r in s["refs"]}
    assert {("java.util.List", "scoped_identifier"), ("Item", "type_identifier"), ("IOException", "type_identifier"), ("NAMES", "identifier"), ("Cart", "identifier")} <= kinds
    assert "hidden" not in {r["name"] for r in s["refs"]}


def test_java_broken_and_empty():
    assert snapshot("")["classes"] == []
    for cut in range(0, len(CODE), 7):
        snapshot(CODE[:cut])
        snapshot(CODE[cut:])


def test_java_mutated_files_end():
    pick, words = random.Random(3), re.findall(r"\w+|\s+|.", CODE)
    for _ in range(150):
        x = words[:]
        for _ in range(pick.randint(1, 12)):
            at = pick.randrange(len(x))
            if pick.random() < 0.5:
                del x[at]
            else:
                x.insert(at, pick.choice(words))
        snapshot("".join(x))
