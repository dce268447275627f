"""Facts of JavaScript and TypeScript files."""

from factloom.sources.languages.javascript import javascript, tsx, typescript

JS = r'''#!/usr/bin/env node
import fs, { readFile as read } from "fs";
import "side-effect";
export { x } from './x.js';
export * from "all";
const path = require('path');

// function hidden() {}
class Base extends mixin(Root) {
  #count = 0;
  static kind = new Kind();
  constructor(store, n = 3, ...rest) {
    super(store);
    this.store = store;
    this.total = n;
    this.cache = new Cache(`${make("}")} b`);
  }
  get size() { return this.#count; }
  async *walk({ a, b }, [c]) { yield helper(a / 2 / b); }
  #bump() { this.store.save(); this.#bump(); }
}

class Child extends ns.Base {
  run = (x) => this.cache.get(x);
}

function outer(a) {
  const inner = async (b) => b + 1, other = function named() { return 1; };
  const alias = helper;
  const list = [one, two];
  for (const f of list) f(a);
  alias(/[)'"/]+/.test(a));
  const base = new Base(new Store());
  base.walk();
  return inner(a)?.then(x => x.y());
}

function* gen() { yield 1; }
export default function () { lone(); }
module.exports = { plain() { return fs.read(); }, key: () => keyed(), outer };
import("lazy");
'''

TS = '''
import type { A } from "a";
import lib = require("lib");

export abstract class Repo<T extends { id: string }> extends Base<T> implements Saves, a.Loads {
  private readonly items: Map<string, T[]> = new Map<string, T[]>();
  http = inject(HttpClient);
  constructor(private readonly api: Api, protected name?: string, plain: number = 3) { super(); }
  abstract load(id: string): Promise<T>;
  find<K extends keyof T>(key: K, fn: (x: T) => boolean = (x) => true): T | undefined {
    return this.api.get<T>(key).pipe(map((x: T): boolean => x));
  }
  static of(this: void, { a, b }: Opts): { x: number } { return build(a); }
}
interface Saves { save(x: number): void; name: string; }
type Pair = { left: number } | [a: string];
export const enum Color { Red, Green }
declare function declared(x: number): void;
export const arrow = <T,>(x: T): T => x;
function* gen(): Generator<number> { yield 1; }
'''


def _functions(s):
    return [(x["name"], x["class_name"], x["start_line"], x["end_line"]) for x in s["functions"]]


def test_javascript_functions_and_classes():
    s = javascript(JS)
    assert _functions(s) == [
        ("constructor", "Base", 12, 17), ("size", "Base", 18, 18), ("walk", "Base", 19, 19), ("#bump", "Base", 20, 20), ("outer", None, 27, 36), ("inner", None, 28, 28), ("other", None, 28, 28), ("named", None, 28, 28),
        ("gen", None, 38, 38), ("plain", None, 40, 40),
    ]
    assert [[p["name"] for p in x["params"]] for x in s["functions"]][:3] == [["store", "n", "rest"], [], ["{ a, b }", "[c]"]]
    assert [(c["name"], c["kind"], c["methods"], c["super_classes"], c["start_line"], c["end_line"]) for c in s["classes"]] == [
        ("Base", "class", ["constructor", "size", "walk", "#bump"], ["mixin"], 9, 21), ("Child", "class", [], ["ns.Base", "Base"], 23, 25),
    ]
    assert {(x["class_name"], x["name"], x["field_type"]) for x in s["fields"]} == {("Base", "#count", None), ("Base", "kind", "Kind"), ("Base", "store", "Store"), ("Base", "total", None), ("Base", "cache", "Cache"), ("Child", "run", None)}


def test_javascript_calls():
    told = [(c["callee"], c["object_name"], c["caller"], c["caller_class_name"]) for c in javascript(JS)["calls"]]
    for row in [
        ("require", None, None, None), ("constructor", "super()", "constructor", "Base"), ("constructor", "Cache", "constructor", "Base"), ("make", None, "constructor", "Base"), ("helper", None, "walk", "Base"),
        ("save", "this.store", "#bump", "Base"), ("#bump", "this", "#bump", "Base"), ("get", "this.cache", "run", "Child"), ("one", None, "outer", None), ("two", None, "outer", None), ("helper", None, "outer", None),
        ("constructor", "Base", "outer", None), ("constructor", "Store", "outer", None), ("walk", "Base", "outer", None), ("inner", None, "outer", None), ("then", "inner(a)", "outer", None),
        ("lone", None, "<default_export>", None), ("read", "fs", "plain", None), ("keyed", None, "key", None), ("y", "x", "outer", None),
    ]:
        assert row in told, row
    assert not {"alias", "f", "hidden", "plain", "size", "if", "for"} & {c[0] for c in told}


def test_javascript_imports_refs():
    s = javascript(JS)
    assert [i["module"] for i in s["imports"]] == ["fs", "side-effect", "./x.js", "all", "path", "lazy"]
    kinds = {(r["name"], r["node_type"]) for r in s["refs"]}
    assert {("#count", "private_property_identifier"), ("store", "property_identifier"), ("helper", "identifier")} <= kinds


def test_typescript():
    s = typescript(TS)
    assert [(x["name"], x["class_name"]) for x in s["functions"]] == [("constructor", "Repo"), ("find", "Repo"), ("of", "Repo"), ("arrow", None), ("gen", None)]
    params = {x["name"]: [(p["name"], p["param_type"]) for p in x["params"]] for x in s["functions"]}
    assert params["constructor"] == [("api", "Api"), ("name", "string"), ("plain", "number")]
    assert params["find"] == [("key", "K"), ("fn", "(x: T) => boolean")]
    assert params["of"] == [("this", "void"), ("{ a, b }", "Opts")]
    assert params["arrow"] == [("x", "T")]
    assert [(c["name"], c["kind"], c["methods"], c["super_classes"]) for c in s["classes"]] == [
        ("Repo", "abstract_class", ["constructor", "load", "find", "of"], ["Base", "Saves", "a.Loads", "Loads"]), ("Saves", "interface", ["save"], []), ("Pair", "alias", [], []), ("Color", "enum", [], []),
    ]
    assert [(x["name"], x["field_type"]) for x in s["fields"]] == [("items", "Map<string, T[]>"), ("http", "HttpClient"), ("api", "Api"), ("name", "string")]
    told = {(c["callee"], c["object_name"], c["caller"]) for c in s["calls"]}
    assert {("constructor", "super()", "constructor"), ("get", "this.api", "find"), ("map", None, "find"), ("build", None, "of"), ("constructor", "Map", None)} <= told
    assert [i["module"] for i in s["imports"]] == ["a", "lib"]
    assert [x["name"] for x in tsx(TS)["functions"]][-1] == "arrow"


def test_broken_and_empty():
    assert javascript("")["functions"] == []
    for engine, code in ((javascript, JS), (typescript, TS)):
        for cut in range(0, len(code), 11):
            engine(code[:cut])
            engine(code[cut:])


def test_receiver_through_a_long_chain_of_aliases():
    from factloom.sources.languages import javascript as module

    names = module._Bindings.__new__(module._Bindings)
    names.objects = {f"a{k}": [(k, f"a{k - 1}")] for k in range(1, 30)} | {"a0": [(0, "Store")], "node": [(1, "node.next")], "x": [(1, "y")], "y": [(1, "x")]}
    kind = lambda target: names.receiver(None, 99, target, None, {"Store"})
    assert kind("a29") == "Store"
    assert kind("node") is None and kind("x") is None
