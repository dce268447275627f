"""Facts of a Go file."""

from factloom.sources.languages.go import snapshot

CODE = '''package shop

import (
	"fmt"
	str "strings"
)

import "os"

// func commented() {}
type Base struct{ ID int }

type Cart struct {
	*Base
	io.Reader
	a, b  int `json:"a(b)"`
	Items []string
	next  func(x int) error
}

type Store interface {
	Load(id int) (Cart, error)
}

func (c *Cart) Total(rate float64, xs ...int) int {
	run := func() { helper(1) }
	run()
	return c.Base.sum(str.ToUpper("x("), "}")
}

func helper(int, string) (n int, err error) {
	fmt.Println(os.Args)
	b := []byte("x")
	return Map[int](b).size(), nil
}

func pair(a, b int, m map[string]int) struct{ x int } { return make(a) }
'''


def test_go_snapshot():
    s = snapshot(CODE)
    assert [(f["name"], f["class_name"], f["start_line"], f["end_line"]) for f in s["functions"]] == [("Total", "Cart", 25, 29), ("helper", None, 31, 35), ("pair", None, 37, 37)]
    params = [[(p["name"], p["param_type"]) for p in f["params"]] for f in s["functions"]]
    assert params == [[("rate", "float64"), ("xs", "...int")], [("", "int"), ("", "string")], [("a", "int"), ("b", "int"), ("m", "map[string]int")]]
    assert [(c["name"], c["kind"], c["methods"], c["super_classes"]) for c in s["classes"]] == [("Base", "struct", [], []), ("Cart", "struct", ["Total"], ["Base", "Reader"]), ("Store", "interface", ["Load"], [])]
    assert [(x["name"], x["field_type"]) for x in s["fields"] if x["class_name"] == "Cart"] == [("Base", "*Base"), ("Reader", "io.Reader"), ("a", "int"), ("b", "int"), ("Items", "[]string"), ("next", "func(x int) error")]
    assert [(c["callee"], c["object_name"], c["caller"], c["caller_class_name"]) for c in s["calls"]] == [
        ("helper", None, "Total", "Cart"), ("run", None, "Total", "Cart"), ("sum", "c.Base", "Total", "Cart"), ("ToUpper", "str", "Total", "Cart"),
        ("Println", "fmt", "helper", None), ("Map", None, "helper", None), ("size", "Map[int](b)", "helper", None), ("make", None, "pair", None),
    ]
    assert [(i["module"], i["start_line"]) for i in s["imports"]] == [("fmt", 4), ("strings", 5), ("os", 8)]
    assert {"name": "shop", "node_type": "package_identifier", "start_line": 1, "end_line": 1, "start_column": 8, "end_column": 12} in s["refs"]


def test_go_broken_and_empty():
    assert snapshot("")["functions"] == []
    assert snapshot("func broken( {\n\ttype X struct {\n")["classes"] == []
    assert [f["name"] for f in snapshot("func open() {\n")["functions"]] == ["open"]
