import random
import re

import pytest
from factloom.functions.predicates import mandatory_literals, matches, split_target
from factloom.operators.graph import maximal_paths
from pyspark.sql import functions as F


def test_literals_are_in_every_match():
    words = ["get_value", "set_value", "getter", "value", "xget_valuex", ""]
    for pattern in ("get_val", "(get|set)_value", "^get.*lue$", "(abc)?value", "val(ue)+", "a|value", "[gs]et_value"):
        for w in words:
            if re.search(pattern, w):
                assert all(x in w for x in mandatory_literals(pattern)), (pattern, w)
    assert mandatory_literals("(get|set)_value") == ["_value"]
    assert mandatory_literals("(abc)?x") == []


def test_split_target():
    assert split_target("a.b.c") == ("c", "a.b")
    assert split_target("run") == ("run", None)


def test_matches_refuses_look_around(spark):
    with pytest.raises(ValueError, match="look-around"):
        matches("name", "(?=x)y")
    got = spark.createDataFrame([("été",), ("x",)], "name string").filter(matches("name", r"^\w+é$")).count()
    assert got == 1


def test_paths_equal_depth_first_search(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}", f"f{k}") for k in range(16)]
    want = set()

    def walk(keys, frames, left):
        further = [(b, f) for a, b, f in edges if a == keys[-1] and b not in keys]
        if not left or not further:
            want.add((tuple(keys), tuple(frames)))
            return
        for b, f in further:
            walk([*keys, b], [*frames, f], left - 1)

    walk(["n0"], ["start"], 3)
    frame = spark.createDataFrame(edges, "src string, dst string, dst_frame string")
    got = maximal_paths(spark.createDataFrame([("n0", "start")], "key string, frame string"), lambda _: frame, 3)
    assert {(tuple(r["keys"]), tuple(r["frames"])) for r in got.collect()} == want
    assert F is not None
