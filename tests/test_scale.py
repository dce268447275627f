"""What is dealt out or written on the way stays as small as the input, however large a result is."""

import pytest
from factloom import catalog
from factloom.operators import edges, graph, resolve
from factloom.plans.facts import SCHEMAS, Facts
from factloom.sources import extraction, fixtures

SF = "/root/testdata/sf0.001"
CALLERS, TARGETS = 40, 60


def _alike(spark):
    """One class in a file: callers that call a method of one name, which the class has many times; and as many free functions."""
    rows = [(i, 1, f"c{i}", "K", 10 * i, 10 * i + 9) for i in range(CALLERS)]
    rows += [(1000 + i, 2, "m", "K", 1, 2) for i in range(TARGETS)] + [(2000 + i, 1 + i % 2, "m", None, 1, 2) for i in range(TARGETS)]
    calls = [(1, "m", f"c{i}", "K", obj, 10 * i + 1, 10 * i + 1) for i in range(CALLERS) for obj in ("self", None)]
    made = {"functions": rows, "calls": calls, "files": [(1, "a", "python", 0, 0, ""), (2, "b", "python", 0, 0, "")]}
    return Facts(lambda t: spark.createDataFrame(made.get(t, []), SCHEMAS[t]))


@pytest.fixture
def written(monkeypatch):
    counts = []

    def cut(df, real=resolve.cut):
        out = real(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(resolve, "cut", cut)
    monkeypatch.setattr(edges, "cut", cut)
    monkeypatch.setattr(graph, "cut", cut)
    return counts


def _dealt(df):
    """Whether rows are grouped after the first join from the top of the plan."""
    top = df._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
    return any(x in top for x in ("Aggregate", "Distinct", "Sort", "Repartition"))


def test_forward_edges_write_groups_not_edges(spark, written):
    f = _alike(spark)
    got = edges.forward_edges(f, f.functions)
    assert not _dealt(got)
    assert max(written) <= 4 * CALLERS + 2 * TARGETS
    want = {(i, 1000 + k, 10 * i + 1) for i in range(CALLERS) for k in range(TARGETS)} | {(i, 2000 + k, 10 * i + 1) for i in range(CALLERS) for k in range(0, TARGETS, 2)}
    rows = [(r["src"], r["dst"], r["site_line"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_forward_self_calls_write_groups_not_edges(spark, written):
    got = catalog._WORK["forward_self_calls"](_alike(spark))
    assert not _dealt(got)
    assert max(written) <= 4 * CALLERS + 2 * TARGETS
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted((i, 1000 + k, 10 * i + 1) for i in range(CALLERS) for k in range(TARGETS))


@pytest.mark.parametrize("language", ["go", "tsx"])
def test_extraction_reads_each_file_once_without_joins(spark, language):
    plan = extraction.QUERIES[f"extract_{language}"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_last_paths_are_not_written(spark, written):
    layers = [(f"{d}.{i}", f"{d + 1}.{j}", f"f{d + 1}.{j}") for d in range(3) for i in range(1 if d == 0 else 6) for j in range(6)]
    made = spark.createDataFrame(layers, "src string, dst string, dst_frame string")
    got = graph.maximal_paths(spark.createDataFrame([("0.0", "f0")], "key string, frame string"), lambda _: made, 3)
    assert not _dealt(got)
    assert max(written) <= 6 * 6
    rows = [tuple(r["keys"]) for r in got.collect()]
    assert sorted(rows) == sorted(("0.0", f"1.{a}", f"2.{b}", f"3.{c}") for a in range(6) for b in range(6) for c in range(6))


def test_forward_edges_write_and_deal_out_narrow_rows(spark, monkeypatch):
    kinds, real = [], resolve.cut
    for module in (resolve, edges):
        monkeypatch.setattr(module, "cut", lambda df: (kinds.append(dict(df.dtypes)), real(df))[1])
    f = _alike(spark)
    edges.forward_edges(f, f.functions)
    assert kinds and not any("array" in kind for columns in kinds for kind in columns.values())  # types and classes above are met where they are asked for
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = resolve.enclosing(resolve.distinct_calls(f), f)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3 and "hashpartitioning(call_id" not in plan  # distinct, and either side of the join


def test_lines_alike_are_one_before_they_meet_functions(spark):
    f = fixtures.facts(spark, SF)
    alike = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_partkey", "l_linenumber", "l_quantity >= 48").distinct().count()
    assert f.calls.count() == alike < spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_forward_paths_write_groups_not_paths(spark, written):
    n = 20
    rows = [(1, 1, "a", "K", 1, 9)] + [(1000 * k + i, 1, name, "K", 1000 * k + 10 * i, 1000 * k + 10 * i + 9) for k, name in enumerate("mzw", 1) for i in range(n)]
    calls = [(1, dict(a="m", m="z", z="w")[r[2]], r[2], "K", "self", r[4] + 1, r[4] + 1) for r in rows if r[2] != "w"]
    made = {"functions": rows, "calls": calls, "files": [(1, "a", "python", 0, 0, "")]}
    got = graph.find_paths(Facts(lambda t: spark.createDataFrame(made.get(t, []), SCHEMAS[t])), "a", "K", ordered=False)
    assert max(written) <= len(rows)
    assert got.filter("depth = 3").count() == got.count() == n**3
