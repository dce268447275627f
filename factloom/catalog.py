"""All queries of the code-facts engine over the fact views, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import predicates as P
from .operators import edges, graph, hierarchy, lookup, resolve
from .plans.facts import Facts
from .sources import extraction, fixtures

FLAGSHIP = "functions_regex"
NAME_PATTERN, FUNCTION, CLASS = "^small_.*(ring|bolt)$", "blue_rod", "Brand_2"

_WORK: dict[str, Callable[[Facts], DataFrame]] = {}
_INSTEAD: dict[str, dict[str, str]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, **instead: str) -> Callable[[Callable[[Facts], DataFrame]], Callable[[Facts], DataFrame]]:
    def add(f: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
        _WORK[f.__name__], _INSTEAD[f.__name__] = f, instead
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _strings(column: str) -> F.Column:
    return F.array_join(column, ",")


_LOCATED = "FROM cf_functions x JOIN cf_files f ON f.id = x.file_id"
_LISTED = "coalesce(string_agg({0}, ',' ORDER BY {1}), '')"


@_query("SELECT count(*) AS n FROM cf_files")
def file_count(f: Facts) -> DataFrame:
    return lookup.file_count(f)


@_query("SELECT language, count(*) AS n FROM cf_files GROUP BY language")
def file_count_by_lang(f: Facts) -> DataFrame:
    return lookup.file_count_by_language(f)


@_query("SELECT string_agg(language, ',' ORDER BY language) AS languages FROM (SELECT DISTINCT language FROM cf_files)")
def language_set(f: Facts) -> DataFrame:
    return lookup.language_set(f)


@_query(f"SELECT x.name, x.class_name, f.path, x.start_line, x.end_line {_LOCATED}")
def functions_all(f: Facts) -> DataFrame:
    return lookup.functions(f, with_params=False).drop("id", "file_id")


@_query(f"SELECT x.name, x.class_name, f.path, x.start_line, x.end_line {_LOCATED} WHERE regexp_matches(x.name, '{NAME_PATTERN}')")
def functions_regex(f: Facts) -> DataFrame:
    return lookup.functions(f, NAME_PATTERN, with_params=False).drop("id", "file_id")


@_query(f"SELECT x.name, x.class_name, f.path, x.start_line, x.end_line {_LOCATED} WHERE regexp_matches(x.name, '(small|red)_(ring|bolt)$') AND f.language = 'en'")
def functions_prefiltered(f: Facts) -> DataFrame:
    return lookup.functions(f.of_language("en"), "(small|red)_(ring|bolt)$", with_params=False).drop("id", "file_id")


@_query(f"SELECT x.name, x.class_name, f.path, x.start_line, x.end_line {_LOCATED} WHERE x.name = '{FUNCTION}' AND x.class_name = '{CLASS}'")
def definition(f: Facts) -> DataFrame:
    return lookup.definition(f, FUNCTION, CLASS).drop("id", "file_id")


@_query(f"SELECT x.id, f.path, f.language {_LOCATED}")
def functions_with_path(f: Facts) -> DataFrame:
    return f.located(f.functions).select("id", "path", "language")


@_query("SELECT function_id, string_agg(concat(name, ':', coalesce(param_type, '')), ',' ORDER BY position, name) AS params FROM cf_function_params GROUP BY function_id")
def function_params_list(f: Facts) -> DataFrame:
    told = F.transform("params", lambda p: F.concat(p["name"], F.lit(":"), F.coalesce(p["type"], F.lit(""))))
    return lookup.params_of(f).select("function_id", F.array_join(told, ",").alias("params"))


@_query(f"SELECT class_id, {_LISTED.format('method_name', 'method_name')} AS methods FROM cf_class_methods GROUP BY class_id")
def class_methods_list(f: Facts) -> DataFrame:
    return lookup.methods_of(f).select("class_id", _strings("methods").alias("methods"))


@_query(f"SELECT class_id, {_LISTED.format('super_class_name', 'super_class_name')} AS super_classes FROM cf_class_super_classes GROUP BY class_id")
def class_supers_list(f: Facts) -> DataFrame:
    return lookup.supers_of(f).select("class_id", _strings("super_classes").alias("super_classes"))


@_query(f"SELECT file_id, class_name, {_LISTED.format('name', 'start_line, name')} AS fields FROM cf_fields GROUP BY file_id, class_name")
def class_fields_rollup(f: Facts) -> DataFrame:
    return lookup.fields_by_class(f).select("file_id", "class_name", _strings("fields").alias("fields"))


@_query("""
SELECT c.name, c.kind, f.path, c.start_line, c.end_line, coalesce(m.l, '') AS methods, coalesce(s.l, '') AS super_classes
FROM cf_classes c JOIN cf_files f ON f.id = c.file_id
LEFT JOIN (SELECT class_id, string_agg(method_name, ',' ORDER BY method_name) AS l FROM cf_class_methods GROUP BY class_id) m ON m.class_id = c.id
LEFT JOIN (SELECT class_id, string_agg(super_class_name, ',' ORDER BY super_class_name) AS l FROM cf_class_super_classes GROUP BY class_id) s ON s.class_id = c.id
WHERE regexp_matches(c.name, 'r#0+[0-9]*7$')""")
def classes_regex(f: Facts) -> DataFrame:
    return lookup.classes(f, "r#0+[0-9]*7$").select("name", "kind", "path", "start_line", "end_line", _strings("methods").alias("methods"), _strings("super_classes").alias("super_classes"))


@_query(f"SELECT x.name, x.class_name, x.field_type, f.path, x.start_line, x.end_line FROM cf_fields x JOIN cf_files f ON f.id = x.file_id WHERE x.class_name = '{CLASS}'")
def fields_of_class(f: Facts) -> DataFrame:
    return lookup.fields(f, CLASS)


@_query("SELECT x.module, f.path, x.start_line, x.end_line FROM cf_imports x JOIN cf_files f ON f.id = x.file_id WHERE regexp_matches(x.module, '^/[A-Z]')")
def imports_regex(f: Facts) -> DataFrame:
    return lookup.imports(f, "^/[A-Z]")


@_query("SELECT x.name, x.signature, x.target_name, x.target_type, f.path, x.start_line, x.end_line FROM cf_annotations x JOIN cf_files f ON f.id = x.file_id WHERE regexp_matches(x.name, 'click|view') AND f.language = 'en'")
def annotations_regex(f: Facts) -> DataFrame:
    return lookup.annotations(f.of_language("en"), "click|view")


@_query("SELECT x.name, f.path FROM cf_refs x JOIN cf_files f ON f.id = x.file_id WHERE x.name = 'the'")
def refs_by_name(f: Facts) -> DataFrame:
    return lookup.refs(f, "the")


@_query("SELECT id, path, language, size_bytes FROM cf_files WHERE language IN ('en', 'de') AND size_bytes < 2000")
def stale_files(f: Facts) -> DataFrame:
    return lookup.stale_files(f, f.files.filter("size_bytes >= 2000"), ["en", "de"]).select("id", "path", "language", "size_bytes")


_DISTINCT_CALLS = "dc AS MATERIALIZED (SELECT DISTINCT file_id, callee, caller, caller_class_name, object_name, object_kind, start_line, end_line FROM cf_calls)"
_INNERMOST = """inner_calls AS MATERIALIZED (SELECT * FROM (SELECT c.*, x.id AS fn_id, x.class_name AS fn_class, x.start_line AS fn_start, x.end_line AS fn_end,
  row_number() OVER (PARTITION BY c.file_id, c.callee, c.caller, c.caller_class_name, c.object_name, c.start_line ORDER BY x.start_line DESC, x.end_line, x.id) AS r
  FROM dc c JOIN cf_functions x ON x.file_id = c.file_id AND x.name = c.caller AND c.start_line BETWEEN x.start_line AND x.end_line AND (c.caller_class_name IS NULL OR c.caller_class_name = x.class_name)) q WHERE r = 1)"""


@_query(f"WITH {_DISTINCT_CALLS}, {_INNERMOST} SELECT file_id, callee, caller, start_line, count(*) AS n, min(fn_id) AS fn_id FROM inner_calls GROUP BY file_id, callee, caller, start_line")
def enclosing_function(f: Facts) -> DataFrame:
    found = resolve.enclosing(resolve.distinct_calls(f), f)
    return found.groupBy("file_id", "callee", "caller", "start_line").agg(F.count("*").alias("n"), F.min("fn_id").alias("fn_id"))


def _closure_sql(seed: str, up: bool) -> str:
    step = "SELECT s.class_id AS src, p.id AS dst FROM cf_class_super_classes s JOIN cf_classes p ON p.name = s.super_class_name"
    a, b = ("src", "dst") if up else ("dst", "src")
    return f"""WITH RECURSIVE steps AS ({step}), seeds AS (SELECT id FROM cf_classes WHERE name = '{seed}'),
walk AS (SELECT id FROM seeds UNION SELECT steps.{b} FROM walk JOIN steps ON steps.{a} = walk.id)
SELECT c.name, c.kind, f.path, c.start_line, c.end_line FROM cf_classes c JOIN cf_files f ON f.id = c.file_id WHERE c.id IN (SELECT id FROM walk) AND c.id NOT IN (SELECT id FROM seeds)"""


@_query(_closure_sql("Customer#000000001", True))
def super_classes(f: Facts) -> DataFrame:
    return hierarchy.super_classes(f, "Customer#000000001").select("name", "kind", "path", "start_line", "end_line")


@_query(_closure_sql("NATION_3", False))
def sub_classes(f: Facts) -> DataFrame:
    return hierarchy.sub_classes(f, "NATION_3").select("name", "kind", "path", "start_line", "end_line")


@_query("""WITH RECURSIVE ds AS (SELECT DISTINCT c.file_id, c.name AS class_name, s.super_class_name FROM cf_class_super_classes s JOIN cf_classes c ON c.id = s.class_id),
walk AS (SELECT file_id, class_name, super_class_name AS ancestor FROM ds UNION SELECT w.file_id, w.class_name, d.super_class_name FROM walk w JOIN ds d ON d.file_id = w.file_id AND d.class_name = w.ancestor)
SELECT file_id, class_name, ancestor FROM walk WHERE class_name <> ancestor""")
def file_ancestors(f: Facts) -> DataFrame:
    return hierarchy.file_ancestors(f)


@_query(f"""WITH {_DISTINCT_CALLS}, own AS MATERIALIZED (SELECT DISTINCT file_id, md5(name) AS caller FROM cf_functions),
g AS MATERIALIZED (SELECT file_id, callee, md5(caller) AS caller, count(*) AS n FROM dc GROUP BY file_id, callee, md5(caller))
SELECT callee, CAST(sum(n) AS BIGINT) AS n FROM g SEMI JOIN own USING (file_id, caller) WHERE caller = md5('{FUNCTION}') GROUP BY callee""")
def callees_exists(f: Facts) -> DataFrame:
    own = f.functions.select("file_id", F.col("name").alias("caller"))
    return resolve.distinct_calls(f).filter(F.col("caller") == FUNCTION).join(own, ["file_id", "caller"], "left_semi").groupBy("callee").agg(F.count("*").alias("n"))


@_query("SELECT name, CASE WHEN count(DISTINCT class_name) = 1 THEN min(class_name) END AS only_class FROM cf_sized_functions WHERE class_name IS NOT NULL GROUP BY name", functions="sized_functions")
def unique_method_target(f: Facts) -> DataFrame:
    return resolve.method_owners(f)


@_query("SELECT x.id, x.name FROM cf_functions x WHERE EXISTS (SELECT 1 FROM cf_python_properties p JOIN cf_files f ON f.id = p.file_id WHERE f.language = 'en' AND p.property_name = x.name AND p.class_name = x.class_name)")
def is_property(f: Facts) -> DataFrame:
    en = f.of_language("en")
    properties = en.scoped(en.python_properties).select(F.col("property_name").alias("name"), "class_name")
    return f.functions.join(properties, ["name", "class_name"], "left_semi").select("id", "name")


@_query(f"WITH {_DISTINCT_CALLS}, g AS (SELECT name, count(*) AS m FROM cf_functions GROUP BY name) SELECT dc.callee, CAST(sum(coalesce(g.m, 0)) AS BIGINT) AS n_candidates FROM dc LEFT JOIN g ON g.name = dc.callee GROUP BY dc.callee")
def call_candidates(f: Facts) -> DataFrame:
    g = f.functions.groupBy(F.col("name").alias("callee")).agg(F.count("*").alias("m"))  # counted before the join: a name has many functions and many calls
    return resolve.distinct_calls(f).join(g, "callee", "left").groupBy("callee").agg(F.sum(F.coalesce("m", F.lit(0))).alias("n_candidates"))


@_query(f"""WITH {_DISTINCT_CALLS}, {_INNERMOST},
ft AS MATERIALIZED (SELECT DISTINCT file_id, class_name, unnest(list_filter(regexp_split_to_array(field_type, '[^A-Za-z0-9_]+'), lambda t: t <> '')) AS token FROM cf_fields WHERE field_type IS NOT NULL AND name = 'attr2')
SELECT i.fn_id, i.callee, i.start_line, count(*) AS n_tokens FROM inner_calls i JOIN ft ON ft.file_id = i.file_id AND ft.class_name = i.fn_class WHERE i.object_kind = 3 GROUP BY i.fn_id, i.callee, i.start_line""")
def typed_receiver(f: Facts) -> DataFrame:
    inside = resolve.enclosing(resolve.distinct_calls(f).filter("object_name = 'self.attr2'"), f)
    typed = resolve.with_receiver(inside, f).filter("field_tokens IS NOT NULL")
    return typed.groupBy("fn_id", "callee", "start_line").agg(F.sum(F.size("field_tokens").cast("long")).alias("n_tokens"))


@_query(f"""WITH {_DISTINCT_CALLS}
SELECT DISTINCT coalesce(dc.caller, '<module>') AS caller, f.path, dc.start_line, dc.end_line FROM dc JOIN cf_files f ON f.id = dc.file_id WHERE dc.callee = '{FUNCTION}'
UNION SELECT r.caller, f.path, r.start_line, r.end_line FROM cf_python_property_callers r JOIN cf_files f ON f.id = r.file_id WHERE r.property_name = '{FUNCTION}' AND r.property_name IN (SELECT property_name FROM cf_python_properties)""")
def callers(f: Facts) -> DataFrame:
    return edges.callers(f, FUNCTION)


#: Types by attribute, super classes and ancestors by class, properties; names are compared as hashes where this DuckDB build fails on them.
_TYPES = """ft AS MATERIALIZED (SELECT DISTINCT file_id, class_name, name AS attr, unnest(list_filter(regexp_split_to_array(field_type, '[^A-Za-z0-9_]+'), lambda t: t <> '')) AS token FROM cf_fields WHERE field_type IS NOT NULL),
pt AS MATERIALIZED (SELECT DISTINCT function_id, name AS attr, unnest(list_filter(regexp_split_to_array(param_type, '[^A-Za-z0-9_]+'), lambda t: t <> '')) AS token FROM cf_function_params WHERE param_type IS NOT NULL),
ds AS MATERIALIZED (SELECT DISTINCT c.file_id, c.name AS class_name, s.super_class_name FROM cf_class_super_classes s JOIN cf_classes c ON c.id = s.class_id),
up AS (SELECT file_id, class_name, super_class_name AS ancestor FROM ds UNION SELECT w.file_id, w.class_name, d.super_class_name FROM up w JOIN ds d ON d.file_id = w.file_id AND d.class_name = w.ancestor),
anc AS MATERIALIZED (SELECT file_id, class_name, ancestor FROM up WHERE class_name <> ancestor),
props AS MATERIALIZED (SELECT DISTINCT property_name, class_name FROM cf_python_properties),
pf AS MATERIALIZED (SELECT g.* FROM cf_functions g WHERE EXISTS (SELECT 1 FROM props p WHERE p.property_name = g.name AND (g.class_name IS NULL OR p.class_name = g.class_name))),
reads AS MATERIALIZED (SELECT DISTINCT file_id, property_name AS callee, caller, caller_class_name, object_name, object_kind, object_type, start_line, end_line, md5(caller) = md5('<module>') AS outside FROM cf_python_property_callers)"""
_ALL_CALLS = f"{_DISTINCT_CALLS}, {_INNERMOST}, {_TYPES}"


def _typed(row: str, target: str, function: str = "fn_id", own: str = "fn_class") -> str:
    """A type of the attribute that the object of ``row`` begins with names the class ``target``."""
    attr = f"CASE WHEN {row}.object_name = 'self.attr2' THEN 'attr2' ELSE {row}.object_name END"
    return f"(EXISTS (SELECT 1 FROM ft t WHERE t.file_id = {row}.file_id AND t.class_name = {row}.{own} AND t.attr = {attr} AND t.token = {target}) OR EXISTS (SELECT 1 FROM pt t WHERE t.function_id = {row}.{function} AND t.attr = {attr} AND t.token = {target}))"


def _call_goes(row: str, target: str, own: str = "fn_class") -> str:
    """A call goes to the class ``target``, by the kind of its object: none, self, a class, a field, super()."""
    return f"""CASE {row}.object_kind WHEN 0 THEN coalesce({row}.{own} = {target}, false) WHEN 1 THEN coalesce({row}.{own} = {target}, false)
  WHEN 4 THEN EXISTS (SELECT 1 FROM ds t WHERE t.file_id = {row}.file_id AND t.class_name = {row}.{own} AND t.super_class_name = {target}) ELSE {row}.object_name = {target} OR {_typed(row, target, own=own)} END"""


def _read_goes(row: str, target: str) -> str:
    return f"""CASE WHEN {row}.object_name IS NULL THEN coalesce({row}.fn_class = {target}, false) WHEN {row}.object_kind = 0 THEN coalesce({row}.fn_class = {target}, false) OR EXISTS (SELECT 1 FROM anc t WHERE t.file_id = {row}.file_id AND t.class_name = {row}.fn_class AND t.ancestor = {target})
  ELSE {row}.object_name IS DISTINCT FROM {target} AND {_typed(row, target)} END"""


def _around(rows: str, columns: str) -> str:
    """``rows`` with the innermost function around them."""
    return f"""(SELECT * EXCLUDE (rank) FROM (SELECT c.*, x.id AS fn_id, x.class_name AS fn_class, x.start_line AS fn_start, x.end_line AS fn_end, row_number() OVER (PARTITION BY {columns} ORDER BY x.start_line DESC, x.end_line, x.id) AS rank
  FROM {rows} c JOIN cf_functions x ON x.file_id = c.file_id AND x.name = c.caller AND c.start_line BETWEEN x.start_line AND x.end_line AND (c.caller_class_name IS NULL OR c.caller_class_name = x.class_name)) q WHERE rank = 1)"""


_READS_AROUND = _around("(SELECT * FROM reads WHERE NOT outside)", "c.file_id, c.callee, c.caller, c.caller_class_name, c.object_name, c.object_type, c.start_line")
_PICKED = f"md5(callee) = md5('{FUNCTION}')"


@_query(f"""WITH RECURSIVE {_ALL_CALLS},
o AS MATERIALIZED (SELECT count(DISTINCT class_name) = 1 AND min(class_name) = '{CLASS}' AS one FROM cf_functions WHERE class_name IS NOT NULL AND md5(name) = md5('{FUNCTION}')),
i AS MATERIALIZED (SELECT * REPLACE (coalesce(caller_class_name, fn_class) AS fn_class) FROM inner_calls WHERE {_PICKED}),
m AS MATERIALIZED (SELECT * FROM dc WHERE caller IS NULL AND {_PICKED}),
r AS MATERIALIZED (SELECT * FROM {_READS_AROUND} x WHERE {_PICKED} AND EXISTS (SELECT 1 FROM props WHERE md5(property_name) = md5('{FUNCTION}') AND class_name = '{CLASS}')),
s AS MATERIALIZED (SELECT * FROM reads WHERE outside AND {_PICKED} AND EXISTS (SELECT 1 FROM props WHERE md5(property_name) = md5('{FUNCTION}') AND class_name = '{CLASS}')),
found AS (SELECT caller, file_id, start_line, end_line FROM i, o WHERE {_call_goes("i", f"'{CLASS}'")} OR (one AND object_kind >= 2)
UNION SELECT '<module>', file_id, start_line, end_line FROM m, o WHERE (object_kind = 2 AND object_name = '{CLASS}') OR (one AND object_kind >= 2)
UNION SELECT caller, file_id, start_line, end_line FROM r WHERE {_read_goes("r", f"'{CLASS}'")}
UNION SELECT '<module>', file_id, start_line, end_line FROM s WHERE object_name <> '{CLASS}' AND list_contains(regexp_split_to_array(object_type, '[^A-Za-z0-9_]+'), '{CLASS}'))
SELECT DISTINCT caller, path, start_line, end_line FROM found JOIN cf_files f ON f.id = found.file_id""")
def callers_of_method(f: Facts) -> DataFrame:
    return edges.callers(f, FUNCTION, CLASS)


@_query(f"""WITH RECURSIVE {_ALL_CALLS},
own AS MATERIALIZED (SELECT DISTINCT file_id FROM cf_functions WHERE md5(name) = md5('{FUNCTION}')),
h AS MATERIALIZED (SELECT file_id, callee, caller_class_name, object_kind, CASE WHEN object_kind = 0 THEN callee ELSE object_name || '.' || callee END AS told, start_line, end_line, md5(caller) AS caller FROM dc
GROUP BY file_id, callee, caller_class_name, object_kind, CASE WHEN object_kind = 0 THEN callee ELSE object_name || '.' || callee END, start_line, end_line, md5(caller)),
c AS MATERIALIZED (SELECT * FROM h SEMI JOIN own USING (file_id) WHERE caller = md5('{FUNCTION}')),
g AS MATERIALIZED (SELECT c.file_id, c.start_line, c.end_line, c.callee, c.caller_class_name, x.name, x.class_name FROM c LEFT JOIN cf_functions x ON x.name = c.callee
  AND EXISTS (SELECT 1 FROM ds t WHERE t.file_id = c.file_id AND t.class_name = c.caller_class_name AND t.super_class_name = x.class_name) WHERE c.object_kind = 4),
found AS (SELECT told AS callee, file_id, start_line, end_line FROM c WHERE object_kind <> 4
UNION SELECT CASE WHEN name IS NULL THEN 'super().' || callee ELSE class_name || '.' || name END, file_id, start_line, end_line FROM g
UNION SELECT coalesce(object_name || '.' || callee, callee), file_id, start_line, end_line FROM reads SEMI JOIN own USING (file_id) WHERE md5(caller) = md5('{FUNCTION}') AND caller_class_name IS NULL)
SELECT DISTINCT callee, path, start_line, end_line FROM found JOIN cf_files f ON f.id = found.file_id""")
def callees(f: Facts) -> DataFrame:
    return edges.callees(f, FUNCTION)


@_query(f"""WITH {_DISTINCT_CALLS}, m AS MATERIALIZED (SELECT *, md5(object_name) AS o FROM dc WHERE object_kind = 2 AND {_PICKED})
SELECT DISTINCT coalesce(caller, '<module>') AS caller, path, start_line, end_line FROM m JOIN cf_files f ON f.id = m.file_id WHERE o = md5('mod')""")
def callers_dotted(f: Facts) -> DataFrame:
    return edges.callers(f, f"mod.{FUNCTION}")


def _starts(f: Facts) -> DataFrame:
    return f.functions.filter(F.col("name") == FUNCTION)


def _resolved(f: Facts, calls: str) -> DataFrame:
    """The edges of all calls of a kind to functions that are known."""
    inside = resolve.enclosing(resolve.distinct_calls(f).filter(calls), f)
    met, _ = resolve.forward_groups(inside.filter(F.col("fn_class").eqNullSafe(F.col("caller_class_name"))), f)
    found = resolve.members(resolve.sites(met), f).select(F.col("fn_id").alias("src"), F.col("g_id").alias("dst"), F.col("start_line").alias("site_line"))
    repeated = f.functions.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    return found if repeated.isEmpty() else found.distinct()  # where ids are ids, the sites are distinct already


def _forward(callers: str) -> str:
    """Tables up to ``e``, the forward edges of the functions with names that ``callers`` picks."""
    return f"""{_ALL_CALLS},
c AS MATERIALIZED (SELECT DISTINCT fn_id, file_id, fn_class, callee, object_kind, object_name, start_line, end_line FROM inner_calls WHERE fn_class IS NOT DISTINCT FROM caller_class_name AND {callers}),
k AS MATERIALIZED (SELECT *, row_number() OVER () AS k FROM c),
m AS MATERIALIZED (SELECT k.*, g.id AS g_id, g.file_id AS g_file, g.name AS g_name, g.class_name AS g_class, g.start_line AS g_start, g.end_line AS g_end, g.class_name IS NULL AND g.id IS NOT NULL AS free,
  g.class_name IS NULL AND g.file_id = k.file_id AS here, {_call_goes("k", "g.class_name")} AS goes FROM k LEFT JOIN cf_functions g ON g.name = k.callee),
w AS (SELECT *, max(CASE WHEN here THEN 1 ELSE 0 END) OVER (PARTITION BY k) AS any_here, min(g_class) OVER (PARTITION BY k) AS low, max(g_class) OVER (PARTITION BY k) AS high FROM m),
p AS (SELECT *, coalesce(goes, false) OR (object_kind = 0 AND CASE WHEN any_here = 1 THEN coalesce(here, false) ELSE free END) AS pick FROM w),
q AS (SELECT *, max(CASE WHEN pick THEN 1 ELSE 0 END) OVER (PARTITION BY k) AS picked FROM p),
t AS (SELECT *, CASE WHEN picked = 1 THEN pick WHEN object_kind IN (2, 3) THEN coalesce(g_class IS NOT NULL AND low = high, false) WHEN object_kind = 0 THEN g_id IS NOT NULL ELSE false END AS take FROM q),
v AS MATERIALIZED (SELECT *, max(CASE WHEN take THEN 1 ELSE 0 END) OVER (PARTITION BY k) AS taken FROM t),
rk AS MATERIALIZED (SELECT r.*, x.id AS fn_id, x.class_name AS fn_class, row_number() OVER () AS k FROM (SELECT * FROM reads WHERE NOT outside AND {callers}) r JOIN cf_functions x ON x.file_id = r.file_id AND x.name = r.caller AND r.start_line BETWEEN x.start_line AND x.end_line AND x.class_name IS NOT DISTINCT FROM r.caller_class_name),
rm AS MATERIALIZED (SELECT rk.*, g.id AS g_id, g.file_id AS g_file, g.name AS g_name, g.class_name AS g_class, g.start_line AS g_start, g.end_line AS g_end, coalesce({_read_goes("rk", "coalesce(g.class_name, '')")}, false) AS take FROM rk LEFT JOIN pf g ON g.name = rk.callee),
rv AS MATERIALIZED (SELECT *, max(CASE WHEN take AND g_id IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY k) AS taken FROM rm),
e AS MATERIALIZED ({" UNION ".join(f"SELECT fn_id AS src, g_id AS dst, g_file AS dst_file, g_name AS dst_name, g_class AS dst_class, g_start AS dst_start, g_end AS dst_end, file_id AS site_file, start_line AS site_line FROM {x} WHERE take AND g_id IS NOT NULL UNION SELECT fn_id, -1, file_id, CASE WHEN object_name IS NULL THEN callee ELSE object_name || '.' || callee END, NULL, start_line, end_line, file_id, start_line FROM {x} WHERE taken = 0" for x in ("v", "rv"))})"""


def _backward(picked: str) -> str:
    """Tables up to ``e``, the backward edges of the functions with names that ``picked`` picks (by callee)."""
    seen = ("file_id, start_line", "fn_id AS dst, file_id AS dst_file, caller AS dst_name, fn_class AS dst_class, fn_start AS dst_start, fn_end AS dst_end", "-1 AS dst, file_id AS dst_file, '<module>' AS dst_name, NULL AS dst_class, start_line AS dst_start, end_line AS dst_end")
    return f"""{_ALL_CALLS},
n AS MATERIALIZED (SELECT id AS src, name AS callee, class_name AS n_class FROM cf_functions),
o AS MATERIALIZED (SELECT name, CASE WHEN count(DISTINCT class_name) = 1 THEN min(class_name) END AS only_class FROM cf_functions WHERE class_name IS NOT NULL GROUP BY name),
a AS MATERIALIZED (SELECT n.*, coalesce(o.only_class = n_class, false) AS one FROM n LEFT JOIN o ON o.name = n.callee WHERE {picked}),
ap AS MATERIALIZED (SELECT a.* FROM a WHERE src IN (SELECT id FROM pf)),
i AS MATERIALIZED (SELECT inner_calls.*, a.src, a.n_class, a.one FROM inner_calls JOIN a ON a.callee = inner_calls.callee),
u AS MATERIALIZED (SELECT dc.*, a.src, a.n_class, a.one FROM dc JOIN a ON a.callee = dc.callee WHERE dc.caller IS NULL),
r AS MATERIALIZED (SELECT x.*, ap.src, ap.n_class FROM {_READS_AROUND} x JOIN ap ON ap.callee = x.callee),
s AS MATERIALIZED (SELECT x.*, ap.src, ap.n_class FROM reads x JOIN ap ON ap.callee = x.callee WHERE x.outside),
e AS MATERIALIZED (SELECT src, {seen[1]}, file_id AS site_file, start_line AS site_line FROM i WHERE n_class IS NULL OR {_call_goes("i", "i.n_class")} OR (one AND object_kind >= 2)
UNION SELECT src, {seen[1]}, file_id, start_line FROM r WHERE {_read_goes("r", "coalesce(r.n_class, '')")}
UNION SELECT src, {seen[2]}, file_id, start_line FROM u WHERE n_class IS NULL OR (object_kind IN (0, 1) AND coalesce(caller_class_name = n_class, false)) OR (object_kind = 2 AND object_name = n_class) OR (one AND object_kind >= 2)
UNION SELECT src, {seen[2]}, file_id, start_line FROM s WHERE n_class IS NULL OR (object_name IS DISTINCT FROM n_class AND coalesce(list_contains(regexp_split_to_array(object_type, '[^A-Za-z0-9_]+'), n_class), false)))"""


_EDGE = "src, CAST(dst AS BIGINT) AS dst, dst_file, dst_name, dst_class, dst_start, dst_end, site_file, site_line"
_CALLER = f"md5(caller) = md5('{FUNCTION}')"


def _paths(tables: str, forward: bool) -> str:
    """Maximal simple paths of up to three edges, as frames."""
    frame = "coalesce({0} || '.', '') || {1} || '(' || string_split(f.path, '/')[-1] || ':' || {2} || ')'"
    where = lambda p: " || chr(31) || ".join(f"coalesce(CAST({p}{c} AS VARCHAR), chr(0))" for c in ("file", "start", "end", "name", "class"))
    spot = "'' || file_id || chr(31) || start_line || chr(31) || end_line || chr(31) || name || chr(31) || coalesce(class_name, chr(0))"
    step = lambda d: f"w{d} AS MATERIALIZED (SELECT list_append(w.keys, x.dst) AS keys, list_append(w.frames, x.frame) AS frames, x.dst AS last FROM w{d - 1} w JOIN x ON x.src = w.last WHERE NOT list_contains(w.keys, x.dst))"
    done = lambda d: f"SELECT keys, frames FROM w{d} w WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.src = w.last AND NOT list_contains(w.keys, x.dst))"
    return f"""WITH RECURSIVE {tables},
ks AS MATERIALIZED (SELECT id, {spot} AS key FROM cf_functions),
x AS MATERIALIZED (SELECT DISTINCT ks.key AS src, CASE WHEN e.dst = -1 THEN '-1' || chr(31) ELSE '' END || {where("e.dst_")} AS dst, {frame.format("e.dst_class", "e.dst_name", "e.site_line")} AS frame FROM e JOIN ks ON ks.id = e.src JOIN cf_files f ON f.id = e.site_file),
w0 AS MATERIALIZED (SELECT [ks.key] AS keys, [{frame.format("s.class_name", "s.name", "s.start_line")}] AS frames, ks.key AS last FROM cf_functions s JOIN ks ON ks.id = s.id JOIN cf_files f ON f.id = s.file_id WHERE md5(s.name) = md5('{FUNCTION}') AND md5(s.class_name) = md5('{CLASS}')),
{", ".join(step(d) for d in (1, 2, 3))},
z AS MATERIALIZED ({" UNION ".join(done(d) for d in (0, 1, 2))} UNION SELECT keys, frames FROM w3)
SELECT CAST(len(frames) - 1 AS INTEGER) AS depth, array_to_string({"list_reverse(frames)" if forward else "frames"}, ',') AS stacktrace FROM z"""


@_query(f"WITH RECURSIVE {_forward(_CALLER)} SELECT {_EDGE} FROM e")
def forward_edges(f: Facts) -> DataFrame:
    return edges.forward_edges(f, _starts(f))


@_query(f"""WITH {_DISTINCT_CALLS}, {_INNERMOST}
SELECT i.fn_id AS src, g.id AS dst, i.start_line AS site_line FROM inner_calls i JOIN cf_functions g ON g.name = i.callee AND g.class_name = i.fn_class
WHERE i.object_kind = 1 AND i.fn_class IS NOT DISTINCT FROM i.caller_class_name GROUP BY i.fn_id, g.id, i.start_line""")
def forward_self_calls(f: Facts) -> DataFrame:
    return _resolved(f, "object_name = 'self'")


@_query(f"WITH RECURSIVE {_forward('object_kind = 0')} SELECT DISTINCT fn_id AS src, g_id AS dst, start_line AS site_line FROM v WHERE take AND g_id IS NOT NULL")
def forward_plain_calls(f: Facts) -> DataFrame:
    return _resolved(f, "object_name IS NULL")


@_query(f"WITH RECURSIVE {_forward('object_kind = 4')} SELECT DISTINCT fn_id AS src, g_id AS dst, start_line AS site_line FROM v WHERE take AND g_id IS NOT NULL")
def super_call_targets(f: Facts) -> DataFrame:
    return _resolved(f, "object_name = 'super()'")


@_query(f"WITH RECURSIVE {_forward('true')} SELECT {_EDGE} FROM e")
def forward_edges_all(f: Facts) -> DataFrame:
    return edges.forward_edges(f, f.functions)


@_query(f"WITH RECURSIVE {_backward(_PICKED)} SELECT {_EDGE} FROM e")
def backward_edges(f: Facts) -> DataFrame:
    return edges.backward_edges(f, _starts(f))


@_query(_paths(_forward("true"), True))
def graph_forward(f: Facts) -> DataFrame:
    return graph.find_paths(f, FUNCTION, CLASS, ordered=False).select("depth", _strings("stacktrace").alias("stacktrace"))


@_query(_paths(_backward("true"), False))
def graph_backward(f: Facts) -> DataFrame:
    return graph.find_paths(f, FUNCTION, CLASS, forward=False, ordered=False).select("depth", _strings("stacktrace").alias("stacktrace"))


def _bound(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _WORK[name](fixtures.facts(spark, sf_dir, _INSTEAD[name]))


QUERIES = {name: _bound(name) for name in _WORK} | extraction.QUERIES
ORACLE_SQL = {name: fixtures.duckdb(sql) for name, sql in _SQL.items()} | extraction.ORACLE_SQL
