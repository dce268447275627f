"""Fact views over the driver's tables: one text for Spark and for DuckDB.

The tables hold no source code, so the relational operators are tried on views that give them the
shape of facts. ``sql(name, dialect)`` is the text of a view with all that it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.facts import Facts

VIEWS = {
    "cf_files": "SELECT doc_id AS id, concat(source,'/doc',CAST(doc_id AS VARCHAR(20)),'.',lang) AS path, lang AS language, doc_id*1000 AS mtime_nanos, n_chars AS size_bytes, {HASH}(text{HASH_ARG}) AS content_hash FROM {documents}",
    "cf_functions": "SELECT p_partkey AS id, p_partkey % 200 AS file_id, replace(p_name,' ','_') AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE replace(p_brand,'#','_') END AS class_name, CAST(floor(p_partkey/200.0)*10+1 AS BIGINT) AS start_line, CAST(floor(p_partkey/200.0)*10+10 AS BIGINT) AS end_line FROM {part}",
    "cf_sized_functions": "SELECT p_partkey AS id, p_partkey % 200 AS file_id, concat(replace(p_name,' ','_'),'_',CAST(p_size AS VARCHAR(20))) AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE replace(p_brand,'#','_') END AS class_name, CAST(1 AS BIGINT) AS start_line, CAST(2 AS BIGINT) AS end_line FROM {part}",
    "cf_function_params": "SELECT p_partkey AS function_id, concat('arg',CAST(p_size % 4 AS VARCHAR(20))) AS name, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('Optional[',replace(p_brand,'#','_'),']') END AS param_type, 0 AS position FROM {part} UNION ALL SELECT p_partkey, concat('opt',CAST(p_size % 3 AS VARCHAR(20))), CASE WHEN p_size % 2 = 0 THEN 'int' ELSE NULL END, 1 FROM {part}",
    "cf_classes": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_regionkey % 200 AS file_id, r_name AS name, 'interface' AS kind, CAST(1 AS BIGINT) AS start_line, CAST(9 AS BIGINT) AS end_line FROM {region} UNION ALL SELECT 100+n_nationkey, (100+n_nationkey) % 200, n_name, 'abstract_class', 11, 19 FROM {nation} UNION ALL SELECT 1000+s_suppkey, (1000+s_suppkey) % 200, s_name, 'class', 21, 29 FROM {supplier} UNION ALL SELECT 1000000+c_custkey, (1000000+c_custkey) % 200, c_name, 'class', 31, 39 FROM {customer} UNION ALL SELECT 2000000+min(p_partkey), p_partkey % 200, replace(p_brand,'#','_'), 'class', 41, 49 FROM {part} GROUP BY p_partkey % 200, p_brand",
    "cf_class_super_classes": "SELECT CAST(100+n_nationkey AS BIGINT) AS class_id, r_name AS super_class_name FROM {nation} JOIN {region} ON n_regionkey=r_regionkey UNION ALL SELECT 1000+s_suppkey, n_name FROM {supplier} JOIN {nation} ON s_nationkey=n_nationkey UNION ALL SELECT 1000000+c_custkey, n_name FROM {customer} JOIN {nation} ON c_nationkey=n_nationkey UNION ALL SELECT 1000+s_suppkey, concat('Mixin_',CAST(s_suppkey % 7 AS VARCHAR(20))) FROM {supplier} UNION ALL SELECT 2000000+min(p_partkey), concat('Brand_',CAST(CASE WHEN CAST(substr(p_brand,7) AS BIGINT) % 5 <> 0 THEN CAST(substr(p_brand,7) AS BIGINT) - CAST(substr(p_brand,7) AS BIGINT) % 5 WHEN CAST(substr(p_brand,7) AS BIGINT) = 5 THEN 25 ELSE 5 END AS VARCHAR(20))) FROM {part} GROUP BY p_partkey % 200, p_brand",
    "cf_class_methods": "SELECT CAST(1000000+o_custkey AS BIGINT) AS class_id, concat('m_',o_orderpriority) AS method_name FROM {orders}",
    "cf_fields": "SELECT p_partkey AS id, p_partkey % 200 AS file_id, replace(p_brand,'#','_') AS class_name, concat('attr',CAST(p_size % 6 AS VARCHAR(20))) AS name, CASE WHEN p_size % 2 = 0 THEN concat('Map<',p_type,', Brand_',CAST(p_size % 25 AS VARCHAR(20)),'>') ELSE NULL END AS field_type, CAST(p_size AS BIGINT) AS start_line, CAST(p_size AS BIGINT) AS end_line FROM {part}",
    "cf_calls": "SELECT f.file_id AS file_id, g.name AS callee, CASE WHEN l_quantity >= 48 THEN NULL ELSE f.name END AS caller, CASE WHEN l_quantity >= 48 THEN NULL ELSE f.class_name END AS caller_class_name, CASE l_linenumber % 5 WHEN 0 THEN NULL WHEN 1 THEN 'self' WHEN 2 THEN coalesce(g.class_name,'mod') WHEN 3 THEN 'self.attr2' ELSE 'super()' END AS object_name, l_linenumber % 5 AS object_kind, f.start_line + l_linenumber AS start_line, f.start_line + l_linenumber AS end_line FROM {lineitem} JOIN cf_functions f ON f.id = l_partkey JOIN cf_functions g ON g.id = (l_partkey*7+l_linenumber) % (SELECT count(*) FROM {part})",
    "cf_imports": "SELECT page_id AS file_id, module, page_id AS start_line, page_id AS end_line FROM (SELECT page_id, {EXPLODE}({ALL}(html,'href=\"([^\"]*)\"',1)) AS module FROM {pages}) t",
    "cf_refs": "SELECT doc_id AS file_id, name FROM (SELECT doc_id, {EXPLODE}({ALL}(text,'[A-Za-z_][A-Za-z0-9_]*',0)) AS name FROM {documents}) t",
    "cf_annotations": "SELECT event_id AS id, user_id % 200 AS file_id, event_type AS name, concat('@',event_type,'(',props,')') AS signature, event_id AS start_line, event_id AS end_line, concat('u',CAST(user_id AS VARCHAR(20))) AS target_name, CASE event_id % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'method' ELSE 'function' END AS target_type FROM {events}",
    "cf_python_properties": "SELECT file_id, name AS property_name, class_name FROM cf_functions WHERE id % 5 = 1",
    "cf_python_property_callers": "SELECT f.file_id, g.name AS property_name, CASE WHEN l_quantity >= 48 THEN '<module>' ELSE f.name END AS caller, CASE WHEN l_quantity >= 48 THEN NULL ELSE f.class_name END AS caller_class_name, CASE l_linenumber % 4 WHEN 0 THEN 'self' WHEN 1 THEN 'arg2' WHEN 2 THEN 'self.attr2' ELSE g.class_name END AS object_name, l_linenumber % 4 AS object_kind, CASE WHEN l_quantity >= 48 THEN g.class_name ELSE NULL END AS object_type, f.start_line + l_linenumber AS start_line, f.start_line + l_linenumber AS end_line FROM {lineitem} JOIN cf_functions f ON f.id = l_partkey JOIN cf_functions g ON g.id = (l_partkey*3+l_linenumber) % (SELECT count(*) FROM {part}) WHERE g.id % 5 = 1",
}
#: What Spark takes of a base instead of its rows, where no view has more of it and all operators make their facts distinct:
#: every row is read, those alike are one before they meet functions and not only after.
ALIKE = {"lineitem": "(SELECT DISTINCT l_partkey, l_linenumber, CASE WHEN l_quantity >= 48 THEN 48 ELSE 0 END AS l_quantity FROM {0})"}
BASES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def _needs(name: str) -> list[str]:
    return [v for v in VIEWS if v != name and f" {v} " in f"{VIEWS[name]} "]


def with_clause(text: str, fill: dict[str, str]) -> str:
    """The WITH clause of all views that ``text`` names, or nothing."""
    used = [v for v in VIEWS if v in text.replace("(", " ").replace(")", " ").replace(",", " ").split()]
    named = list(dict.fromkeys(n for v in used for n in [*_needs(v), v]))
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v].format_map(fill)})" for v in named) if named else ""


DUCKDB = {"HASH": "sha256", "HASH_ARG": "", "EXPLODE": "unnest", "ALL": "regexp_extract_all"} | {b: b for b in BASES}


def duckdb(query: str) -> str:
    """``query`` over the views, for DuckDB; further common tables of the query follow the views."""
    head = with_clause(query, DUCKDB)
    if query.lstrip().upper().startswith("WITH "):
        body = query.lstrip()[5:]
        recursive = body.upper().startswith("RECURSIVE ")
        return ("WITH RECURSIVE " + head[5:] if recursive else head) + (",\n" if head else "WITH ") + (body[10:] if recursive else body)
    return f"{head}\n{query}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    fill = {"HASH": "sha2", "HASH_ARG": ",256", "EXPLODE": "explode", "ALL": "regexp_extract_all"} | {b: ALIKE.get(b, "{0}").format(f"parquet.`{sf_dir}/{b}.parquet`") for b in BASES}
    return spark.sql(f"{with_clause(name, fill)} SELECT * FROM {name}")


def facts(spark: SparkSession, sf_dir: str, instead: dict[str, str] | None = None) -> Facts:
    """The views as fact tables; ``instead`` names other views for some of them."""
    return Facts(lambda name: view(spark, sf_dir, f"cf_{(instead or {}).get(name, name)}"))
