"""Lookups: functions, classes, fields, imports, annotations, references, definitions and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import matches
from ..plans.facts import Facts

PLACE = ("path", "start_line", "end_line")


def file_count(facts: Facts) -> DataFrame:
    files = facts.files
    return (files if facts.language is None else files.filter(F.col("language") == facts.language)).agg(F.count("*").alias("n"))


def file_count_by_language(facts: Facts) -> DataFrame:
    return facts.files.groupBy("language").agg(F.count("*").alias("n"))


def language_set(facts: Facts) -> DataFrame:
    """All languages as one comma list in order."""
    return facts.files.agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))


def params_of(facts: Facts) -> DataFrame:
    """(function_id, params): each function's parameters in order of position."""
    listed = F.array_sort(F.collect_list(F.struct("position", "name", F.col("param_type").alias("type"))))
    return facts.function_params.groupBy("function_id").agg(F.transform(listed, lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type"))).alias("params"))


def functions(facts: Facts, pattern: str = "", with_params: bool = True) -> DataFrame:
    found = facts.located(facts.functions.filter(matches("name", pattern)))
    if with_params:
        found = found.join(params_of(facts), found["id"] == F.col("function_id"), "left").withColumn("params", F.coalesce("params", F.expr("CAST(array() AS array<struct<name:string,type:string>>)")))
    return found.select("id", "file_id", "name", "class_name", *PLACE, *(["params"] if with_params else [])).orderBy("path", "start_line")


def definition(facts: Facts, name: str, class_name: str | None = None) -> DataFrame:
    same = F.col("name") == name
    return functions_where(facts, same if class_name is None else same & (F.col("class_name") == class_name))


def functions_where(facts: Facts, condition: F.Column) -> DataFrame:
    return facts.located(facts.functions.filter(condition)).select("id", "file_id", "name", "class_name", *PLACE).orderBy("path", "start_line")


def methods_of(facts: Facts) -> DataFrame:
    """(class_id, methods): names in order, with repeats."""
    return facts.class_methods.groupBy("class_id").agg(F.array_sort(F.collect_list("method_name")).alias("methods"))


def supers_of(facts: Facts) -> DataFrame:
    return facts.class_super_classes.groupBy("class_id").agg(F.array_sort(F.collect_list("super_class_name")).alias("super_classes"))


def _listed_fields(fields: DataFrame) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("start_line", "name")))
    return fields.groupBy("file_id", "class_name").agg(F.transform(listed, lambda x: x["name"]).alias("fields"))


def fields_by_class(facts: Facts) -> DataFrame:
    """(file_id, class_name, fields): names in order of their lines."""
    return _listed_fields(facts.fields)


def classes(facts: Facts, pattern: str = "") -> DataFrame:
    return class_rows(facts, facts.classes.filter(matches("name", pattern)))


def class_rows(facts: Facts, found: DataFrame) -> DataFrame:
    """Class facts with their methods, fields and super classes; lists are gathered for the found classes only."""
    found = facts.located(found)
    empty = F.expr("CAST(array() AS array<string>)")
    ids = found.select(F.col("id").alias("class_id"))
    methods = facts.class_methods.join(ids, "class_id", "left_semi").groupBy(F.col("class_id").alias("_m")).agg(F.array_sort(F.collect_list("method_name")).alias("methods"))
    supers = facts.class_super_classes.join(ids, "class_id", "left_semi").groupBy(F.col("class_id").alias("_s")).agg(F.array_sort(F.collect_list("super_class_name")).alias("super_classes"))
    own = facts.fields.join(found.select("file_id", F.col("name").alias("class_name")), ["file_id", "class_name"], "left_semi")
    fields = _listed_fields(own).select(F.col("file_id").alias("_f"), F.col("class_name").alias("_c"), "fields")
    joined = found.join(methods, found["id"] == F.col("_m"), "left").join(supers, found["id"] == F.col("_s"), "left")
    joined = joined.join(fields, (found["file_id"] == F.col("_f")) & (found["name"] == F.col("_c")), "left")
    listed = [F.coalesce(c, empty).alias(c) for c in ("methods", "fields", "super_classes")]
    return joined.select("id", "file_id", "name", "kind", *PLACE, *listed).orderBy("path", "start_line")


def fields(facts: Facts, class_name: str) -> DataFrame:
    return facts.located(facts.fields.filter(F.col("class_name") == class_name)).select("name", "class_name", "field_type", *PLACE).orderBy("path", "start_line")


def imports(facts: Facts, pattern: str = "") -> DataFrame:
    return facts.located(facts.imports.filter(matches("module", pattern))).select("module", *PLACE).orderBy("path", "start_line")


def annotations(facts: Facts, pattern: str = "") -> DataFrame:
    found = facts.annotations.filter(matches("name", pattern))
    extra = [c for c in ("target_name", "target_type", "target_signature") if c in found.columns]
    return facts.located(found).select("name", "signature", *extra, *PLACE).orderBy("path", "start_line")


def refs(facts: Facts, name: str) -> DataFrame:
    found = facts.located(facts.refs.filter(F.col("name") == name))
    place = [c for c in (*PLACE, "node_type", "start_column", "end_column") if c in found.columns]
    return found.select("name", *place).orderBy(*[c for c in ("path", "start_line", "end_line", "node_type") if c in place])


def stale_files(facts: Facts, current: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Files of the store (in the given languages) whose path is not among ``current``."""
    files = facts.files if languages is None else facts.files.filter(F.col("language").isin(languages))
    return files.join(current.select("path").distinct(), "path", "left_anti")
