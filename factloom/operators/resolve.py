"""Call resolution: enclosing functions, what a call's object can be, and the functions a call can mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import SELVES, attribute, foreign_object, last_segment, type_tokens
from ..plans.facts import Facts
from ..plans.lineage import cut, let_go
from .hierarchy import direct_supers, file_ancestors

CALL = ("file_id", "callee", "caller", "caller_class_name", "object_name", "start_line", "end_line")
SITE = ("call_id", "fn_id", "file_id", "start_line", "end_line")
ASKED = (*SITE, "fn_class", "callee", "object_name")


def _of_callers(rows: DataFrame, callers: DataFrame | None) -> DataFrame:
    return rows if callers is None else rows.join(callers.select("file_id", "caller").distinct(), ["file_id", "caller"], "left_semi")


def distinct_calls(facts: Facts, callers: DataFrame | None = None) -> DataFrame:
    """Calls without exact repeats, of the chosen language (and of ``callers``: file_id, caller), each with an id."""
    return _of_callers(facts.scoped(facts.calls.select(*CALL)), callers).distinct().withColumn("call_id", F.xxhash64(*CALL))


def property_reads(facts: Facts, callers: DataFrame | None = None) -> DataFrame:
    """Property reads in the shape of calls; module level has a null caller."""
    r = facts.scoped(facts.python_property_callers).withColumn("caller", F.when(F.col("caller") != "<module>", F.col("caller")))
    r = _of_callers(r, callers).select("file_id", F.col("property_name").alias("callee"), "caller", "caller_class_name", "object_name", "object_type", "start_line", "end_line").distinct()
    return r.withColumn("call_id", F.xxhash64(*CALL, "object_type"))


def enclosing(calls: DataFrame, facts: Facts, among: DataFrame | None = None) -> DataFrame:
    """``calls`` with the innermost function of the caller's name (and class, if the call names one) around their line.

    An equi-join on (file, name) with a range condition; the innermost begins last, then ends first, and is told
    where the join has put the calls. Calls without such a function drop out, and those whose innermost is not ``among`` (fn_id).
    """
    f = facts.functions
    if among is not None:  # functions are marked, so that calls need not be dealt out by function
        f = f.join(among.select(F.col("fn_id").alias("_among")).distinct(), F.col("id") == F.col("_among"), "left")
    mark = [] if among is None else [F.col("_among").isNotNull().alias("_asked")]
    f = f.select(*mark, F.col("file_id").alias("_file"), F.col("name").alias("_name"), F.col("id").alias("fn_id"), F.col("class_name").alias("fn_class"), F.col("start_line").alias("fn_start"), F.col("end_line").alias("fn_end"))
    same = (F.col("file_id") == F.col("_file")) & (F.col("caller") == F.col("_name")) & F.col("start_line").between(F.col("fn_start"), F.col("fn_end"))
    same &= F.col("caller_class_name").isNull() | (F.col("caller_class_name") == F.col("fn_class"))
    first = Window.partitionBy("file_id", "caller", "call_id").orderBy(F.col("fn_start").desc(), F.col("fn_end"), "fn_id")
    found = calls.join(f, same).withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r", "_file", "_name")
    return found if among is None else found.filter("_asked").drop("_asked")


def field_types(facts: Facts) -> DataFrame:
    return facts.fields.filter("field_type IS NOT NULL").select("file_id", F.col("class_name").alias("_cls"), F.col("name").alias("_attr"), F.explode(type_tokens(F.col("field_type"))).alias("t")).groupBy("file_id", "_cls", "_attr").agg(F.collect_set("t").alias("field_tokens"))


def param_types(facts: Facts) -> DataFrame:
    return facts.function_params.filter("param_type IS NOT NULL").select("function_id", F.col("name").alias("_attr"), F.explode(type_tokens(F.col("param_type"))).alias("t")).groupBy("function_id", "_attr").agg(F.collect_set("t").alias("param_tokens"))


def with_receiver(calls: DataFrame, facts: Facts, class_column: str = "fn_class") -> DataFrame:
    """``calls`` (with fn_id, class) and the type tokens of their object's attribute as field and as parameter, and the class's direct supers."""
    c = calls.withColumn("_attr", attribute(F.col("object_name")))
    ft = field_types(facts).withColumnRenamed("file_id", "_ff").withColumnRenamed("_attr", "_fa")
    pt = param_types(facts).withColumnRenamed("_attr", "_pa")
    sup = direct_supers(facts).groupBy(F.col("file_id").alias("_sf"), F.col("class_name").alias("_sc")).agg(F.collect_set("super_class_name").alias("supers"))
    c = c.join(ft, (c["file_id"] == ft["_ff"]) & (c[class_column] == ft["_cls"]) & (c["_attr"] == ft["_fa"]), "left").drop("_ff", "_cls", "_fa")
    c = c.join(pt, (c["fn_id"] == pt["function_id"]) & (c["_attr"] == pt["_pa"]), "left").drop("function_id", "_pa")
    return c.join(sup, (c["file_id"] == sup["_sf"]) & (c[class_column] == sup["_sc"]), "left").drop("_sf", "_sc", "_attr")


def _holds(array: str, value: Column) -> Column:
    return F.coalesce(F.array_contains(F.col(array), value), F.lit(False))


def types_match(target: Column) -> Column:
    return _holds("field_tokens", target) | _holds("param_tokens", target)


def call_matches(target: Column, own_class: str = "fn_class") -> Column:
    """Whether a call (after :func:`with_receiver`) goes to class ``target``."""
    obj = F.col("object_name")
    own = F.coalesce(F.col(own_class) == target, F.lit(False))
    return (
        F.when(obj == target, True).when(obj.isNull() | obj.isin(*SELVES), own)
        .when(obj == "super()", _holds("supers", target)).when(last_segment(obj) == target, True).otherwise(types_match(target))
    )


def property_matches(target: Column, own_class: str = "fn_class") -> Column:
    """Whether a property read goes to class ``target``; ``ancestors`` are the class's names above it in the file."""
    obj = F.col("object_name")
    own = F.coalesce(F.col(own_class) == target, F.lit(False))
    return F.when(obj.isin("self", "cls"), own | _holds("ancestors", target)).when(obj.isNull() | (obj == "this"), own).when(obj == target, False).otherwise(types_match(target))


def with_ancestors(rows: DataFrame, facts: Facts, class_column: str = "fn_class") -> DataFrame:
    a = file_ancestors(facts, rows.select("file_id")).groupBy(F.col("file_id").alias("_af"), F.col("class_name").alias("_ac")).agg(F.collect_set("ancestor").alias("ancestors"))
    return rows.join(a, (rows["file_id"] == a["_af"]) & (rows[class_column] == a["_ac"]), "left").drop("_af", "_ac")


def method_owners(facts: Facts) -> DataFrame:
    """(name, only_class): the class that owns all methods of a name, null if several do."""
    m = facts.scoped(facts.functions.filter("class_name IS NOT NULL")).groupBy("name").agg(F.min("class_name").alias("a"), F.max("class_name").alias("b"))
    return m.select("name", F.when(F.col("a") == F.col("b"), F.col("a")).alias("only_class"))


def _targets(functions: DataFrame) -> DataFrame:
    return functions.select(F.col("id").alias("g_id"), F.col("file_id").alias("g_file"), F.col("name").alias("g_name"), F.col("class_name").alias("g_class"), F.col("start_line").alias("g_start"), F.col("end_line").alias("g_end"))


def _outside(rows: DataFrame) -> DataFrame:
    """``rows`` with themselves as targets that no fact knows: the text of the call, g_id -1."""
    text = F.coalesce(F.concat("object_name", F.lit("."), "callee"), F.col("callee"))
    itself = {"g_id": F.lit(-1).cast("long"), "g_file": F.col("file_id"), "g_name": text, "g_class": F.lit(None).cast("string"), "g_start": F.col("start_line"), "g_end": F.col("end_line")}
    return rows.select(*SITE, *[c.alias(n) for n, c in itself.items()])


def _asked_classes(calls: DataFrame, facts: Facts) -> DataFrame:
    """(SITE, callee, _class): the classes that the objects of ``calls`` can be; a class can come more than once.

    Only the calls whose kind of object needs types or super classes meet them.
    """
    obj = F.col("object_name")
    own, above = obj.isNull() | obj.isin(*SELVES), obj == "super()"
    columns = [*SITE, "callee", "_class"]
    named = calls.withColumn("_class", F.when(own, F.col("fn_class")).when(~above, obj)).filter("_class IS NOT NULL")
    sup = direct_supers(facts).select(F.col("file_id").alias("_sf"), F.col("class_name").alias("_sc"), F.col("super_class_name").alias("_class"))
    supers = calls.filter(above).join(sup, (F.col("file_id") == F.col("_sf")) & (F.col("fn_class") == F.col("_sc")))
    other = calls.filter(~own & ~above).withColumn("_a", attribute(obj)).filter("_a IS NOT NULL")
    ft = field_types(facts).withColumnRenamed("file_id", "_ff")
    by_field = other.join(ft, (F.col("file_id") == F.col("_ff")) & (F.col("fn_class") == F.col("_cls")) & (F.col("_a") == F.col("_attr"))).withColumn("_class", F.explode("field_tokens"))
    by_param = other.join(param_types(facts), (F.col("fn_id") == F.col("function_id")) & (F.col("_a") == F.col("_attr"))).withColumn("_class", F.explode("param_tokens"))
    return named.select(*columns).unionByName(supers.select(*columns)).unionByName(by_field.select(*columns)).unionByName(by_param.select(*columns))


def forward_groups(calls: DataFrame, facts: Facts) -> tuple[DataFrame, DataFrame]:
    """Calls (call_id, with fn_id, fn_class) with the groups of functions that they can mean, and the calls that mean none.

    A group is the functions of a name (g_name) and a class (g_class), without a class those of the caller's
    file alone if ``near``. Groups stay as many as the calls, however many functions share a name; their
    functions come with :func:`members`. A call can have a group more than once.

    Each kind of object is joined by what its rule needs: the name with the classes that the object can be,
    with the caller's file, or with no class. Calls without a match have their kind's fallback, which the name
    alone tells: all methods of a name that one class owns, or all functions of the name.
    """
    calls = cut(calls.withColumn("fn_id", F.coalesce("fn_id", F.lit(-1))).select(*ASKED))  # a call outside of functions has no fn_id
    let_go(calls)
    functions = facts.scoped(facts.functions)
    groups = functions.select(F.col("name").alias("g_name"), F.col("class_name").alias("g_class")).distinct()
    obj, named = F.col("object_name"), F.col("callee") == F.col("g_name")
    group = [*SITE, "g_name", "g_class"]
    far = F.lit(False).alias("near")
    in_class = _asked_classes(calls, facts).join(groups, named & (F.col("_class") == F.col("g_class"))).select(*group, far)
    here = functions.filter("class_name IS NULL").select(F.col("name").alias("_n"), F.col("file_id").alias("_f"), F.lit(True).alias("_here")).distinct()
    plain = calls.filter(obj.isNull()).join(groups.filter("g_class IS NULL"), named)
    plain = plain.join(here, (F.col("callee") == F.col("_n")) & (F.col("file_id") == F.col("_f")), "left")
    found = cut(in_class.unionByName(plain.select(*group, F.coalesce("_here", F.lit(False)).alias("near"))))
    let_go(found)
    names = functions.groupBy(F.col("name").alias("_n")).agg(F.min("class_name").alias("_low"), F.max("class_name").alias("_high"))
    rest = calls.join(found.select("call_id", "fn_id").distinct(), ["call_id", "fn_id"], "left_anti").join(names, F.col("callee") == F.col("_n"), "left")
    owned = foreign_object(obj) & (obj != "super()") & (F.col("_low") == F.col("_high"))
    late = F.when(F.coalesce(owned, F.lit(False)), "owned").when(obj.isNull() & F.col("_n").isNotNull(), "every")
    rest = cut(rest.select(*ASKED, F.col("_low").alias("_owner"), late.alias("_late")))
    let_go(rest)
    one_owner = rest.filter("_late = 'owned'").select(*SITE, F.col("callee").alias("g_name"), F.col("_owner").alias("g_class"), far)
    every = rest.filter("_late = 'every'").join(groups, named).select(*group, far)
    return found.unionByName(one_owner).unionByName(every), _outside(rest.filter("_late IS NULL"))


def members(groups: DataFrame, facts: Facts) -> DataFrame:
    """``groups`` (file_id, g_name, g_class, near) with their functions, in columns g_*; nothing is dealt out after the functions are met."""
    g = _targets(facts.scoped(facts.functions)).distinct().withColumnsRenamed({"g_name": "_n", "g_class": "_c"})
    named = F.col("g_name") == F.col("_n")
    near = groups.filter("near").join(g.filter("_c IS NULL"), named & (F.col("file_id") == F.col("g_file")))
    free = groups.filter("NOT near AND g_class IS NULL").join(g.filter("_c IS NULL"), named)
    owned = groups.filter("NOT near AND g_class IS NOT NULL").join(g, named & (F.col("g_class") == F.col("_c")))
    return owned.unionByName(near).unionByName(free).drop("_n", "_c", "near")


def sites(groups: DataFrame) -> DataFrame:
    """``groups`` of callers (fn_id, file_id, start_line) once each; a free function that is near and far is far."""
    out = cut(groups.groupBy("fn_id", "file_id", "start_line", "g_name", "g_class").agg(F.min("near").alias("near")))
    let_go(out)
    return out


def resolve_forward(calls: DataFrame, facts: Facts) -> DataFrame:
    """Calls (call_id, with fn_id, fn_class) with the functions that they can mean: columns g_*; an external target has g_id -1."""
    groups, outside = forward_groups(calls, facts)
    return members(groups, facts).unionByName(outside)


def property_functions(facts: Facts) -> DataFrame:
    """Functions that are properties: by name and class, without a class by name."""
    p = facts.scoped(facts.python_properties).select(F.col("property_name").alias("_p"), F.col("class_name").alias("_c")).distinct()
    f = facts.scoped(facts.functions)
    return f.join(p, (f["name"] == F.col("_p")) & (f["class_name"].isNull() | (f["class_name"] == F.col("_c"))), "left_semi")


def property_groups(reads: DataFrame, facts: Facts) -> tuple[DataFrame, DataFrame]:
    """Property reads (with fn_id, fn_class) with the groups of properties that they can mean, and the reads that mean none, as :func:`forward_groups`.

    Whether a function is a property is told by its name and class, so all of a group are or none.
    """
    reads = cut(reads.select(*ASKED))
    let_go(reads)
    groups = property_functions(facts).select(F.col("name").alias("g_name"), F.col("class_name").alias("g_class")).distinct()
    met = with_receiver(with_ancestors(reads, facts), facts).join(groups, F.col("callee") == F.col("g_name")).filter(property_matches(F.coalesce("g_class", F.lit(""))))
    found = cut(met.select(*SITE, "g_name", "g_class", F.lit(False).alias("near")))
    let_go(found)
    rest = reads.join(found.select("call_id", "fn_id").distinct(), ["call_id", "fn_id"], "left_anti")
    return found, _outside(rest)
