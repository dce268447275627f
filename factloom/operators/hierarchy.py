"""Class hierarchies: closures by a frontier loop. Classes refer to their super classes by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.facts import Facts
from ..plans.lineage import cut
from .lookup import class_rows


def _gathered(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _closure(seeds: DataFrame, steps: DataFrame) -> DataFrame:
    """Ids that ``steps`` (src, dst) reach from ``seeds`` (id), without the seeds. Each round writes its frontier alone."""
    parts = [cut(seeds.select("id").distinct())]
    while not parts[-1].isEmpty():
        reached = parts[-1].join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        parts.append(cut(reached.join(_gathered(parts), "id", "left_anti")))
    return _gathered(parts[1:])


def super_steps(facts: Facts) -> DataFrame:
    """(src class, dst class): from a class to every class with the name of one of its super classes."""
    parents = facts.scoped(facts.classes).select(F.col("id").alias("dst"), F.col("name").alias("super_class_name"))
    return facts.class_super_classes.join(parents, "super_class_name").select(F.col("class_id").alias("src"), "dst")


def super_classes(facts: Facts, name: str) -> DataFrame:
    seeds = facts.scoped(facts.classes.filter(F.col("name") == name))
    found = _closure(seeds, super_steps(facts))
    return class_rows(facts, facts.classes.join(found, "id", "left_semi"))


def sub_classes(facts: Facts, name: str) -> DataFrame:
    seeds = facts.scoped(facts.classes.filter(F.col("name") == name))
    found = _closure(seeds, super_steps(facts).select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return class_rows(facts, facts.scoped(facts.classes.join(found, "id", "left_semi")))


def direct_supers(facts: Facts, files: DataFrame | None = None) -> DataFrame:
    """(file_id, class_name, super_class_name): what the classes of a file (of ``files`` only, if given) name as their super classes."""
    own = facts.classes.select(F.col("id").alias("class_id"), "file_id", F.col("name").alias("class_name"))
    own = own if files is None else own.join(files.select("file_id").distinct(), "file_id", "left_semi")
    return facts.class_super_classes.join(own, "class_id").select("file_id", "class_name", "super_class_name").distinct()


def file_ancestors(facts: Facts, files: DataFrame | None = None) -> DataFrame:
    """(file_id, class_name, ancestor): all names above a class through classes of the same file, without itself."""
    steps = cut(direct_supers(facts, files))
    key = ["file_id", "class_name", "ancestor"]
    parts = [cut(steps.select("file_id", "class_name", F.col("super_class_name").alias("ancestor")).filter("class_name <> ancestor"))]
    up = steps.select("file_id", F.col("class_name").alias("ancestor"), F.col("super_class_name").alias("above"))
    while not parts[-1].isEmpty():
        reached = parts[-1].join(up, ["file_id", "ancestor"]).select("file_id", "class_name", F.col("above").alias("ancestor")).filter("class_name <> ancestor").distinct()
        parts.append(cut(reached.join(_gathered(parts), key, "left_anti")))
    return _gathered(parts)
