"""Source trees: which files belong to an index, and their facts."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.facts import SCHEMAS
from .languages import ENGINES, EXTENSIONS, detect

FILES = "path string, language string, mtime_nanos long, size_bytes long"


@cache
def _rule(line: str) -> tuple[bool, bool, bool, re.Pattern[str]] | None:
    """An ignore line: whether it takes back, is for folders only, holds from its folder on, and its pattern.

    ``*`` and ``?`` stay inside a name; ``**`` reaches over folders.
    """
    rule = line.rstrip("\n").rstrip("\r")
    rule = rule if rule.endswith("\\ ") else rule.rstrip()
    if not rule or rule.startswith("#"):
        return None
    keep, rule = rule.startswith("!"), rule[1:] if rule[:1] in ("!", "\\") else rule
    folders, rule = rule.endswith("/"), rule.rstrip("/")
    anchored, rule = "/" in rule, rule.lstrip("/")
    out, k = "", 0
    while k < len(rule):
        if rule.startswith("**/", k) and (k == 0 or rule[k - 1] == "/"):
            out, k = out + "(?:[^/]+/)*", k + 3
        elif rule[k:] == "**" and rule[k - 1 : k] == "/":
            out, k = out + ".+", k + 2
        elif rule[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif rule[k] == "?":
            out, k = out + "[^/]", k + 1
        elif rule[k] == "[" and (end := rule.find("]", k + 2)) > 0:
            inner = rule[k + 1 : end].replace("\\", "")
            out, k = out + "(?!/)[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        else:
            k += rule[k] == "\\" and k + 1 < len(rule)
            out, k = out + re.escape(rule[k]), k + 1
    try:
        return keep, folders, anchored, re.compile(out + r"\Z", re.S)
    except re.error:
        return None


def _ignored(rules: list[tuple[str, str]], path: str, is_dir: bool) -> bool:
    """Whether the ignore rules (folder, line), outer folders first, leave a path out; the last rule that fits decides."""
    out = False
    for folder, line in rules:
        rule = _rule(line)
        if rule is None or rule[1] and not is_dir or not path.startswith(folder + os.sep):
            continue
        keep, _, anchored, pattern = rule
        if pattern.match(path[len(folder) + 1 :] if anchored else os.path.basename(path)):
            out = not keep
    return out


def walk(root: str, language: str | None = None) -> list[tuple[str, str, int, int]]:
    """(path, language, mtime in ns, size) of the source files under ``root``, in order of path, one for each inode."""
    root = os.path.realpath(root)
    found: list[tuple[str, str, int, int]] = []
    inodes: set[tuple[int, int]] = set()
    pending: list[tuple[str, list[tuple[str, str]]]] = [(root, [])]
    candidates = []
    while pending:
        folder, rules = pending.pop()
        for name in (".gitignore", ".ignore"):
            try:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as file:
                    rules = [*rules, *((folder, line) for line in file)]
            except OSError:
                continue
        try:
            entries = list(os.scandir(folder))
        except OSError:  # gone, or not to be read
            continue
        for entry in entries:
            if entry.name == ".git" or _ignored(rules, entry.path, entry.is_dir(follow_symlinks=False)):
                continue
            if entry.is_dir(follow_symlinks=False):
                pending.append((entry.path, rules))
            elif entry.is_file(follow_symlinks=False) and (kind := detect(entry.name)) and language in (None, kind):
                try:
                    stat = entry.stat()
                    candidates.append((entry.path, kind, (stat.st_dev, stat.st_ino), stat.st_mtime_ns, stat.st_size))
                except OSError:  # files that can't be looked at count as one
                    candidates.append((entry.path, kind, (0, 0), 0, 0))
    for path, kind, inode, changed, size in sorted(candidates, key=lambda c: c[0]):
        if inode not in inodes:
            inodes.add(inode)
            found.append((path, kind, changed, size))
    return found


def source_files(spark: SparkSession, root: str, language: str | None = None) -> DataFrame:
    return spark.createDataFrame(walk(root, language), FILES)


def with_content(files: DataFrame) -> DataFrame:
    """``files`` (path, more) with their bytes, read by Spark's own reader: these paths and no others."""
    spark = files.sparkSession
    paths = [re.sub(r"([\[\]{}*?\\,])", r"\\\1", r["path"]) for r in files.select("path").distinct().toLocalIterator()]  # the walk has them on the driver as well
    raw = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(paths) if paths else spark.createDataFrame([], "path string, content binary")
    decoded = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("path"), r"\+", "%2B")), "^file:/*", "/")
    return files.join(raw.select(decoded.alias("path"), "content"), "path")


def _column(table: str) -> T.StructType:
    extra = {"functions": ("params", T.ArrayType(T.StructType(SCHEMAS["function_params"].fields[1:]))), "classes": ("methods", T.ArrayType(T.StringType()))}
    fields = [f for f in SCHEMAS[table].fields if f.name not in ("id", "file_id")]
    if table in extra:
        fields.append(T.StructField(*extra[table]))
    if table == "classes":
        fields.append(T.StructField("super_classes", T.ArrayType(T.StringType())))
    return T.StructType(fields)


TABLES = ("functions", "classes", "fields", "calls", "imports", "annotations", "refs", "python_properties", "python_property_callers")
#: One row for each file: its facts as JSON lists, one column for each table.
SNAPSHOT = ", ".join(["path string", "language string", "mtime_nanos long", "size_bytes long", "content_hash string", "error string", *(f"{t} string" for t in TABLES)])


def _snapshots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for r in frame.itertuples(index=False):
            engine = ENGINES.get(r.language)
            facts, error = {}, None
            if engine is None:
                error = f"no engine for {r.language}"
            else:
                try:
                    facts = engine(bytes(r.content).decode("utf-8", "replace"))
                except Exception as broken:  # noqa: BLE001  one file's failure is a row in the report
                    error = f"{type(broken).__name__}: {broken}"
            rows.append([r.path, r.language, r.mtime_nanos, r.size_bytes, r.content_hash, error, *(json.dumps(facts.get(t, [])) for t in TABLES)])
        yield pd.DataFrame(rows, columns=["path", "language", "mtime_nanos", "size_bytes", "content_hash", "error", *TABLES])


def extract(content: DataFrame) -> DataFrame:
    """One row of facts for each file (path, language, mtime_nanos, size_bytes, content_hash, content)."""
    return content.select("path", "language", "mtime_nanos", "size_bytes", "content_hash", "content").mapInPandas(_snapshots, SNAPSHOT)


def snapshots(files: DataFrame) -> DataFrame:
    """The facts of ``files``; they are dealt out by path so that large folders spread."""
    return extract(with_content(files).withColumn("content_hash", F.sha2("content", 256)).repartition("path"))


def file_id(reading: int) -> Column:
    """A file's id: of its path and of the reading, so that a file read again is another one."""
    return F.xxhash64("path", F.lit(reading).cast("long"))


def facts_of(table: str) -> Column:
    """A snapshot's facts of one table, as an array."""
    return F.from_json(table, T.ArrayType(_column(table)))


def explode(snaps: DataFrame, reading: int = 0) -> dict[str, DataFrame]:
    """The fact tables of snapshots. Ids are hashes of path, reading, kind and place, the same in every run."""
    good = snaps.filter("error IS NULL").withColumn("file_id", file_id(reading))
    out = {"files": good.select(F.col("file_id").alias("id"), "path", "language", "mtime_nanos", "size_bytes", "content_hash")}
    rows = {t: good.select("file_id", F.posexplode(facts_of(t)).alias("at", "x")).select("file_id", F.xxhash64("file_id", F.lit(t), "at").alias("id"), "x.*") for t in TABLES}
    out |= {t: rows[t].select(*[f.name for f in SCHEMAS[t].fields]) for t in TABLES}
    out["function_params"] = rows["functions"].select(F.col("id").alias("function_id"), F.explode("params").alias("p")).select("function_id", "p.*")
    out["class_methods"] = rows["classes"].select(F.col("id").alias("class_id"), F.explode("methods").alias("method_name"))
    out["class_super_classes"] = rows["classes"].select(F.col("id").alias("class_id"), F.explode("super_classes").alias("super_class_name"))
    return out
