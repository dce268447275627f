"""The fact store: Parquet tables in parts, refreshed by difference.

A sync reads the files whose language, modification time or size changed and writes their facts as a new
part; older parts stay as they are. The version's table ``files`` says which files are there and which
part holds their facts; what a part holds of other files (gone, changed or failed since) is left out by
a semi-join on the file's id, which parts without such files don't need. With more than ``MOST_PARTS``
parts all facts are written as one again. A version becomes current when its small pointer file has been
replaced, so readers see the old version or the new one.

Tables are sorted by the name that lookups ask for, in ranges over files, with bloom filters on it, so a
lookup reads few row groups.
"""

from __future__ import annotations

import json
import os
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scan
from .facts import SCHEMAS, Facts

MOST_PARTS, SCHEMA_VERSION = 8, 2
#: The names that lookups ask for.
SORTED = {"functions": "name", "classes": "name", "fields": "class_name", "calls": "callee", "imports": "module", "annotations": "name", "refs": "name", "class_super_classes": "super_class_name", "python_properties": "property_name", "python_property_callers": "property_name"}
OWNER = {"function_params": ("functions", "function_id"), "class_methods": ("classes", "class_id"), "class_super_classes": ("classes", "class_id")}


@dataclass
class Report:
    database: str
    candidates: int
    indexed: int
    reparsed: int
    failed: int
    errors: list[str]


class FactStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs  # noqa: SLF001  any file system that Spark can write to
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def meta(self) -> dict:
        """Version, root, languages and times; empty without a store."""
        place = self._hadoop.Path(f"{self.path}/current.json")
        if not self._fs.exists(place):
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/current.json", wholetext=True).first()[0])

    def _publish(self, meta: dict) -> None:
        """Replace the pointer file in one step, and remove versions that neither it nor the one before it needs."""
        new, place = self._hadoop.Path(f"{self.path}/next.json"), self._hadoop.Path(f"{self.path}/current.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        kind = getattr(self._hadoop, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)  # noqa: SLF001
        how[0] = kind.OVERWRITE
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())  # noqa: SLF001
        context.rename(self._fs.makeQualified(new), self._fs.makeQualified(place), how)
        for status in self._fs.listStatus(self._hadoop.Path(self.path)):
            name = status.getPath().getName()
            used = {meta["version"], meta["version"] - 1, *map(int, meta["parts"]), *map(int, meta["parts_before"])}
            if name[:1] == "v" and name[1:].isdigit() and int(name[1:]) not in used:
                self._fs.delete(status.getPath(), True)

    def facts(self) -> Facts:
        meta = self.meta()
        if not meta:
            raise FileNotFoundError(f"no index at {self.path}")
        return self._facts(meta["parts"], self._files(meta))

    def _files(self, meta: dict) -> DataFrame:
        return self.spark.read.schema(SCHEMAS["files"]).parquet(f"{self.path}/v{meta['version']}/files")

    def _facts(self, parts: dict[str, dict], files: DataFrame) -> Facts:
        def table(name: str) -> DataFrame:
            if name == "files":
                return files
            out = None
            for part, about in parts.items():
                rows = self._part(part, name)
                if not about["whole"]:
                    key, live = "file_id", files.select(F.col("id").alias("file_id"))
                    if name in OWNER:
                        owner, key = OWNER[name]
                        live = self._part(part, owner).join(live, "file_id", "left_semi").select(F.col("id").alias(key))
                    rows = rows.join(live, key, "left_semi")
                out = rows if out is None else out.unionByName(rows)
            return self.spark.createDataFrame([], SCHEMAS[name]) if out is None else out

        return Facts(table)

    def _part(self, part: str, name: str) -> DataFrame:
        """A table of a part; a file that is read again has another id, so older facts of it are never taken for new ones."""
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/v{part}/{name}")

    def _write(self, version: int, name: str, table: DataFrame) -> None:
        by = SORTED.get(name)
        if by is not None:
            table = table.repartitionByRange(by).sortWithinPartitions(by)
        table.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{by or 'id'}", str(by is not None).lower()).parquet(f"{self.path}/v{version}/{name}")

    def _write_all(self, version: int, tables: dict[str, DataFrame]) -> None:
        """All tables of a part, some at a time: most are small, and the cluster would wait for each."""
        with ThreadPoolExecutor(4) as pool:
            list(pool.map(lambda name: self._write(version, name, tables[name]), [name for name in SCHEMAS if name != "files"]))

    def sync(self, root: str, language: str | None = None) -> Report:
        """Bring the store up to date with the tree at ``root`` (for one language: its files only)."""
        root = os.path.realpath(root)
        old = self.meta()
        again = old.get("root") == root and old.get("schema_version") == SCHEMA_VERSION
        current = scan.source_files(self.spark, root, language)
        before = self._files(old) if again else self.spark.createDataFrame([], SCHEMAS["files"])
        same = ["path", "language", "mtime_nanos", "size_bytes"]
        snaps = scan.snapshots(current.join(before.select(*same), same, "left_anti"))
        version = old.get("version", 0) + 1
        staged = f"{self.path}/v{version}/snapshots"
        snaps.write.mode("overwrite").parquet(staged)
        snaps = self.spark.read.parquet(staged)
        kept = before.join(current.select(*same), same, "left_semi")
        if language is not None:
            kept = kept.unionByName(before.filter(F.col("language") != language))
        made = scan.explode(snaps, version)
        self._write(version, "files", kept.unionByName(made["files"]))
        files = self._files({"version": version})
        parts = dict(old["parts"]) if again else {}
        for part in list(parts):
            live = self.spark.read.parquet(f"{self.path}/v{part}/ids").join(files, "id", "left_semi").count()
            if live:
                parts[part] = parts[part] | {"whole": live == parts[part]["files"]}
            else:
                del parts[part]
        new = made["files"].count()
        if new:
            made["files"].select("id").write.mode("overwrite").parquet(f"{self.path}/v{version}/ids")
            self._write_all(version, made)
            parts[str(version)] = {"whole": True, "files": new}
        if len(parts) > MOST_PARTS:
            facts = self._facts(parts, files)
            version += 1
            self._write(version, "files", files)
            self._write_all(version, {name: getattr(facts, name) for name in SCHEMAS})
            files.select("id").write.mode("overwrite").parquet(f"{self.path}/v{version}/ids")
            parts = {str(version): {"whole": True, "files": files.count()}}
        failed = [(r["path"], r["error"]) for r in snaps.filter("error IS NOT NULL").select("path", "error").orderBy("path").collect()]
        now = int(time.time())
        found = {language} if language else {r[0] for r in current.select("language").distinct().collect()}
        languages = sorted({*(old.get("languages", []) if again else []), *found})
        self._publish({"version": version, "schema_version": SCHEMA_VERSION, "root": root, "languages": languages, "parts": parts, "parts_before": old.get("parts", {}), "created_at": old.get("created_at", now) if again else now, "updated_at": now})
        return Report(self.path, current.count(), self.facts().files.count(), snaps.count(), len(failed), [f"{p}: {e}" for p, e in failed])
