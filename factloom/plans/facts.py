"""The fact tables that operators read, opened on first use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()
_LINES = [("start_line", _L), ("end_line", _L)]


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns])


#: Every fact table; a ``file_id`` is a hash of the path, ids are hashes of path, kind and place.
SCHEMAS = {
    "files": _struct(("id", _L), ("path", _S), ("language", _S), ("mtime_nanos", _L), ("size_bytes", _L), ("content_hash", _S)),
    "functions": _struct(("id", _L), ("file_id", _L), ("name", _S), ("class_name", _S), *_LINES),
    "function_params": _struct(("function_id", _L), ("name", _S), ("param_type", _S), ("position", _I)),
    "classes": _struct(("id", _L), ("file_id", _L), ("name", _S), ("kind", _S), *_LINES),
    "class_methods": _struct(("class_id", _L), ("method_name", _S)),
    "class_super_classes": _struct(("class_id", _L), ("super_class_name", _S)),
    "fields": _struct(("id", _L), ("file_id", _L), ("class_name", _S), ("name", _S), ("field_type", _S), *_LINES),
    "calls": _struct(("file_id", _L), ("callee", _S), ("caller", _S), ("caller_class_name", _S), ("object_name", _S), *_LINES),
    "imports": _struct(("file_id", _L), ("module", _S), *_LINES),
    "annotations": _struct(("id", _L), ("file_id", _L), ("name", _S), ("signature", _S), *_LINES, ("target_name", _S), ("target_type", _S), ("target_signature", _S)),
    "refs": _struct(("file_id", _L), ("name", _S), ("node_type", _S), *_LINES, ("start_column", _L), ("end_column", _L)),
    "python_properties": _struct(("file_id", _L), ("property_name", _S), ("class_name", _S)),
    "python_property_callers": _struct(("file_id", _L), ("property_name", _S), ("caller", _S), ("caller_class_name", _S), ("object_name", _S), ("object_type", _S), *_LINES),
}


class Facts:
    """Fact tables by attribute: ``facts.functions``. ``language`` keeps the facts of one language's files."""

    def __init__(self, opened: Callable[[str], DataFrame], language: str | None = None) -> None:
        self._opened, self._tables, self.language = opened, {}, language

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        if name not in self._tables:
            self._tables[name] = self._opened(name)
        return self._tables[name]

    def of_language(self, language: str | None) -> Facts:
        return Facts(self._opened, language)

    def located(self, facts: DataFrame) -> DataFrame:
        """``facts`` with ``path`` and ``language`` of their files (of the chosen language only)."""
        files = self.files.select(F.col("id").alias("file_id"), "path", "language")
        if self.language is not None:
            files = files.filter(F.col("language") == self.language)
        return facts.join(files, "file_id")

    def scoped(self, facts: DataFrame) -> DataFrame:
        """``facts`` of the chosen language, without further columns."""
        if self.language is None:
            return facts
        kept = self.files.filter(F.col("language") == self.language).select(F.col("id").alias("file_id"))
        return facts.join(kept, "file_id", "left_semi")
