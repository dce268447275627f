"""Keep a fact store up to date while files are written under its tree.

A file stream tells which source files are new or were written anew under another name; each micro-batch
that has any runs one sync, which reads only the files that differ from the store and drops those that
are gone. A batch that is run again after a failure finds the store up to date and changes nothing.
Files that are changed in place or removed are seen by the sync of the next batch, as the stream itself
lists new paths only. An empty tree starts no sync.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import FactStore
from ..sources.languages import EXTENSIONS


def watch(store: FactStore, root: str, checkpoint: str, language: str | None = None, every: str | None = None) -> StreamingQuery:
    """Start the stream: every so often ("10 seconds"), or once over all that is there if ``every`` is None."""
    root = os.path.realpath(root)
    glob = "*.{" + ",".join(e for k, all_of in EXTENSIONS.items() if language in (None, k) for e in all_of) + "}"
    lines = store.spark.readStream.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("wholetext", "true").load(root)
    paths = lines.select(F.col("_metadata.file_path").alias("path"))

    def refresh(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.sync(root, language)

    writer = paths.writeStream.queryName(f"watch {root}").option("checkpointLocation", checkpoint).foreachBatch(refresh)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
