"""Helpers that the corpus operators share: table access, reliable lineage cuts and global row numbers."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that one Arrow batch hands to a Python worker; texts may be very long.
ARROW_BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the given folder, always through Spark's own readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of each Arrow batch, so that a worker's memory does not follow the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables that driver and executors share.

    It is the one that the session names in ``spark.checkpoint.dir``. Only where that is unset and the
    executors run inside the driver (tests, a laptop) a temporary one is made; on a cluster it must be set.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and re.fullmatch(r"local(\[.*\])?", context.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="factloom-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def number_rows(df: DataFrame, *order: str, name: str = "row_no", split_ties: bool = False) -> DataFrame:
    """``df`` with gapless numbers from 0 in the given order; ties are numbered in any order.

    A range exchange and a sort inside partitions give each row its place in its partition. What is
    collected is one count for each partition. ``df`` should be narrow: it is checkpointed once, so
    that places and counts come from one and the same run. With ``split_ties`` equal rows spread over
    partitions by where they are read; that is for rows that come straight from a table, whose
    order is the same if a task runs again.
    """
    spark = df.sparkSession
    tied = df.withColumn("_tie", F.monotonically_increasing_id()) if split_ties else df
    keys = [*order, *(["_tie"] if split_ties else [])]
    placed = cut(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    bases, total = [], 0
    for p, n in sizes:
        bases.append((p, total))
        total += n
    if not bases:
        return placed.withColumn(name, F.col("_at")).drop("_at")
    base = F.broadcast(spark.createDataFrame(bases, "_p long, _base long"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_p", part).join(base, "_p").withColumn(name, F.col("_base") + inside).drop("_p", "_base", "_at")


def one_row_each(rows: DataFrame, keys: list[str], columns: list[str], copies: str, per_task: int = 4096) -> DataFrame:
    """One of the rows that share ``keys`` for all of them, repeated in parts of ``per_task`` numbers.

    ``copies`` names the column with how many are wanted (the same in all rows of a key). The result has
    ``columns`` and ``_nth``, from 0; a key's copies are dealt out over tasks, and its rows are combined
    before they are exchanged.
    """
    kept = [F.col(f"`{c}`") for c in columns]
    one = rows.groupBy(*keys).agg(F.first(copies).cast("long").alias("_copies"), F.first(F.struct(*kept)).alias("_row"))
    parts = one.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {per_task}")))).repartition(*keys, "_part")
    numbers = F.sequence(F.col("_part") * per_task, F.least(F.col("_copies"), (F.col("_part") + 1) * per_task) - 1)
    return parts.select("_row.*", F.explode(numbers).alias("_nth"))
