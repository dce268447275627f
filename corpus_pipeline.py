"""A corpus pipeline over ``documents``: quality, near copies, benchmark leaks, mixing weights, shards.

Each stage takes all rows that the one before it kept and returns the columns of ``documents``; the
last one adds ``shard`` and ``slot``. :func:`run` writes each stage's rows to the folder that driver
and executors share and reads them back, so a lost executor costs no finished stage.

Defined cases, for every stage: a null text is an empty one, a null id is kept as it is (and never
decides for other rows), an empty table gives an empty one, columns beyond those that a stage needs
pass through whatever their names (``shard`` and ``slot`` are replaced by the last stage). Ties and
repeated rows: the classifier and the decontamination treat equal texts alike; of near copies the one with
the smallest id stays (the smallest text hash if rows share that id), once; the mix deals copies to
repeated rows one by one; sharding gives each its own place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontaminate, feistel, mixing, quality, simhash, tokenids
from factloom.llm.common import table

SHARDS = 16


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return feistel.shard_rows(docs, SHARDS)


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed),
    ("sharding", sharded),
]

#: XXH64, pivotal rounding and banded alignment are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = tokenids.shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
