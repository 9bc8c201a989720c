"""The corpus pipeline: documents through quality rules, near-duplicate removal, benchmark
decontamination, source mixing and sharding.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``.  Its result is written
as Parquet and read again as the next stage's input.  All stages but the last return the columns
of documents; the last adds ``slot`` and ``shard``.

Nulls, empty texts, repeated rows and empty tables: see each operator.  In short, rows without
text fail the quality rules; of rows equal in id and text one stays from the second stage on; a
row's copies in the mix are equal rows, and the mix is stored in the order of its schedule.  Texts
of any length pass whole.  Further columns of documents stay, whatever their names, but for
``slot`` and ``shard``, which the last stage replaces.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import decontaminate, jaccard_tree, mixing, quality, sharding
from colloquy.llm.common import read, staging_path
from colloquy.session import drop_staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of 5-word shingle sets that reach Jaccard 0.8."""
    return jaccard_tree.keep_one(docs, k=5, num=4, den=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    return sharding.assign(docs, ["doc_id"])


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: Edit distances to stretches of documents are beyond SQL; the tests hold run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` through all stages.  A stage's table goes when the next one's is
    written; the last one's stays for the result."""
    docs, old = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = staging_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if old:
            drop_staged(spark, old)
        old = path
    return docs
