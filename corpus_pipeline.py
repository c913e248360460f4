"""A corpus from raw documents: toxic texts out, copies out, near copies out, sources
mixed, packed.  Each stage reads what its predecessor kept, as written to Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from blendspark.llm import exact, mixing, overlap, packing, toxicity
from blendspark.llm.frames import table
from blendspark.operators.lineage import shared_folder


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 9 scores below one half stay."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the largest doc_id stays (operator 10)."""
    return exact.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the Jaccard join the least doc_id stays (operator 7)."""
    return overlap.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (operator 3)."""
    return mixing.mix(docs, mixing.quality_weights(table(spark, sf_dir, "labels")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences (operator 2)."""
    return packing.pack(docs, added=True)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]

#: Scores of nearest examples and token ids are not to be had in SQL; tests/llm holds the
#: pipeline against a plain version, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between them lies in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark.sparkContext)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
