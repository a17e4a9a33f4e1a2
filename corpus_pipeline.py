"""The corpus pipeline: five stages, each a function of (spark, docs, folder of the tables).

Each stage works on what its predecessor kept, written as Parquet and read again.  All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerstone.llm.common import cut, drop
from ledgerstone.llm.stages import COLUMNS, cut_repeats, decontaminate_docs, drop_near_duplicates, filter_quality, pack

STAGES = [
    ("quality classifier", filter_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", decontaminate_docs),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage{k}")
            drop(before)
    return docs


# A trained classifier, MinHash components, byte strings and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None
