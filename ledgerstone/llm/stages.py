"""The stages of the corpus pipeline: each a function of (spark, docs, folder of the tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerstone.llm import decontaminate, near_dedup, packing, quality, suffix_dedup
from ledgerstone.llm.common import cut, ship
from ledgerstone.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    ship(spark)
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    If ids repeat, each differing row of (doc_id, text) is a document of its own, null ids included.
    """
    ship(spark)
    node = "doc_id"
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():  # only repeated ids make another shuffle of texts worth it
        node = "node"
        docs = cut(docs.dropDuplicates(["doc_id", "text"]).orderBy("doc_id", "text").withColumn(node, F.monotonically_increasing_id()), "nodes")
    kept = near_dedup.link(docs.select(F.col(node).alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs[node].eqNullSafe(kept["kept_id"]), "left_semi").select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 50-byte strings that also start in an earlier document."""
    ship(spark)
    return suffix_dedup.strip(docs, COLUMNS)


def decontaminate_docs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item is found in; items of fewer than 8 tokens are not looked for."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=False).select(F.col("doc_id").alias("found_id")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["found_id"]), "left_anti").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    ship(spark)
    return packing.pack(docs, tokenizer_path())
