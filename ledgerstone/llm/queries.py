"""The registered queries of this subpackage: name -> function of (spark, folder of the tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerstone.llm import oracles
from ledgerstone.llm.common import ship
from ledgerstone.llm.decontaminate import COVERAGE, PLAIN, UNITS, WINDOW


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The byte-level vocabulary of the public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerstone.llm.sharding import assign

    return assign(_table(spark, sf_dir, "documents"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerstone.llm.near_dedup import link

    return link(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerstone.llm.quality import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerstone.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerstone.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerstone.llm.substring_dedup import dedup

    return dedup(_table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerstone.llm.lm import score

    return score(_table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerstone.llm.ann import search

    return search(_table(spark, sf_dir, "embeddings"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerstone.llm.suffix_dedup import dedup

    return dedup(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerstone.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in (op1_minhash, op2_quality, op3_decontamination, op4_licenses, op5_substring_dedup, op6_sharding, op7_lm_scoring, op8_nearest, op9_suffix_dedup, op10_packing)}
ORACLE_SQL = {"op1_minhash": oracles.OP1, "op3_decontamination": oracles.op3(WINDOW, COVERAGE, UNITS, PLAIN), "op5_substring_dedup": oracles.OP5, "op6_sharding": oracles.OP6, "op9_suffix_dedup": oracles.OP9}
