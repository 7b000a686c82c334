"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinwork.llm import decontamination, minhash, quality, urls
from skeinwork.llm.common import read, read_spread
from skeinwork.llm.decontamination import contaminated
from skeinwork.llm.html import extract
from skeinwork.llm.langid import identify
from skeinwork.llm.lm import score_documents
from skeinwork.llm.minhash import near_duplicates
from skeinwork.llm.packing import pack
from skeinwork.llm.quality import score_quality
from skeinwork.llm.sharding import shard_documents
from skeinwork.llm.toxicity import score_toxicity
from skeinwork.llm.urls import filter_urls

#: The rules that op2 is asked to follow.
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_spread(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_spread(spark, sf_dir, "pages"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by likeness to the documents that are labelled as good."""
    good = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return score_documents(read_spread(spark, sf_dir, "documents"), good)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_spread(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_spread(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_spread(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_spread(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"), n_shards=16, carry_text=False)


def queries() -> dict[str, Query]:
    return {
        "op1_minhash": op1_minhash,
        "op2_urls": op2_urls,
        "op3_decontamination": op3_decontamination,
        "op4_html": op4_html,
        "op5_lm": op5_lm,
        "op6_quality": op6_quality,
        "op7_toxicity": op7_toxicity,
        "op8_packing": op8_packing,
        "op9_language": op9_language,
        "op10_sharding": op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash": minhash.ORACLE_SQL,
        "op2_urls": urls.oracle_sql(URL_RULES),
        "op3_decontamination": decontamination.ORACLE_SQL,
        "op6_quality": quality.ORACLE_SQL,
    }
