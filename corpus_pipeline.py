"""A corpus pipeline over ``documents``: language ID, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm.common import materialize
from signalloom.llm.langid import UNDETERMINED, identify
from signalloom.llm.mixing import mix
from signalloom.llm.neardup import keep_one
from signalloom.llm.packing import pack
from signalloom.llm.queries import MIX_WEIGHTS, source_domain, tokenizer

#: Scores below this are rejected with the undetermined ones; four languages alike would be 0.25.
MIN_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told."""
    told = identify(docs, keep=True)
    lang, score = told.columns[-2:]
    return told.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies; documents that only share an id stay."""
    return keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring domains, languages and sources to their target weights."""
    return mix(docs, source_domain(F.col("source")), MIX_WEIGHTS, max_epochs=1).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences."""
    return pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Kernel methods, sketches and BM25 packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
