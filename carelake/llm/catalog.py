"""The registered queries of this folder and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from carelake.llm import oracles
from carelake.llm.conversation_repair import damaged, repair_report
from carelake.llm.decontaminate import contamination_report
from carelake.llm.embedding_dedup import embedding_links
from carelake.llm.filter_audit import filter_audit
from carelake.llm.html_main_text import extract_main_text
from carelake.llm.mixing import mix_report
from carelake.llm.near_dedup import near_duplicates
from carelake.llm.personal_data import personal_data_report
from carelake.llm.quality import quality_scores
from carelake.llm.secrets import secret_report
from carelake.llm.token_files import token_report
from carelake.llm.toxicity import toxicity_scores
from carelake.llm.warc import warc_report, write_warc
from carelake.session import run_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None) -> Callable:
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_decontaminate", oracles.OP1)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return report.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@_query("op9_near_duplicates", oracles.OP9)
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op8_source_mix")
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(_table(spark, sf_dir, "documents"))


@_query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(_table(spark, sf_dir, "documents"))


@_query("op10_secrets")
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(_table(spark, sf_dir, "documents"), whole=True)


@_query("op7_warc", oracles.OP7)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), path)
    return warc_report(spark, path)


@_query("op5_main_text")
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


@_query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op2_embedding_links", oracles.OP2)
def op2_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(_table(spark, sf_dir, "embeddings"))


@_query("op11_filter_audit", oracles.OP11)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op12_conversation_repair", oracles.OP12)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(_table(spark, sf_dir, "conversations")))


@_query("op13_personal_data")
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_report(_table(spark, sf_dir, "documents"))


@_query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
