"""One registered query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm.chat import chat_digests
from lucerna.llm.common import table
from lucerna.llm.html_extract import extract_html
from lucerna.llm.license_scan import license_report
from lucerna.llm.media_ogg import media_columns
from lucerna.llm.mixing import LANGUAGE_TARGETS, mix
from lucerna.llm.ngram_join import ngram_components
from lucerna.llm.packing import pack_documents
from lucerna.llm.quality import classify_quality
from lucerna.llm.repair import repair_report
from lucerna.llm.resampling import resample_to_target
from lucerna.llm.sql import ORACLE
from lucerna.llm.token_counts import count_tokens
from lucerna.llm.topk import top_k
from lucerna.llm.toxicity import classify_toxicity

__all__ = ["ORACLE", "QUERIES"]


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(table(spark, sf_dir, "pages"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), added_tokens=True)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), added_tokens=True)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    control = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat_digests(turns.unionByName(control))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    covered = table(spark, sf_dir, "labels").select("doc_id").distinct()
    labelled = documents.select("doc_id", F.col("lang").alias("domain")).join(covered, "doc_id", "left_semi")
    return mix(documents, labelled, LANGUAGE_TARGETS)


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_to_target(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Phrases whose every place counts, and their labels.
LICENSE_PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"), LICENSE_PHRASES)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_text, op2_ngram_join, op3_token_counts, op4_exact_topk, op5_toxicity, op6_best_fit, op7_chat, op8_quality, op9_ogg, op10_mixing,
        op11_target_resampling, op12_license_scan, op13_conversation_repair,
    )
}
