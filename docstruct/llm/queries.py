"""The operators as registered queries, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstruct.llm.chat import chat_digests, format_chats, text_parts
from docstruct.llm.common import table
from docstruct.llm.decontam import contamination
from docstruct.llm.infill import infill_digests
from docstruct.llm.kneser_ney import classify
from docstruct.llm.langid import language_table
from docstruct.llm.linededup import dedup_passages
from docstruct.llm.merkle import verify_documents
from docstruct.llm.packing import pack_documents
from docstruct.llm.pages import extract_pages
from docstruct.llm.personal import personal_table
from docstruct.llm.quality import quality_rules, train
from docstruct.llm.simhash import near_groups
from docstruct.llm.urls import judge_urls


def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(table(spark, folder, "pages"))


def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels")).drop("row_key")


def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))


def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return dedup_passages(docs, short=True).select("doc_id", "text", "n_removed")


def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(table(spark, folder, "documents"))


def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("row_key")


def chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_digests(format_chats(turns.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))))


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_table(table(spark, folder, "documents"))


def quality_rule_table(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_rules(docs, train(docs, table(spark, folder, "labels")))


def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"))


def fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return infill_digests(table(spark, folder, "documents"))


def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return verify_documents(table(spark, folder, "documents"))


def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_table(table(spark, folder, "documents"))


QUERIES = {
    "op1_html_extraction": html_extraction,
    "op2_quality_classifier": quality_classifier,
    "op3_language_id": language_id,
    "op4_best_fit_packing": best_fit_packing,
    "op5_benchmark_decontamination": benchmark_decontamination,
    "op6_quality_rules": quality_rule_table,
    "op7_chat_formatting": chat_formatting,
    "op8_line_dedup": line_dedup,
    "op9_simhash_near_dedup": simhash_near_dedup,
    "op10_url_filters": url_filters,
    "op11_fill_in_middle": fill_in_middle,
    "op12_personal_data": personal_data,
    "op13_merkle_manifest": merkle_manifest,
}
