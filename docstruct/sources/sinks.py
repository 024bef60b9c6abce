"""Writing results. Tables are the normal form; one file per document is an export on top."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_reports(results: DataFrame, path: str) -> None:
    """One JSON line per document (doc_id, title, summary, ..., structured_data)."""
    results.write.mode("overwrite").json(path)


def write_markdown_reports(reports: DataFrame, path: str) -> None:
    """Table of (doc_id, markdown_report)."""
    reports.write.mode("overwrite").parquet(path)


def write_parsed_markdown(parsed: DataFrame, path: str) -> None:
    """Structured intermediates: only PDF documents with text, named ``<doc_id>.parsed.md``."""
    kept = parsed.filter((F.col("parser_kind") == "pdf") & (F.col("markdown") != ""))
    kept.select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".parsed.md")).alias("name"), "markdown"
    ).write.mode("overwrite").parquet(path)


def export_text_files(reports: DataFrame, path: str, name: str, text: str) -> None:
    """One folder per document with a single text file in it: for small exports, since the driver lists every folder."""
    reports.select(F.col(name).cast("string").alias("name"), F.col(text).alias("value")).write.mode(
        "overwrite"
    ).partitionBy("name").text(path)
