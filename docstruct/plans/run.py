"""One batch job from blocks (or texts) and model results to written reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstruct.operators import reports as R
from docstruct.operators import responses as M
from docstruct.operators import structure as S
from docstruct.plans import staging
from docstruct.plans.corpus import REPORT_PLAN, Corpus, parsed_text_documents, plain_focus
from docstruct.sources import sinks

def no_results(docs: DataFrame) -> DataFrame:
    """An empty result table (``schemas.RESULTS``) whose ids have the type of those of ``docs``."""
    none = F.array().cast("array<string>")
    texts = ["title", "summary", "markdown_report", "structured_data"]
    return docs.limit(0).select(
        "doc_id", *[F.lit("").alias(t) for t in texts], none.alias("key_points"), none.alias("limitations")
    )


def research_tables(corpus: Corpus, results: DataFrame) -> dict[str, DataFrame]:
    """All output tables of research mode over a block corpus.

    ``json_reports`` has the whole result of every document: its fields, the rendered report and the merged data.
    """
    results = M.complete_results(results, corpus.structure)
    reports = R.research_reports(corpus.structure, corpus.sections, results, corpus.analyses, corpus.evidence)
    merged = R.merged_results(
        corpus.structure, S.selected_sections(corpus.sections), results, corpus.artifacts, corpus.evidence, corpus.analyses
    )
    fields = results.select("doc_id", "title", "summary", "key_points", "limitations")
    return {
        "markdown_reports": reports,
        "json_reports": merged.join(fields, "doc_id", "left").join(reports, "doc_id", "left"),
        "parsed_markdown": R.parsed_markdown(corpus.structure, corpus.sections, corpus.figures).withColumn(
            "parser_kind", F.lit("pdf")
        ),
    }


def general_tables(texts: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """All output tables of general mode over a text corpus (doc_id, text)."""
    docs = parsed_text_documents(texts)
    completed = M.complete_results(results, docs)
    reports = R.result_reports(completed, M.GENERAL_TEXT.report_title)
    return {
        "markdown_reports": reports,
        "json_reports": reports,
        "focus": plain_focus(docs),
    }


def run_corpus(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    mode: str = "research_paper",
    results: DataFrame | None = None,
) -> None:
    """Reads a block table (research mode) or a text table (general mode) and writes its reports.

    Keyword arguments replace the defaults one by one.
    """
    if mode not in ("research_paper", "general_text"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "general_text" and results is None:
        raise ValueError("general_text reports are made from model results: pass results")
    rows = spark.read.parquet(input_path)
    results = no_results(rows) if results is None else results
    with staging.scope(spark):
        if mode == "research_paper":
            tables = research_tables(Corpus(rows, staged=REPORT_PLAN), results)
            sinks.write_parsed_markdown(tables["parsed_markdown"], f"{output_path}/parsed_markdown")
        else:
            tables = general_tables(rows, results)
        sinks.write_markdown_reports(tables["markdown_reports"], f"{output_path}/markdown_reports")
        sinks.write_json_reports(tables["json_reports"], f"{output_path}/json_reports")
