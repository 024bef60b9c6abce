"""Research mode over a mixed corpus: block documents and plain texts in one plan, model replies included.

Replies come in as one table (``schemas.RESPONSES``) with the kinds ``draft``, ``artifacts``, ``evidence`` and ``analyses``.
Drafts are laid over the parsed structure before anything is derived from it, so that focus texts, figures and reports
follow the corrected documents. Figure replies replace the rule-based tables document by document.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstruct import constants as K
from docstruct import schemas
from docstruct.operators import evidence as E
from docstruct.operators import figures as G
from docstruct.operators import reports as R
from docstruct.operators import responses as M
from docstruct.operators import structure as S
from docstruct.plans import staging
from docstruct.plans.corpus import FOCUS_PLAN, Corpus, parsed_text_documents
from docstruct.plans.staging import stage
from docstruct.sources import files as I
from docstruct.sources import sinks

#: What a parsed corpus under a mixed plan writes once; the refined tables are written besides.
PARSED_PLAN = (*FOCUS_PLAN, "figures", "structure")


def replies_of(replies: DataFrame, kind: str, docs: DataFrame) -> DataFrame:
    """The last reply of one kind for each of ``docs``."""
    own = replies.filter(F.col("kind") == kind).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return M.last_replies(own.select("response_id", "doc_id", "kind", "raw"))


class MixedCorpus:
    """Lazy tables of a corpus whose documents are blocks (``parsed``) or plain ``texts`` (doc_id, text).

    ``replies`` may be None. Only block documents are refined by drafts; a plain text has no sections and no figures.
    """

    def __init__(self, parsed: Corpus, texts: DataFrame | None = None, replies: DataFrame | None = None):
        self.parsed = parsed
        spark = parsed.blocks.sparkSession
        self.replies = spark.createDataFrame([], schemas.RESPONSES) if replies is None else replies
        self.texts = None if texts is None else parsed_text_documents(texts)

    @cached_property
    def _refined(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        drafts = stage(M.parse_drafts(replies_of(self.replies, "draft", self.parsed.structure)), "drafts")
        return M.apply_drafts(self.parsed.structure, self.parsed.sections, self.parsed.figures, drafts)

    @cached_property
    def figures(self) -> DataFrame:
        return stage(self._refined[2], "refined-figures")

    @cached_property
    def sections(self) -> DataFrame:
        return stage(self._refined[1], "refined-sections")

    @cached_property
    def structure(self) -> DataFrame:
        """One row per document of either kind, with ``parser_kind``."""
        listed = self.sections.groupBy("doc_id").agg(
            F.array_sort(F.collect_list(F.struct("position", "section_key")))["section_key"].alias("order")
        )
        drawn = self.figures.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("drawn"))
        none = F.array().cast("array<string>")
        blocks = (
            self._refined[0]
            .join(self.parsed.structure.select("doc_id", "page_count"), "doc_id")
            .join(listed, "doc_id", "left")
            .join(drawn, "doc_id", "left")
            .select(
                "doc_id", "title", F.coalesce("authors", none).alias("authors"), "doi", "venue", "year", "abstract", "page_count",
                F.coalesce("drawn", F.lit(0)).alias("figure_count"), F.coalesce("order", none).alias("section_order"),
                F.coalesce("discarded_noise", none).alias("discarded_noise"), F.coalesce("uncertainties", none).alias("uncertainties"),
                F.lit("pdf").alias("parser_kind"),
            )
        )
        if self.texts is None:
            return stage(blocks, "refined-structure")
        text = self.texts.select("doc_id", "title", F.col("parser_kind"))
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in blocks.schema if f.name not in text.columns]
        plain = text.select("doc_id", "title", "parser_kind", *empty).withColumns(
            {"authors": none, "section_order": none, "discarded_noise": none, "uncertainties": none, "figure_count": F.lit(0)}
        )
        return stage(blocks.unionByName(plain), "refined-structure")

    @cached_property
    def bare_texts(self) -> DataFrame:
        """Raw texts of what has no listed section: block documents without one, and the plain texts."""
        bare = S.bare_texts(self.sections, self.parsed.lines)
        return bare if self.texts is None else bare.unionByName(self.texts.select("doc_id", "raw_text"))

    @cached_property
    def raw_texts(self) -> DataFrame:
        """Section texts of block documents after their drafts, and the plain texts."""
        return S.raw_text(self.sections).unionByName(self.bare_texts)

    @cached_property
    def focus(self) -> DataFrame:
        return S.focus_text(self.sections, self.bare_texts)

    @cached_property
    def selected_figures(self) -> DataFrame:
        """Best four figures; the ``figures`` section of a document with figures names each of them."""
        return stage(G.rank_figures(self.figures, None), "refined-selected")

    @cached_property
    def artifacts(self) -> DataFrame:
        rules = E.limit_artifacts(E.figure_artifacts(self.selected_figures))
        replies = replies_of(self.replies, "artifacts", self.selected_figures)
        return stage(M.parse_or_keep(replies, "artifacts", K.ARTIFACT_LIMITS, rules, "confidence"), "refined-artifacts")

    @cached_property
    def evidence(self) -> DataFrame:
        rules = E.figure_evidence(self.selected_figures, self.artifacts)
        replies = replies_of(self.replies, "evidence", self.selected_figures)
        return stage(M.parse_or_keep(replies, "evidences", K.EVIDENCE_LIMITS, rules, "evidence_quality"), "refined-evidence")

    @cached_property
    def analyses(self) -> DataFrame:
        return stage(M.parse_analyses(replies_of(self.replies, "analyses", self.evidence), self.evidence), "refined-analyses")


def mixed_tables(corpus: MixedCorpus, results: DataFrame) -> dict[str, DataFrame]:
    """All output tables of research mode; ``results`` (``schemas.RESULTS``) may lack documents.

    ``focus`` and ``reader_prompts`` are what the text roles are given, ``parsed_markdown`` shows the parse before drafts.
    """
    results = M.complete_results(results, corpus.structure)
    reports = R.research_reports(corpus.structure, corpus.sections, results, corpus.analyses, corpus.evidence)
    merged = R.merged_results(
        corpus.structure, S.selected_sections(corpus.sections), results, corpus.artifacts, corpus.evidence, corpus.analyses
    )
    fields = results.select("doc_id", "title", "summary", "key_points", "limitations")
    titled = corpus.focus.join(corpus.structure.select("doc_id", "title"), "doc_id", "left")
    parsed = corpus.parsed
    return {
        "markdown_reports": reports,
        "json_reports": merged.join(fields, "doc_id", "left").join(reports, "doc_id", "left"),
        "focus": corpus.focus,
        "reader_prompts": M.reader_prompts(titled, M.RESEARCH_PAPER),
        "parsed_markdown": R.parsed_markdown(parsed.structure, parsed.sections, parsed.figures).withColumn(
            "parser_kind", F.lit("pdf")
        ),
    }


def read_inputs(spark: SparkSession, folder: str, spans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files of a folder as (blocks, texts, rejected), each file on the route of its name.

    Page spans (``schemas.SPANS``, with the path as ``doc_id``) stand for the pages of its ``.pdf`` files.
    """
    accepted, rejected = I.validate_files(I.read_uploads(spark, folder))
    routed = I.route_documents(accepted).select(F.col("path").alias("doc_id"), "route")
    named = {kind: routed.filter(F.col("route") == kind).select("doc_id") for kind in ("pdf", "plain_text")}
    blocks = I.assemble_blocks(spans.join(named["pdf"], "doc_id", "left_semi"))
    texts = I.read_text_corpus(spark, folder).join(named["plain_text"], "doc_id", "left_semi")
    return blocks, texts.select("doc_id", F.col("raw_text").alias("text")), rejected


def run_files(
    spark: SparkSession, folder: str, spans: DataFrame, output_path: str, results: DataFrame | None = None,
    replies: DataFrame | None = None,
) -> None:
    """One batch job from uploaded files to reports: checks, routes, parses, refines and writes them."""
    from docstruct.plans.run import no_results

    blocks, texts, rejected = read_inputs(spark, folder, spans)
    with staging.scope(spark):
        corpus = MixedCorpus(Corpus(stage(blocks, "assembled"), staged=PARSED_PLAN), texts, replies)
        tables = mixed_tables(corpus, no_results(corpus.structure) if results is None else results)
        sinks.write_markdown_reports(tables["markdown_reports"], f"{output_path}/markdown_reports")
        sinks.write_json_reports(tables["json_reports"], f"{output_path}/json_reports")
        sinks.write_parsed_markdown(tables["parsed_markdown"], f"{output_path}/parsed_markdown")
        for name in ("focus", "reader_prompts"):
            tables[name].write.mode("overwrite").parquet(f"{output_path}/{name}")
        rejected.write.mode("overwrite").parquet(f"{output_path}/rejected")
