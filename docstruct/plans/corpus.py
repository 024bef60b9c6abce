"""All structure tables of a corpus, each built when it is first asked for."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstruct import constants as K
from docstruct.functions import text as T
from docstruct.operators import blocks as B
from docstruct.operators import evidence as E
from docstruct.operators import figures as G
from docstruct.operators import structure as S
from docstruct.plans.staging import stage


# What a plan writes once because several of its branches read it.
BLOCK_PLAN = ("blocks",)
FIGURE_ROWS = ("figure_rows",)
SECTION_PLAN = ("blocks", "places", "front")
FOCUS_PLAN = (*SECTION_PLAN, "sections")
FIGURE_PLAN = (*FIGURE_ROWS, "figures")
REPORT_PLAN = (*FOCUS_PLAN, "figures", "selected", "structure")


class Corpus:
    """Lazy tables over one block table.

    ``snapshots`` (``schemas.SNAPSHOTS``) has the rendered pages, those without a block included.
    ``staged`` names the tables to be written once. Writing ``blocks`` (the annotated ones) means that
    the expressions on the text run once and every branch reads only the columns it needs.
    """

    def __init__(self, blocks: DataFrame, snapshots: DataFrame | None = None, staged: tuple[str, ...] = ()):
        self.blocks = blocks
        self.snapshots = snapshots
        self.staged = staged

    def _staged(self, name: str, df: DataFrame) -> DataFrame:
        return stage(df, name) if name in self.staged else df

    @cached_property
    def flagged(self) -> DataFrame:
        return B.flag_blocks(self.blocks)

    @cached_property
    def annotated(self) -> DataFrame:
        rows = B.annotate_blocks(self.flagged)
        if "blocks" in self.staged and "front" in self.staged:
            # Page 1 is together here: front matter is marked before the rows are written, and its other lines stay.
            rows = S.front_lines(rows, B.PAGE)
        return self._staged("blocks", rows)

    @property
    def lines(self) -> DataFrame:
        """Flagged rows: from the staged table when there is one."""
        return self.annotated if "blocks" in self.staged else self.flagged

    @cached_property
    def front(self) -> DataFrame:
        return self._staged("front", S.front_matter(self.lines))

    @cached_property
    def doi(self) -> DataFrame:
        return S.best_doi(self.lines).select("doc_id", "doi")

    @cached_property
    def places(self) -> DataFrame:
        """The headed sections without their texts."""
        return self._staged("places", S.heading_places(self.annotated))

    @cached_property
    def headed(self) -> DataFrame:
        return S.heading_sections(self.annotated, self.places.withColumnRenamed("rank", "position"))

    @cached_property
    def figures(self) -> DataFrame:
        figures = G.extract_figures(self.blocks, self._staged("figure_rows", G.figure_rows(self.annotated)), self.snapshots)
        return self._staged("figures", figures)

    @cached_property
    def sections(self) -> DataFrame:
        """All sections of a parsed document, title first and figures last."""
        sections = S.all_sections(
            self.annotated,
            self.front,
            self.places,
            S.keyword_sections(self.annotated, self.places),
            G.figures_sections(self.figures),
        )
        return self._staged("sections", sections)

    @cached_property
    def written(self) -> DataFrame:
        """The sections without the figures, which a raw text leaves out."""
        if "sections" in self.staged:
            return self.sections
        keyword = S.keyword_sections(self.annotated, self.places)
        return self._staged("written", S.all_sections(self.annotated, self.front, self.places, keyword))

    @cached_property
    def outline(self) -> DataFrame:
        """Keys, positions and sources of the sections, made without their texts."""
        if "sections" in self.staged:
            return self.sections.select("doc_id", "section_key", "position", "source")
        return self._staged("outline", S.section_outline(self.annotated, self.front, self.places))

    @cached_property
    def section_orders(self) -> DataFrame:
        return self.outline.groupBy("doc_id").agg(
            F.array_sort(F.collect_list(F.struct("position", "section_key")))["section_key"].alias("section_order")
        )

    @cached_property
    def figure_counts(self) -> DataFrame:
        return self.annotated.groupBy("doc_id").agg((F.max("caption_order") + 1).alias("figure_count"))

    @cached_property
    def uncertainties(self) -> DataFrame:
        """(doc_id, uncertainties) of all documents, from titles, outline and figure counts alone."""
        found = (
            S.document_counts(self.blocks, self.snapshots).select("doc_id")
            .join(self.front.select("doc_id", "title"), "doc_id", "left")
            .join(self.section_orders, "doc_id", "left")
            .join(self.figure_counts, "doc_id", "left")
        )
        order = F.coalesce("section_order", F.array().cast("array<string>"))
        return found.select(
            "doc_id", S.uncertainties(F.col("title"), order, F.coalesce("figure_count", F.lit(0))).alias("uncertainties")
        )

    @cached_property
    def abstracts(self) -> DataFrame:
        """(doc_id, abstract): headed ones, else those from the front matter; no other section is folded."""
        is_abstract = F.col("section_key") == "abstract"
        if "sections" in self.staged:
            rows = self.sections.filter(is_abstract & F.col("source").isin("heading", "fallback_abstract"))
            return rows.select("doc_id", F.col("content").alias("abstract"))
        front = S.front_sections(self.front, self.places).filter(is_abstract)
        headed = S.heading_sections(self.annotated, self.places.filter(is_abstract))
        rows = front.select("doc_id", "content").unionByName(headed.select("doc_id", "content"))
        return rows.withColumnRenamed("content", "abstract")

    @cached_property
    def structure(self) -> DataFrame:
        """One row per document: metadata, section order, counts, noise and uncertainties."""
        docs = (
            S.document_counts(self.blocks, self.snapshots)
            .join(self.front, "doc_id", "left")
            .join(self.doi, "doc_id", "left")
            .join(self.section_orders, "doc_id", "left")
            .join(self.abstracts, "doc_id", "left")
            .join(self.figure_counts, "doc_id", "left")
            .join(S.discarded_noise(self.lines), "doc_id", "left")
        )
        none = F.array().cast("array<string>")
        docs = docs.withColumns(
            {
                "figure_count": F.coalesce("figure_count", F.lit(0)),
                "section_order": F.coalesce("section_order", none),
                "authors": F.coalesce("authors", none),
                "discarded_noise": F.coalesce("discarded_noise", none),
            }
        )
        structure = docs.select(
            "doc_id", "title", "authors", "doi", "venue", "year", "abstract", "page_count", "figure_count",
            "section_order", "discarded_noise",
            S.uncertainties(F.col("title"), F.col("section_order"), F.col("figure_count")).alias("uncertainties"),
        )
        return self._staged("structure", structure)

    @cached_property
    def raw_texts(self) -> DataFrame:
        return S.raw_text(self.written, self.lines)

    @cached_property
    def bare_texts(self) -> DataFrame:
        return S.bare_texts(self.written, self.lines)

    @cached_property
    def parsed_documents(self) -> DataFrame:
        """One nested row per document. Its blocks stay in the block table: they have no bound per row."""
        entries = F.transform("pieces", lambda p: F.struct(p["section_key"], p["content"]))
        folded = S.folded_sections(self.sections).select(
            "doc_id", F.map_from_entries(entries).alias("sections"), S.listed_text(F.col("pieces")).alias("listed_text")
        )
        fields = [c for c in self.figures.columns if c != "doc_id"]
        nested = self.figures.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("figures"))
        metadata = F.struct(
            F.lit("pdf").alias("parser_kind"), "page_count", "title", "authors", "doi", "venue", "year", "figure_count"
        )
        empty = F.array().cast(nested.schema["figures"].dataType)
        return (
            self.structure.join(folded, "doc_id", "left")
            .join(self.bare_texts, "doc_id", "left")
            .join(nested, "doc_id", "left")
            .select(
                "doc_id", "title", F.coalesce("listed_text", "raw_text").alias("raw_text"), "sections", "section_order",
                F.coalesce("figures", empty).alias("figures"), metadata.alias("metadata"),
            )
        )

    @cached_property
    def focus(self) -> DataFrame:
        return S.focus_text(self.sections, self.bare_texts)

    @cached_property
    def selected_figures(self) -> DataFrame:
        """Best four figures per document; the ``figures`` section names every one of them."""
        return self._staged("selected", G.rank_figures(self.figures, None))

    @cached_property
    def artifacts(self) -> DataFrame:
        return E.limit_artifacts(E.figure_artifacts(self.selected_figures))

    @cached_property
    def evidence(self) -> DataFrame:
        return E.figure_evidence(self.selected_figures, self.artifacts)

    @cached_property
    def analyses(self) -> DataFrame:
        return E.figure_analyses(self.evidence)


def corpus_summary(corpus: Corpus) -> DataFrame:
    """Corpus roll-up: documents per uncertainty, documents per section key, figures per type."""
    kinds = E.figure_artifacts(corpus.figures)
    parts = [
        corpus.uncertainties.select(F.lit("uncertainty").alias("facet"), F.explode("uncertainties").alias("value")),
        corpus.outline.select(F.lit("section").alias("facet"), F.col("section_key").alias("value")),
        kinds.select(F.lit("figure_type").alias("facet"), F.col("figure_type").alias("value")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def parsed_text_documents(texts: DataFrame) -> DataFrame:
    """Plain text files as documents: no sections, no figures, the text doubles as Markdown."""
    stripped = T.strip(F.col("text"))
    return texts.select(
        "doc_id",
        T.infer_title(stripped).alias("title"),
        stripped.alias("raw_text"),
        stripped.alias("markdown"),
        F.lit("plain_text").alias("parser_kind"),
    )


def plain_focus(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", F.substring("raw_text", 1, K.FOCUS_CHARS).alias("focus_text"))
