"""Model input and output tables. The model call is the user's: ``apply_model`` runs their function.

``responses``: (response_id, doc_id, kind, raw). Each parser yields ``status`` = parsed or fallback.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstruct import constants as K
from docstruct import labels
from docstruct.functions import payload as P
from docstruct.functions import text as T
from docstruct.operators import structure as S
from docstruct.operators.blocks import fold_text
from docstruct.operators.evidence import figure_analyses
from docstruct.operators.figures import figures_sections

PAPER_SCHEMA = (
    "metadata struct<title:string,authors:array<string>,venue:string,year:string>,"
    "extracted_notes struct<research_problem:string,core_method:string,datasets:array<string>,"
    "experimental_setup:string,main_results:string>,"
    "novelty string,strengths array<string>,limitations array<string>,reproducibility string"
)


def apply_model(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Runs a user function (pandas batch -> pandas batch) over all partitions."""

    def run(batches):
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema=schema)


# --- prompts ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Profile:
    """What a reader and an analyst are asked for."""

    name: str
    report_title: str
    headings: tuple[str, ...]
    reader_rules: tuple[str, ...]
    analyst_rules: tuple[str, ...]
    data_rules: tuple[str, ...]


GENERAL_TEXT = Profile(
    name="general_text",
    report_title="通用文本分析报告",
    headings=("Overview", "Main claims", "Support", "Terms and entities", "Open points"),
    reader_rules=("State only what the text says.", "Write the missing marker where nothing is said."),
    analyst_rules=("Base every statement on the text.", "Keep list entries short."),
    data_rules=("`sections` maps a section name to a short text.", "Prefer strings and short lists."),
)
RESEARCH_PAPER = Profile(
    name="research_paper",
    report_title="研究型文献分析报告",
    headings=("Bibliographic data", "Problem", "Method", "Data", "Setup", "Results"),
    reader_rules=(
        "Do not invent authors, venues, years, data sets or numbers.",
        "Look up single sections of a long text with the section search.",
    ),
    analyst_rules=("Check doubtful statements with the keyword search.", "Keep strengths and limitations short."),
    data_rules=(
        "`metadata`: title, authors, venue, year.",
        "`extracted_notes`: research_problem, core_method, datasets, experimental_setup, main_results.",
        "`novelty`, `strengths`, `limitations`, `reproducibility`.",
    ),
)


def _named(title: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.lit(labels.text("untitled_document")))


def _listed(items: tuple[str, ...]) -> str:
    return "\n".join(f"- {x}" for x in items)


def reader_prompts(docs: DataFrame, profile: Profile) -> DataFrame:
    """docs: (doc_id, title, focus_text) -> (doc_id, kind, prompt)."""
    headings = "\n".join(f"{i}. {h}" for i, h in enumerate(profile.headings, 1))
    prompt = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Take notes on the text titled: "), _named(F.col("title"))),
        F.col("focus_text"),
        F.lit(f"Use these headings:\n{headings}"),
        F.lit(f"Rules:\n{_listed(profile.reader_rules)}"),
    )
    return docs.select("doc_id", F.lit("reader").alias("kind"), prompt.alias("prompt"))


def analyst_prompts(docs: DataFrame, profile: Profile) -> DataFrame:
    fields = ("title", "summary", "key_points", "limitations", "markdown_report", "structured_data")
    prompt = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Turn the notes and the text into one JSON object. Text titled: "), _named(F.col("title"))),
        F.col("focus_text"),
        F.lit(f"Fields:\n{_listed(fields)}"),
        F.lit(f"Content of structured_data:\n{_listed(profile.data_rules)}"),
        F.lit(f"Rules:\n{_listed(profile.analyst_rules)}"),
    )
    return docs.select("doc_id", F.lit("analyst").alias("kind"), prompt.alias("prompt"))


def block_lines(blocks: DataFrame) -> DataFrame:
    """One line per block, folded per document in reading order (inside each page first)."""
    where = [F.lit("- "), F.col("block_id"), F.lit(" | page="), F.col("page_number"), F.lit(" | type=")]
    path = F.col("image_path") if "image_path" in blocks.columns else F.lit(None).cast("string")
    image = F.concat(F.lit("image | image_path="), F.coalesce(path, F.lit(labels.text("not_provided"))))
    text = F.concat(F.lit("text | text="), T.sanitize_text(F.col("text"), 240))
    line = F.concat(*where, F.when(F.col("block_type") == "image", image).otherwise(text))
    return fold_text(blocks.withColumn("line", line), ["doc_id"], "\n", text="line").withColumnRenamed(
        "line", "block_lines"
    )


def structuring_prompts(blocks: DataFrame, drafts: DataFrame) -> DataFrame:
    """drafts: one row per document with ``doc_id``, ``title`` and any fields to show as JSON."""
    draft = F.to_json(F.struct(*[c for c in drafts.columns if c != "doc_id"]))
    prompt = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Correct the structure of the document titled: "), _named(F.col("title"))),
        F.concat(F.lit("Blocks in reading order:\n"), F.col("block_lines")),
        F.concat(F.lit("Draft:\n"), F.col("draft")),
        F.lit("Answer with one JSON object with the fields of the draft."),
    )
    return (
        drafts.withColumn("draft", draft)
        .join(block_lines(blocks), "doc_id")
        .select("doc_id", F.lit("draft").alias("kind"), prompt.alias("prompt"))
    )


def figure_prompts(figures: DataFrame, kind: str, instruction: str, **tables: DataFrame) -> DataFrame:
    """Per document: the instruction and a JSON payload of one or more tables keyed by document."""
    payloads = figures.select("doc_id").distinct()
    for name, table in tables.items():
        rows = F.array_sort(F.collect_list(F.struct(*[c for c in ["caption_order", *[
            x for x in table.columns if x not in ("doc_id", "caption_order")]]])))
        payloads = payloads.join(table.groupBy("doc_id").agg(F.to_json(rows).alias(name)), "doc_id", "left")
    parts = [F.concat(F.lit(f"{name}:\n"), F.coalesce(name, F.lit("[]"))) for name in tables]
    return payloads.select(
        "doc_id", F.lit(kind).alias("kind"), F.concat_ws("\n\n", F.lit(instruction), *parts).alias("prompt")
    )


# --- replies ------------------------------------------------------------------------------


def read_objects(responses: DataFrame, limit: int | None = None) -> DataFrame:
    """Adds ``json`` (object text), ``body`` (VARIANT) and ``status``."""
    cleaned = T.sanitize_text(F.col("raw"), limit)
    return (
        responses.withColumn("json", P.extract_json(cleaned))
        .withColumn("body", P.parse_object(F.col("json")))
        .withColumn("status", F.when(F.col("body").isNotNull(), "parsed").otherwise("fallback"))
    )


def parse_quality(read: DataFrame) -> DataFrame:
    return read.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


def last_replies(responses: DataFrame) -> DataFrame:
    """One reply per document: that with the highest ``response_id``."""
    row = F.struct(*[F.col(c) for c in responses.columns])
    return responses.groupBy(F.col("doc_id").alias("_doc")).agg(F.max_by(row, "response_id").alias("r")).select("r.*")


def parse_drafts(responses: DataFrame, limit: int | None = None) -> DataFrame:
    """Document drafts: sanitised fields, empty where the reply gives nothing.

    Replies are read whole; ``constants.REPLY_CHARS_DRAFT`` as ``limit`` restores the cut of 120,000 characters,
    under which longer drafts are unreadable.
    """
    lim = K.DRAFT_LIMITS
    body = F.col("body")

    def text(name: str) -> Column:
        return P.limited_text(P.field(body, name), lim[name]).alias(name)

    def texts(name: str) -> Column:
        return P.limited_list(P.field(body, name), lim[name]).alias(name)

    def figure(v: Column) -> Column:
        scalars = [P.limited_text(P.field(v, n), lim[n]).alias(n) for n in ("figure_id", "caption")]
        path = F.nullif(P.limited_text(P.field(v, "page_snapshot_path"), lim["page_snapshot_path"]), F.lit(""))
        lists = [
            P.limited_list(P.field(v, n), lim[n]).alias(n)
            for n in ("image_block_paths", "referenced_text_spans", "caption_block_ids", "reference_block_ids")
        ]
        page = T.coerce_int(P.as_text(P.field(v, "page_number"))).alias("page_number")
        return F.struct(*scalars, page, path.alias("page_snapshot_path"), *lists)

    sections = P.object_entries(P.field(body, "sections"), F.get_json_object("json", "$.sections"))
    named = F.transform(
        F.when(P.is_object(P.field(body, "sections")), sections),
        lambda e: F.struct(
            T.canonical_section_key(T.sanitize_text(e["name"], lim["section_key"])).alias("section_key"),
            P.limited_text(e["value"], lim["section_text"]).alias("content"),
        ),
    )
    objects = F.filter(P.items(P.field(body, "figures")), P.is_object)
    return read_objects(responses, limit).select(
        "doc_id",
        "status",
        *[text(n) for n in ("title", "doi", "venue", "year", "abstract")],
        *[texts(n) for n in ("authors", "discarded_noise", "uncertainties")],
        F.transform(P.limited_list(P.field(body, "section_order"), lim["section_order"]), T.canonical_section_key).alias(
            "section_order"
        ),
        F.filter(named, lambda s: (s["section_key"] != "") & (s["content"] != "")).alias("sections"),
        F.transform(objects, figure).alias("figures"),
    )


def draft_sections(drafts: DataFrame) -> DataFrame:
    """Long section table of the drafts; of a repeated key the last text counts, at its first place."""
    rows = drafts.filter(F.size("sections") > 0).select("doc_id", F.posexplode("sections").alias("at", "s"))
    return rows.groupBy("doc_id", F.col("s.section_key").alias("section_key")).agg(
        F.max_by("s.content", "at").alias("content"), F.min("at").alias("position")
    )


def draft_figures(drafts: DataFrame, figures: DataFrame) -> DataFrame:
    """Figures named by the drafts; documents whose draft names none keep the extracted ones."""
    named = drafts.filter(F.size("figures") > 0).select("doc_id", F.posexplode("figures").alias("caption_order", "f"))
    columns = [c for c in figures.columns if c not in ("doc_id", "caption_order")]
    rows = named.select("doc_id", "caption_order", *[F.col(f"f.{c}").alias(c) for c in columns])
    kept = figures.join(named.select("doc_id").distinct(), "doc_id", "left_anti")
    return rows.unionByName(kept)


def apply_drafts(
    structure: DataFrame, sections: DataFrame, figures: DataFrame, drafts: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drafts over the rule results, field by field: (metadata, sections, figures).

    A draft may place the ``figures`` section; its text always lists the figures where there are any.
    """
    fields = ["title", "authors", "doi", "venue", "year", "abstract", "discarded_noise", "uncertainties"]
    merged = S.merge_fields(drafts, structure, fields)
    figures = draft_figures(drafts, figures)
    written = sections.filter(~F.col("section_key").isin("title", "figures"))
    replaced = S.merge_sections(written, draft_sections(drafts))
    # One pass over the merged texts: the figures section of a draft goes where the figures themselves are listed.
    marked = replaced.join(figures.select("doc_id").distinct().withColumn("drawn", F.lit(True)), "doc_id", "left")
    replaced = marked.filter((F.col("section_key") != "figures") | F.col("drawn").isNull()).drop("drawn")
    order = drafts.select("doc_id", F.posexplode("section_order").alias("position", "section_key"))
    drawn = figures_sections(figures).withColumnRenamed("place", "position")
    overlaid = S.overlay_sections(drawn, replaced, order)
    titles = merged.filter(F.col("title").isNotNull()).select(
        "doc_id", F.lit("title").alias("section_key"), F.col("title").alias("content"), F.lit(-1).alias("position")
    )
    return merged, titles.unionByName(overlaid), figures


def _panel(v: Column) -> Column:
    """A panel of a reply in the shape of ``evidence.caption_panels``; its texts are kept as they came."""
    scalars = ["panel_id", "panel_label", "panel_type", "summary"]
    lists = ["visible_text", "axes", "legend_items"]
    return F.struct(
        *[F.coalesce(P.as_text(P.field(v, n)), F.lit("")).alias(n) for n in scalars],
        *[P.texts(P.field(v, n)).alias(n) for n in lists],
        F.coalesce(P.as_text(P.field(v, "confidence")), F.lit("")).alias("confidence"),
    )


def parse_rows(responses: DataFrame, key: str, limits: dict, limit: int | None = None) -> DataFrame:
    """Objects of the list under ``key``, one row each, every field sanitised to its limit."""
    read = read_objects(responses, limit)
    found = F.filter(P.items(P.field(F.col("body"), key)), P.is_object)
    rows = read.filter(F.col("status") == "parsed").select(
        "doc_id", F.posexplode(found).alias("caption_order", "item")
    )
    columns = []
    for name, bound in limits.items():
        value = P.field(F.col("item"), name)
        if isinstance(bound, tuple):
            columns.append(P.limited_list(value, bound).alias(name))
        elif name == "panels":
            columns.append(F.slice(F.transform(F.filter(P.items(value), P.is_object), _panel), 1, bound).alias(name))
        else:
            columns.append(P.limited_text(value, bound).alias(name))
    page = T.coerce_int(P.as_text(P.field(F.col("item"), "page_number"))).alias("page_number")
    return rows.select("doc_id", "caption_order", page, *columns)


def _with_default(df: DataFrame, name: str) -> DataFrame:
    insufficient = F.lit(labels.text("insufficient"))
    return df.withColumn(name, F.coalesce(F.nullif(name, F.lit("")), insufficient))


def parse_analyses(responses: DataFrame, evidence: DataFrame, limit: int | None = None) -> DataFrame:
    """Figure analyses from the last reply of each document; one set for every document with evidence or a reply.

    Documents whose reply is unreadable, and those without a reply, get the rule-based analyses. ``limit`` cuts
    the reply before it is read; ``constants.REPLY_CHARS_FIGURES`` gives the cut of 320 characters under which
    longer replies are always unreadable. The default reads whole replies.
    """
    responses = last_replies(responses)
    parsed = _with_default(parse_rows(responses, "analyses", K.ANALYSIS_LIMITS, limit), "confidence")
    status = read_objects(responses, limit).select("doc_id", "status")
    failed = evidence.join(status.filter(F.col("status") == "fallback"), "doc_id", "left_semi")
    unanswered = evidence.join(status, "doc_id", "left_anti")
    rules = figure_analyses(failed, reason=labels.text("reason_unparsable")).unionByName(figure_analyses(unanswered))
    return parsed.select(*rules.columns).unionByName(rules)


def parse_or_keep(responses: DataFrame, key: str, limits: dict, fallback: DataFrame, default: str) -> DataFrame:
    """Artifacts or evidence from the last replies; a document without any readable entry keeps ``fallback``.

    Columns that the limits do not name are NULL in rows from replies.
    """
    parsed = _with_default(parse_rows(last_replies(responses), key, limits), default)
    kept = fallback.join(parsed.select("doc_id").distinct(), "doc_id", "left_anti")
    columns = [
        F.col(f.name) if f.name in parsed.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fallback.schema
    ]
    return parsed.select(*columns).unionByName(kept)


def normalise_paper(json: Column) -> Column:
    """Paper payload in its fixed shape, whatever types the reply used."""

    def text(v: Column, name: str) -> Column:
        return P.joined_text(P.field(v, name)).alias(name)

    def texts(v: Column, name: str) -> Column:
        return P.stripped_list(P.field(v, name)).alias(name)

    def shaped(body: Column) -> Column:
        meta, notes = P.field(body, "metadata"), P.field(body, "extracted_notes")
        return F.struct(
            F.struct(text(meta, "title"), texts(meta, "authors"), text(meta, "venue"), text(meta, "year")).alias(
                "metadata"
            ),
            F.struct(
                text(notes, "research_problem"),
                text(notes, "core_method"),
                texts(notes, "datasets"),
                text(notes, "experimental_setup"),
                text(notes, "main_results"),
            ).alias("extracted_notes"),
            text(body, "novelty"),
            texts(body, "strengths"),
            texts(body, "limitations"),
            text(body, "reproducibility"),
        )

    return T.let(P.parse_object(json), shaped)


def looks_like_paper(json: Column) -> Column:
    return P.has_keys(json, K.PAPER_KEYS)


def is_valid_paper(json: Column) -> Column:
    """Every field that is present has exactly its declared type."""
    kinds = {
        "text": ["metadata.title", "metadata.venue", "metadata.year", "extracted_notes.research_problem",
                 "extracted_notes.core_method", "extracted_notes.experimental_setup",
                 "extracted_notes.main_results", "novelty", "reproducibility"],
        "list": ["metadata.authors", "extracted_notes.datasets", "strengths", "limitations"],
        "object": ["metadata", "extracted_notes"],
        "objects": ["figure_analyses"],
    }
    patterns = {
        "text": "^STRING$",
        "list": "^ARRAY<(STRING|VOID)>$",
        "object": "^OBJECT",
        "objects": "^ARRAY<(OBJECT|VOID)",
    }

    inner = {
        "text": [n for n, bound in K.ANALYSIS_LIMITS.items() if not isinstance(bound, tuple)],
        "list": [n for n, bound in K.ANALYSIS_LIMITS.items() if isinstance(bound, tuple)],
    }

    def sound(figure: Column) -> Column:
        """The members of a figure analysis that are present have their types too."""
        rules = [
            F.coalesce(P.kind(P.field(figure, name)).rlike(patterns[kind]), F.lit(True))
            for kind, names in inner.items()
            for name in names
        ]
        return P.is_object(figure) & F.array_min(F.array(*rules))

    def checked(body: Column) -> Column:
        figures = P.items(P.field(body, "figure_analyses"))
        rules = [F.coalesce(F.forall(figures, sound), F.lit(True))] + [
            F.coalesce(P.kind(P.field(body, path)).rlike(patterns[kind]), F.lit(True))
            for kind, paths in kinds.items()
            for path in paths
        ]
        return body.isNotNull() & F.array_min(F.array(*rules))

    return T.let(P.parse_object(json), checked)


def paper_or_default(json: Column) -> Column:
    """The payload as a paper analysis; an invalid one counts as empty."""
    return normalise_paper(F.when(is_valid_paper(json), json).otherwise("{}"))


def complete_results(results: DataFrame, docs: DataFrame) -> DataFrame:
    """Results with the document title where theirs is empty, and paper payloads in fixed shape."""
    return titled_results(results.join(docs.select("doc_id", F.col("title").alias("doc_title")), "doc_id", "left"))


def titled_results(results: DataFrame) -> DataFrame:
    """``complete_results`` where the document title is a column ``doc_title`` of the results already."""
    data = F.coalesce("structured_data", F.lit("{}"))
    fixed = F.when(looks_like_paper(data), F.to_json(normalise_paper(data))).otherwise(data)
    return (
        results.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "doc_title"))
        .withColumn("structured_data", fixed)
        .drop("doc_title")
    )
