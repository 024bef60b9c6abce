"""Markdown and JSON reports as columns: folds per document, then string building per row.

Absent values stay NULL until here; ``shown`` puts the missing marker in their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstruct import labels
from docstruct.functions import payload as P
from docstruct.functions import text as T
from docstruct.operators.figures import bullets
from docstruct.operators.responses import is_valid_paper, looks_like_paper, normalise_paper, paper_or_default

MISSING = labels.text("missing")
#: Of an abstract or an introduction that stands for the background.
OPENING_CHARS = 220


def shown(col: Column, otherwise: str = MISSING) -> Column:
    return F.coalesce(F.nullif(col.cast("string"), F.lit("")), F.lit(otherwise))


def plain(col: Column) -> Column:
    """Text without Markdown marks, or the missing marker."""
    return F.coalesce(T.strip_markdown(col), F.lit(MISSING))


def fill(template: str, *values: Column) -> Column:
    """``template`` with its ``{}`` places taken by columns."""
    parts = template.split("{}")
    pieces = [F.lit(parts[0])]
    for value, rest in zip(values, parts[1:], strict=True):
        pieces += [value, F.lit(rest)]
    return F.concat(*pieces)


def joined_or_missing(items: Column) -> Column:
    return shown(F.array_join(items, ", "))


def bullet_list(items: Column) -> Column:
    """Cleaned items as bullets; the bare marker when none is left."""
    lines = F.transform(T.clean_list(items), lambda x: F.concat(F.lit("- "), x))
    return shown(F.array_join(lines, "\n"))


def field_line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"- **{name}：** "), value)


def fold(df: DataFrame, order: list[str], line: Column, separator: str, name: str) -> DataFrame:
    """Lines of each document joined in order; NULL lines are left out."""
    picked = F.when(line.isNotNull(), F.struct(*order, line.alias("line")))
    return df.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(picked))["line"], separator).alias(name))


# --- parsed structure -----------------------------------------------------------------------


def parsed_markdown(structure: DataFrame, sections: DataFrame, figures: DataFrame) -> DataFrame:
    """Markdown view of the recovered structure: metadata, figures, sections."""
    names, parts = labels.report("parsed_fields"), labels.report("figure_fields")
    entry = F.concat_ws(
        "\n",
        F.lit(""),
        F.concat(F.lit("### "), shown(F.col("figure_id"), labels.text("unnumbered_figure"))),
        field_line(parts[0], shown(F.col("caption"))),
        field_line(parts[1], shown(F.col("page_number"))),
        field_line(parts[2], shown(F.col("page_snapshot_path"), labels.text("not_provided"))),
        F.lit(f"- **{parts[3]}：**"),
        bullets(F.col("referenced_text_spans"), MISSING),
    )
    figure_text = fold(figures, ["caption_order"], entry, "\n", "figure_text")
    title = T.label(F.col("section_key"), labels.SECTION_LABELS[labels.DEFAULT_LOCALE])
    body = F.concat(F.lit("\n## "), title, F.lit("\n"), shown(F.col("content")))
    listed = sections.filter(~F.col("section_key").isin("title", "figures"))
    section_text = fold(listed, ["position"], body, "\n", "section_text")
    values = [
        shown(F.col("title")),
        joined_or_missing(F.col("authors")),
        shown(F.col("doi")),
        shown(F.col("venue")),
        shown(F.col("year")),
        shown(F.col("page_count")),
        F.col("figure_count").cast("string"),
    ]
    text = F.concat_ws(
        "\n",
        F.lit(labels.report("parsed_title")),
        F.lit(""),
        F.lit(labels.report("parsed_basics")),
        *[field_line(n, v) for n, v in zip(names, values, strict=True)],
        F.when(F.col("figure_text").isNotNull(), F.lit("\n" + labels.report("parsed_figures"))),
        F.col("figure_text"),
        F.col("section_text"),
    )
    return (
        structure.join(figure_text, "doc_id", "left")
        .join(section_text, "doc_id", "left")
        .select("doc_id", F.concat(T.strip(text), F.lit("\n")).alias("markdown"))
    )


# --- figure parts -------------------------------------------------------------------------------


def figure_name() -> Column:
    return plain(shown(F.col("figure_id"), labels.text("unnumbered_figure")))


def figure_parts(analyses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per document: the four figure texts of a research report."""
    key_line = fill(labels.report("figure_line"), figure_name(), plain(F.col("figure_title_or_caption")))
    compared = F.array_join(T.clean_list(F.col("compared_items")), ", ")
    observation = T.strip_markdown(F.get("main_observations", F.lit(0)))
    baseline = F.when(
        (compared != "") & observation.isNotNull(),
        fill(labels.report("baseline_line"), figure_name(), compared, observation),
    )
    conclusion = F.when(
        F.col("claimed_conclusion") != "",
        fill(labels.report("figure_line"), figure_name(), plain(F.col("claimed_conclusion"))),
    )
    check = fill(
        labels.report("consistency_line"),
        figure_name(),
        plain(F.col("consistency_check")),
        plain(F.col("confidence")),
    )
    order = ["caption_order"]
    named = analyses.select("doc_id", "figure_id").distinct()
    rest = evidence.join(named, ["doc_id", "figure_id"], "left_anti")
    shared = ["doc_id", "caption_order", "figure_id", "figure_title_or_caption"]
    keyed = analyses.select(*shared, F.lit(0).alias("origin")).unionByName(
        rest.select(*shared, F.lit(1).alias("origin"))
    )
    own = analyses.groupBy("doc_id").agg(
        *[
            F.array_join(
                F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct(*order, line.alias("line")))))["line"],
                "\n",
            ).alias(name)
            for name, line in (("baselines", baseline), ("conclusions", conclusion), ("checks", check))
        ]
    )
    return fold(keyed, ["origin", "caption_order"], key_line, "\n", "key_figures").join(own, "doc_id", "left")


def evidence_details(evidence: DataFrame) -> DataFrame:
    """Per document: one block per figure with its evidence."""
    names = labels.report("evidence_fields")
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("### "), shown(F.col("figure_id"), labels.text("unnumbered_figure"))),
        field_line(names[0], shown(F.col("figure_title_or_caption"))),
        field_line(names[1], shown(F.col("figure_type"))),
        field_line(names[2], joined_or_missing(F.col("metrics_or_axes"))),
        field_line(names[3], shown(F.col("evidence_quality"))),
        F.lit(f"- **{names[4]}：**"),
        bullets(F.col("direct_evidence"), MISSING),
    )
    return fold(evidence, ["caption_order"], block, "\n\n", "evidence_text")


def analysis_details(analyses: DataFrame) -> DataFrame:
    """Per document: one block per figure with its analysis."""
    names = labels.report("analysis_fields")
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("### "), shown(F.col("figure_id"), labels.text("unnumbered_figure"))),
        field_line(names[0], shown(F.col("figure_title_or_caption"))),
        field_line(names[1], shown(F.col("experiment_focus"))),
        field_line(names[2], joined_or_missing(F.col("compared_items"))),
        field_line(names[3], joined_or_missing(F.col("metrics_or_axes"))),
        F.lit(f"- **{names[4]}：**"),
        bullets(F.col("main_observations"), MISSING),
        field_line(names[5], shown(F.col("claimed_conclusion"))),
        field_line(names[6], shown(F.col("confidence"))),
    )
    return fold(analyses, ["caption_order"], block, "\n\n", "analysis_text")


# --- research report -----------------------------------------------------------------------------


def summary_quote(paper: Column, summary: Column) -> Column:
    notes = paper["extracted_notes"]
    problem, whole = T.strip_markdown(notes["research_problem"]), T.strip_markdown(summary)
    first = F.when(problem.isNull() & whole.isNotNull(), fill(labels.report("summary_fallback"), whole)).otherwise(
        fill(labels.report("summary_problem"), plain(notes["research_problem"]))
    )
    return F.concat_ws(
        "\n",
        first,
        fill(labels.report("summary_method"), plain(notes["core_method"])),
        fill(labels.report("summary_results"), plain(notes["main_results"])),
    )


def background(key_points: Column, abstract: Column, introduction: Column) -> Column:
    """First usable of: key points, start of the abstract, start of the introduction."""
    starts = F.array(F.substring(abstract, 1, OPENING_CHARS), F.substring(introduction, 1, OPENING_CHARS))
    return F.coalesce(F.get(T.clean_list(F.concat(key_points, starts)), F.lit(0)), F.lit(MISSING))


def experimental_setup(paper: Column) -> Column:
    setup = T.strip_markdown(paper["extracted_notes"]["experimental_setup"])
    datasets = F.nullif(F.array_join(T.clean_list(paper["extracted_notes"]["datasets"]), ", "), F.lit(""))
    return shown(F.concat_ws("\n\n", setup, fill(labels.report("datasets_line"), datasets)))


def applicable_scenario(paper: Column, venue: Column) -> Column:
    datasets = F.nullif(F.array_join(T.clean_list(paper["extracted_notes"]["datasets"]), ", "), F.lit(""))
    place = T.strip_markdown(F.coalesce(F.nullif(paper["metadata"]["venue"], F.lit("")), venue))
    return F.coalesce(
        fill(labels.report("scenario_datasets"), datasets),
        fill(labels.report("scenario_venue"), place),
        F.lit(MISSING),
    )


def inspiration(paper: Column, key_points: Column) -> Column:
    first = F.get(T.clean_list(key_points), F.lit(0))
    return F.coalesce(T.strip_markdown(paper["novelty"]), first, F.lit(MISSING))


def research_reports(
    structure: DataFrame, sections: DataFrame, results: DataFrame, analyses: DataFrame, evidence: DataFrame
) -> DataFrame:
    """Nine-chapter report per document: (doc_id, markdown_report).

    ``results``: (doc_id, summary, key_points, structured_data) from the text roles; a document
    without a result is reported from its structure alone.
    """
    # Only the starts that ``background`` shows are moved.
    start = F.substring("content", 1, OPENING_CHARS)
    openings = sections.filter(F.col("section_key").isin("abstract", "introduction")).groupBy("doc_id").agg(
        F.max(F.when(F.col("section_key") == "abstract", start)).alias("opening_abstract"),
        F.max(F.when(F.col("section_key") == "introduction", start)).alias("opening_introduction"),
    )
    none = F.array().cast("array<string>")
    rows = (
        structure.select("doc_id", "title", "authors", "venue", "year")
        .join(results.select("doc_id", "summary", "key_points", "structured_data"), "doc_id", "left")
        .join(openings, "doc_id", "left")
        .join(figure_parts(analyses, evidence), "doc_id", "left")
        .withColumn("paper", paper_or_default(F.coalesce("structured_data", F.lit("{}"))))
        .withColumn("key_points", F.coalesce("key_points", none))
    )
    paper, notes = F.col("paper"), F.col("paper.extracted_notes")
    meta = F.col("paper.metadata")
    own_authors = F.when(F.size(meta["authors"]) > 0, meta["authors"]).otherwise(F.col("authors"))
    basics = [
        plain(F.coalesce(F.nullif(meta["title"], F.lit("")), "title")),
        joined_or_missing(T.clean_list(own_authors)),
        plain(F.coalesce(F.nullif(meta["venue"], F.lit("")), "venue")),
        plain(F.coalesce(F.nullif(meta["year"], F.lit("")), "year")),
    ]
    names = labels.report("research_basics")
    results_text = T.strip_markdown(notes["main_results"])
    bodies = [
        F.concat_ws("\n", *[F.concat(F.lit(f"- {n}："), v) for n, v in zip(names, basics, strict=True)]),
        summary_quote(paper, F.col("summary")),
        background(F.col("key_points"), F.col("opening_abstract"), F.col("opening_introduction")),
        plain(notes["research_problem"]),
        plain(notes["core_method"]),
        bullet_list(F.col("key_points")),
        plain(paper["novelty"]),
        experimental_setup(paper),
        plain(notes["main_results"]),
        shown(F.col("baselines")),
        F.coalesce(results_text, plain(F.col("summary"))),
        shown(F.col("key_figures")),
        shown(F.col("conclusions")),
        shown(F.col("checks")),
        bullet_list(paper["strengths"]),
        bullet_list(paper["limitations"]),
        plain(paper["reproducibility"]),
        applicable_scenario(paper, F.col("venue")),
        inspiration(paper, F.col("key_points")),
        plain(F.col("summary")),
    ]
    pieces, at = [F.lit(labels.report("research_title"))], iter(bodies)
    for chapter, parts in labels.report("research_chapters"):
        if not parts:
            pieces.append(F.concat(F.lit(f"## {chapter}\n"), next(at)))
        for i, part in enumerate(parts):
            head = f"## {chapter}\n### {part}\n" if i == 0 else f"### {part}\n"
            pieces.append(F.concat(F.lit(head), next(at)))
    return rows.select("doc_id", F.concat(F.concat_ws("\n\n", *pieces), F.lit("\n")).alias("markdown_report"))


# --- general and paper reports ---------------------------------------------------------------------


EMPTY_JSON = ['""', "null", "false", "0", "0.0", "[]", "{}"]


def _quoted(text: Column) -> Column:
    """A string in quotes: single ones, unless it has such and no double ones; backslashes and line feeds escaped."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    single = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(single)


def _listed_entry(v: Column) -> Column:
    return F.when(P.kind(v) == "STRING", _quoted(P.as_text(v))).otherwise(_plain_entry(v))


def _plain_entry(v: Column) -> Column:
    """Scalars as the report's rules name them; what is nested deeper stays JSON."""
    return (
        F.when(v.isNull() | (P.kind(v) == "VOID"), "None")
        .when(P.kind(v) == "BOOLEAN", F.initcap(P.as_text(v)))
        .when(P.is_list(v) | P.is_object(v), F.to_json(v))
        .otherwise(P.as_text(v))
    )


def shown_entry(v: Column) -> Column:
    """An entry as text: lists in brackets with their strings quoted."""
    inside = F.array_join(F.transform(P.items(v), _listed_entry), ", ")
    return F.when(P.is_list(v), F.concat(F.lit("["), inside, F.lit("]"))).otherwise(_plain_entry(v))


def rendered_value(v: Column) -> Column:
    """A value as text; NULL for what counts as empty: also zero, false and empty lists and objects."""
    return F.when(v.isNotNull() & ~F.to_json(v).isin(*EMPTY_JSON), shown_entry(v))


def structured_blocks(json: Column) -> Column:
    """Payload entries in order, each under its label and shown by the shape of its value."""
    names = labels.FIELD_LABELS[labels.DEFAULT_LOCALE]

    def block(entry: Column) -> Column:
        value = entry["value"]
        listed = bullets(F.transform(P.items(value), shown_entry), MISSING)
        nested = F.transform(
            P.object_entries(value, F.to_json(value)),
            lambda c: F.concat(
                F.lit("- **"), T.label(c["name"], names), F.lit("：** "), shown(rendered_value(c["value"]))
            ),
        )
        members = F.when(F.size(nested) > 0, F.array_join(nested, "\n")).otherwise(f"- {MISSING}")
        body = F.when(P.is_list(value), listed).when(P.is_object(value), members).otherwise(shown(rendered_value(value)))
        return F.concat(F.lit("### "), T.label(entry["name"], names), F.lit("\n"), body)

    blocks = F.transform(P.object_entries(P.parse_object(json), json), block)
    return shown(F.array_join(blocks, "\n\n"))


def general_report(report_title: str) -> Column:
    heads = labels.report("general_chapters")
    bodies = [
        shown(F.col("title")),
        shown(F.col("summary")),
        bullets(F.col("key_points"), MISSING),
        bullets(F.col("limitations"), MISSING),
        structured_blocks(F.col("structured_data")),
    ]
    chapters = [F.concat(F.lit(f"## {h}\n"), b) for h, b in zip(heads, bodies, strict=True)]
    return F.concat(F.concat_ws("\n\n", F.lit(f"# {report_title}"), *chapters), F.lit("\n"))


def paper_report() -> Column:
    """Paper layout from the columns ``title`` and ``paper`` (fixed shape)."""
    paper = F.col("paper")
    meta, notes = paper["metadata"], paper["extracted_notes"]
    values = [
        shown(F.coalesce(F.nullif(meta["title"], F.lit("")), "title")),
        joined_or_missing(meta["authors"]),
        shown(meta["venue"]),
        shown(meta["year"]),
    ]
    basics = [field_line(n, v) for n, v in zip(labels.report("paper_basics"), values, strict=True)]
    bodies = [
        F.concat_ws("\n", *basics),
        shown(notes["research_problem"]),
        shown(notes["core_method"]),
        joined_or_missing(notes["datasets"]),
        shown(notes["experimental_setup"]),
        shown(notes["main_results"]),
        shown(paper["novelty"]),
        bullets(paper["strengths"], MISSING),
        bullets(paper["limitations"], MISSING),
        shown(paper["reproducibility"]),
    ]
    heads = labels.report("paper_chapters")
    chapters = [F.concat(F.lit(f"## {h}\n"), b) for h, b in zip(heads, bodies, strict=True)]
    return F.concat(F.concat_ws("\n\n", F.lit(labels.report("paper_title")), *chapters), F.lit("\n"))


def result_reports(results: DataFrame, report_title: str) -> DataFrame:
    """Results with ``markdown_report`` filled: the paper layout for valid paper payloads, else the general one."""
    data = F.col("structured_data")
    as_paper = looks_like_paper(data) & F.coalesce(is_valid_paper(data), F.lit(False))
    rendered = F.when(F.col("paper").isNotNull(), paper_report()).otherwise(general_report(report_title))
    return (
        results.withColumn("paper", F.when(as_paper, normalise_paper(data)))
        .withColumn("markdown_report", F.coalesce(F.nullif("markdown_report", F.lit("")), rendered))
        .drop("paper")
    )


# --- JSON result ------------------------------------------------------------------------------------


def _listed(df: DataFrame, name: str) -> DataFrame:
    fields = [c for c in df.columns if c not in ("doc_id", "caption_order")]
    rows = F.array_sort(F.collect_list(F.struct("caption_order", F.to_json(F.struct(*fields)).alias("j"))))
    return df.groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(rows["j"], ","), F.lit("]")).alias(name))


def source_structure(parser_kind: str | Column = "pdf") -> Column:
    kind = F.lit(parser_kind) if isinstance(parser_kind, str) else parser_kind
    return F.struct(
        kind.alias("parser_kind"), "page_count", F.coalesce("doi", F.lit("")).alias("doi"),
        "section_order", "figure_count",
    )


def json_text(col: Column) -> Column:
    """A string as a JSON string, quotes and controls escaped; NULL for NULL."""
    whole = F.to_json(F.array(col))
    return F.when(col.isNotNull(), F.substr(whole, F.lit(2), F.length(whole) - 2))


def json_member(name: Column, value: Column) -> Column:
    return F.concat(json_text(name), F.lit(":"), value)


def filled_metadata(meta: Column) -> Column:
    """JSON of the payload's metadata: all its entries, those that are empty or missing filled from the document."""
    fills = {
        "authors": F.when(F.size("authors") > 0, F.to_json("authors")),
        **{n: json_text(F.nullif(F.col(n), F.lit(""))) for n in ("title", "venue", "year")},
    }
    known = F.create_map(*[part for n, v in fills.items() for part in (F.lit(n), v)])
    def kept(entry: Column) -> Column:
        value = F.coalesce(F.to_json(entry["value"]), F.lit("null"))
        fill = F.element_at(known, entry["name"])
        return json_member(entry["name"], F.when(value.isin(*EMPTY_JSON), F.coalesce(fill, value)).otherwise(value))

    entries = F.when(P.is_object(meta), P.object_entries(meta, F.to_json(meta)))
    entries = F.coalesce(entries, F.array().cast("array<struct<name:string,value:variant>>"))
    names = F.transform(entries, lambda e: e["name"])
    new = [F.when(~F.array_contains(names, n), json_member(F.lit(n), v)) for n, v in fills.items()]
    members = F.concat(F.transform(entries, kept), F.array_compact(F.array(*new)))
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def merged_results(
    structure: DataFrame,
    focus: DataFrame,
    results: DataFrame,
    artifacts: DataFrame,
    evidence: DataFrame,
    analyses: DataFrame,
) -> DataFrame:
    """(doc_id, structured_data): the model payload with metadata filled up and the figure tables added.

    ``structure`` may name the ``parser_kind`` of each document; without it all are block documents.
    """
    kind = F.col("parser_kind") if "parser_kind" in structure.columns else "pdf"
    paper, meta = F.col("payload"), F.col("payload_metadata")
    joined = (
        structure.join(results.select("doc_id", "structured_data"), "doc_id", "left")
        .join(focus.select("doc_id", "selected_sections"), "doc_id", "left")
        .join(_listed(artifacts, "semantic_artifacts"), "doc_id", "left")
        .join(_listed(evidence, "figure_evidence"), "doc_id", "left")
        .join(_listed(analyses, "figure_analyses"), "doc_id", "left")
        .withColumn("structured_data", F.coalesce("structured_data", F.lit("{}")))
        .withColumn("payload", P.parse_object(F.col("structured_data")))
        .withColumn("payload_metadata", P.field(F.col("payload"), "metadata"))
    )
    added = ["metadata", "semantic_artifacts", "figure_evidence", "figure_analyses", "selected_sections", "source_structure"]
    kept = F.transform(
        F.filter(
            P.object_entries(paper, F.col("structured_data")), lambda e: ~e["name"].isin(*added)
        ),
        lambda e: json_member(e["name"], F.to_json(e["value"])),
    )

    def member(name: str, json: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), F.coalesce(json, F.lit("[]")))

    tail = [
        member("metadata", filled_metadata(meta)),
        member("semantic_artifacts", F.col("semantic_artifacts")),
        member("figure_evidence", F.col("figure_evidence")),
        member("figure_analyses", F.col("figure_analyses")),
        member("selected_sections", F.to_json("selected_sections")),
        member("source_structure", F.to_json(source_structure(kind), {"ignoreNullFields": "false"})),
    ]
    body = F.array_join(F.concat(F.coalesce(kept, F.array().cast("array<string>")), F.array(*tail)), ",")
    return joined.select("doc_id", F.concat(F.lit("{"), body, F.lit("}")).alias("structured_data"))
