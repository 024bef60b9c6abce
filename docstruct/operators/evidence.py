"""Rule-based figure semantics: artifact -> evidence -> conservative analysis, one projection each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstruct import constants as K
from docstruct import labels
from docstruct.functions import text as T
from docstruct.operators.figures import FIGURE


def empty_list() -> Column:
    return F.array().cast("array<string>")


def figure_text() -> Column:
    return F.array_join(F.concat(F.array("caption"), "referenced_text_spans"), " ")


def figure_type(text: Column) -> Column:
    lowered = F.lower(text)
    (first, words), *rest = K.FIGURE_TYPE_RULES
    rule = F.when(T.contains_any(lowered, words), first)
    for name, words in rest:
        rule = rule.when(T.contains_any(lowered, words), name)
    return rule.otherwise("unknown")


def metric_axes(text: Column) -> Column:
    named = [F.when(text.rlike(rf"(?iU)\b{w}\b"), F.lit(w)) for w in K.METRIC_WORDS]
    return F.slice(F.array_compact(F.array(*named)), 1, 4)


def caption_panels(caption: Column, figure_id: Column) -> Column:
    found = F.slice(F.regexp_extract_all(caption, F.lit("(?i)" + K.PANEL_PATTERN), F.lit(1)), 1, 6)
    before, after = labels.text("panel_summary").split("{}")
    return F.transform(
        F.transform(found, F.lower),
        lambda x: F.struct(
            F.concat(figure_id, F.lit("_"), x).alias("panel_id"),
            x.alias("panel_label"),
            F.lit("unknown").alias("panel_type"),
            F.concat(F.lit(before), x, F.lit(after)).alias("summary"),
            empty_list().alias("visible_text"),
            empty_list().alias("axes"),
            empty_list().alias("legend_items"),
            F.lit(labels.text("low")).alias("confidence"),
        ),
    )


def visible_text(caption: Column, references: Column) -> Column:
    snippets = F.concat(F.array(caption), F.slice(references, 1, 2))
    shown = F.transform(snippets, lambda x: F.substring(T.strip(x), 1, 160))
    return F.slice(F.filter(shown, lambda x: x != ""), 1, 4)


def direct_evidence() -> Column:
    caption, refs, images = F.col("caption"), F.col("referenced_text_spans"), F.col("image_block_paths")
    from_caption = F.when(
        caption != "", F.concat(F.lit(labels.text("evidence_caption")), F.substring(caption, 1, 120))
    )
    from_refs = F.transform(
        F.filter(F.slice(refs, 1, 2), lambda x: T.strip(x) != ""),
        lambda x: F.concat(F.lit(labels.text("evidence_reference")), F.substring(x, 1, 120)),
    )
    note = F.when(F.size(images) > 0, labels.text("evidence_image")).when(
        F.col("page_snapshot_path") != "", labels.text("evidence_snapshot")
    )
    return F.slice(F.array_compact(F.concat(F.array(from_caption), from_refs, F.array(note))), 1, 5)


def figure_artifacts(figures: DataFrame) -> DataFrame:
    no_image = F.size("image_block_paths") == 0
    return figures.select(
        *FIGURE,
        "figure_id",
        "page_number",
        figure_type(figure_text()).alias("figure_type"),
        F.lit("noop").alias("extraction_source"),
        "page_snapshot_path",
        F.slice("image_block_paths", 1, 4).alias("image_block_paths"),
        F.get("image_block_paths", F.lit(0)).alias("crop_path"),
        visible_text(F.col("caption"), F.col("referenced_text_spans")).alias("visible_text"),
        metric_axes(figure_text()).alias("axes"),
        empty_list().alias("legend_items"),
        caption_panels(F.col("caption"), F.col("figure_id")).alias("panels"),
        direct_evidence().alias("direct_evidence"),
        F.array_compact(
            F.array(
                F.when(no_image, labels.text("uncertain_image")),
                F.when(F.size("referenced_text_spans") == 0, labels.text("uncertain_reference")),
            )
        ).alias("uncertainties"),
        F.when(no_image, labels.text("low")).otherwise(labels.text("mid")).alias("confidence"),
    )


def limit_fields(df: DataFrame, limits: dict, defaults: dict[str, str] | None = None) -> DataFrame:
    """Sanitises every field named in ``limits``: a length for text, (items, length) for lists."""
    changed: dict[str, Column] = {}
    for name, limit in limits.items():
        if name not in df.columns:
            continue
        if isinstance(limit, tuple):
            changed[name] = T.sanitize_list(F.col(name), *limit)
        elif df.schema[name].dataType.typeName() == "array":
            changed[name] = F.slice(name, 1, limit)
        else:
            changed[name] = T.sanitize_text(F.col(name), limit)
    for name in ("page_snapshot_path", "crop_path"):
        if name in changed:
            changed[name] = F.nullif(changed[name], F.lit(""))
    for name, value in (defaults or {}).items():
        if name in changed:
            changed[name] = F.coalesce(F.nullif(changed[name], F.lit("")), F.lit(value))
    return df.withColumns(changed)


def limit_artifacts(artifacts: DataFrame) -> DataFrame:
    return limit_fields(artifacts, K.ARTIFACT_LIMITS, {"confidence": labels.text("insufficient")})


def limit_evidence(evidence: DataFrame) -> DataFrame:
    return limit_fields(evidence, K.EVIDENCE_LIMITS, {"evidence_quality": labels.text("insufficient")})


def compared_items(text: Column) -> Column:
    parts = F.split(text, "(?iU)" + K.COMPARISON_PATTERN, -1)
    ends = F.array(T.sanitize_text(parts[0], 60), T.sanitize_text(F.element_at(parts, -1), 60))
    return F.when(F.size(parts) > 1, ends).otherwise(empty_list())


def last_artifacts(artifacts: DataFrame) -> DataFrame:
    """One artifact per (doc_id, figure_id): the last one in caption order."""
    fields = ["figure_type", "axes", "direct_evidence", "extraction_source", "confidence", "uncertainties"]
    return artifacts.groupBy("doc_id", "figure_id").agg(
        F.max_by(F.struct(*fields), "caption_order").alias("artifact")
    )


def figure_evidence(figures: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Evidence per figure; the join side is unique per id, so the figures do not multiply."""
    art = F.col("artifact")
    insufficient = labels.text("insufficient")
    caption_line = F.when(
        F.col("caption") != "",
        F.concat(F.lit(labels.text("caption_summary")), T.sanitize_text(F.col("caption"), 120)),
    )
    evidence = F.array_compact(
        F.concat(F.array(caption_line), F.coalesce(art["direct_evidence"], empty_list()))
    )
    quality = F.when(art.isNull(), labels.text("low")).otherwise(
        F.coalesce(F.nullif(art["confidence"], F.lit("")), F.lit(insufficient))
    )
    return figures.join(last_artifacts(artifacts), ["doc_id", "figure_id"], "left").select(
        *FIGURE,
        T.sanitize_text(F.col("figure_id"), 40).alias("figure_id"),
        T.sanitize_text(F.col("caption"), 120).alias("figure_title_or_caption"),
        "page_number",
        F.coalesce(F.nullif(art["figure_type"], F.lit("")), F.lit("unknown")).alias("figure_type"),
        compared_items(figure_text()).alias("compared_items"),
        T.sanitize_list(art["axes"], 6, 80).alias("metrics_or_axes"),
        T.sanitize_list(evidence, 6, 200).alias("direct_evidence"),
        T.sanitize_list(F.col("referenced_text_spans"), 4, 220).alias("referenced_text_spans"),
        F.coalesce(art["extraction_source"], F.lit("unknown")).alias("semantic_source"),
        quality.alias("evidence_quality"),
        T.sanitize_list(art["uncertainties"], 6, 160).alias("uncertainties"),
    )


def figure_analyses(evidence: DataFrame, reason: str | Column | None = None) -> DataFrame:
    """What can be said about each figure without a model."""
    if reason is None:
        reason = labels.text("reason_no_model")
    reason = F.lit(reason) if isinstance(reason, str) else reason
    reason = F.coalesce(
        F.nullif(T.sanitize_text(reason, 180), F.lit("")), F.lit(labels.text("reason_unparsable"))
    )
    cleaned = limit_evidence(evidence)
    kind = F.col("figure_type")
    observations = F.slice("direct_evidence", 1, 3)
    supported = (F.size("referenced_text_spans") > 0) & (F.size("direct_evidence") > 0)
    return cleaned.select(
        *FIGURE,
        "figure_id",
        F.coalesce(
            F.nullif(T.sanitize_text(F.col("figure_title_or_caption"), 80), F.lit("")),
            F.lit(labels.text("missing")),
        ).alias("figure_title_or_caption"),
        F.when(kind == "method_diagram", labels.text("focus_method"))
        .when(kind.isin("line_chart", "bar_chart", "result_figure"), labels.text("focus_result"))
        .otherwise(labels.text("focus_other"))
        .alias("experiment_focus"),
        F.slice("compared_items", 1, 4).alias("compared_items"),
        F.slice("metrics_or_axes", 1, 4).alias("metrics_or_axes"),
        F.when(F.size(observations) > 0, observations)
        .otherwise(F.array(F.lit(labels.text("fallback_observation"))))
        .alias("main_observations"),
        F.lit(labels.text("insufficient")).alias("claimed_conclusion"),
        F.concat(
            F.when(supported, labels.text("consistency_supported")).otherwise(
                labels.text("consistency_unsupported")
            ),
            reason,
        ).alias("consistency_check"),
        F.coalesce(F.nullif("evidence_quality", F.lit("")), F.lit(labels.text("insufficient"))).alias("confidence"),
    )


def key_figures(analyses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Figures of the analyses, then evidence whose (doc_id, figure_id) has no analysis."""
    fields = ["doc_id", "caption_order", "figure_id", "figure_title_or_caption"]
    rest = evidence.join(analyses.select("doc_id", "figure_id").distinct(), ["doc_id", "figure_id"], "left_anti")
    return (
        analyses.select(*fields, F.lit(0).alias("origin"))
        .unionByName(rest.select(*fields, F.lit(1).alias("origin")))
    )


def extract_semantics(figures: DataFrame, extractor: Callable, schema) -> DataFrame:
    """Runs a user's extractor (pandas batch of figures -> pandas batch of artifacts) over all figures."""

    def run(batches):
        for batch in batches:
            yield extractor(batch)

    return figures.mapInPandas(run, schema=schema)
