"""Figure captions, their references and images, and the ranking of figures.

``figure_id`` repeats inside a document (a body sentence that starts with "Figure 1" is a caption too),
so ``(doc_id, caption_order)`` is the key everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstruct import constants as K
from docstruct import labels
from docstruct.functions import text as T
from docstruct.operators.blocks import PAGE

FIGURE = ["doc_id", "caption_order"]


def figure_rows(annotated: DataFrame) -> DataFrame:
    """The rows and columns that figures are made of: captions, what may mention one and what stands beside one."""
    mentions = ~F.col("is_noise") & F.lower("text").contains("fig")
    return annotated.filter(F.col("caption_order").isNotNull() | F.col("near_caption") | mentions).select(
        *PAGE, "order_index", "block_id", "text", "text_pos", "figure_id", "caption_order", "near_caption", "is_noise"
    )


def extract_captions(annotated: DataFrame) -> DataFrame:
    """One row per caption run; a run lies on one page, where its rows already are."""
    rows = annotated.filter(F.col("caption_order").isNotNull())
    folded = rows.groupBy(*PAGE, "caption_order").agg(
        F.array_sort(F.collect_list(F.struct("order_index", "text", "block_id", "figure_id", "text_pos"))).alias("b")
    )
    first = F.col("b")[0]
    return folded.select(
        *FIGURE,
        first["figure_id"].alias("figure_id"),
        T.clean_text(F.array_join(F.col("b.text"), " ")).alias("caption"),
        "page_number",
        F.col("b.block_id").alias("caption_block_ids"),
        first["text_pos"].alias("start_pos"),
    )


def mention_candidates(annotated: DataFrame) -> DataFrame:
    """Per document and figure number: the few earliest blocks that can serve any of its captions.

    A caption takes the first four mentions outside its own run. Keeping four per run and then the
    first eight loses none of them, whichever run is excluded, and bounds the group however often a
    number is mentioned. Both cuts are rank filters, which Spark applies before it shuffles.
    """
    mentions = (
        annotated.filter(~F.col("is_noise") & F.lower("text").contains("fig"))
        .withColumn("run", F.coalesce("caption_order", F.lit(-1)))
        .select(
            "doc_id", "order_index", "block_id", "text", "run",
            F.explode(T.figure_mentions(F.col("text"))).alias("suffix"),
        )
    )
    in_run = Window.partitionBy("doc_id", "suffix", "run").orderBy("order_index")
    in_doc = Window.partitionBy("doc_id", "suffix").orderBy("order_index")
    return (
        mentions.withColumn("nth", F.row_number().over(in_run))
        .filter(F.col("nth") <= K.FIGURE_REFERENCES)
        .withColumn("nth", F.row_number().over(in_doc))
        .filter(F.col("nth") <= 2 * K.FIGURE_REFERENCES)
        .groupBy("doc_id", "suffix")
        .agg(F.array_sort(F.collect_list(F.struct("order_index", "run", "text", "block_id"))).alias("mentions"))
    )


def neighbour_references(annotated: DataFrame, captions: DataFrame) -> DataFrame:
    """Long blocks right before and after each caption start, for captions that nothing mentions.

    Four positions per caption are looked up, whether they turn out to be needed or not: that is less
    work than finding out first. Only blocks near some caption or at a page edge take part.
    """
    offsets = F.array(*[F.lit(o) for o in K.NEIGHBOUR_OFFSETS])
    wanted = captions.select(*FIGURE, "start_pos", F.posexplode(offsets).alias("rank", "offset")).select(
        *FIGURE, "rank", (F.col("start_pos") + F.col("offset")).alias("text_pos")
    )
    near = annotated.filter(
        F.col("near_caption") & ~F.col("is_noise") & (F.length("text") >= K.NEIGHBOUR_MIN_CHARS)
    ).select("doc_id", "text_pos", "text", "block_id", F.col("caption_order").alias("run"))
    hits = wanted.join(near, ["doc_id", "text_pos"]).filter(~F.col("run").eqNullSafe(F.col("caption_order")))
    return (
        hits.groupBy(*FIGURE)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "text", "block_id"))).alias("near"))
        .withColumn("near", F.slice("near", 1, K.NEIGHBOUR_REFERENCES))
    )


def link_references(annotated: DataFrame, captions: DataFrame) -> DataFrame:
    suffix = F.regexp_replace("figure_id", "^Figure ", "")
    linked = captions.withColumn("suffix", suffix).join(
        mention_candidates(annotated), ["doc_id", "suffix"], "left"
    )
    others = F.filter("mentions", lambda m: m["run"] != F.col("caption_order"))
    linked = linked.withColumn("refs", F.slice(others, 1, K.FIGURE_REFERENCES)).drop("suffix", "mentions")
    has_refs = F.coalesce(F.size("refs") > 0, F.lit(False))
    near = neighbour_references(annotated, captions)
    empty = F.array().cast("array<string>")

    def chosen(field: str) -> Column:
        return F.when(has_refs, F.col(f"refs.{field}")).otherwise(F.coalesce(F.col(f"near.{field}"), empty))

    return linked.join(near, FIGURE, "left").select(
        *[c for c in linked.columns if c != "refs"],
        chosen("text").alias("referenced_text_spans"),
        chosen("block_id").alias("reference_block_ids"),
    )


def page_images(blocks: DataFrame) -> DataFrame:
    first = Window.partitionBy(*PAGE).orderBy("order_index")
    return (
        blocks.filter((F.col("block_type") == "image") & (F.col("image_path") != ""))
        .select(*PAGE, "image_path", F.row_number().over(first).alias("nth"))
        .filter(F.col("nth") <= K.FIGURE_IMAGES)
        .groupBy(*PAGE)
        .agg(F.array_sort(F.collect_list(F.struct("nth", "image_path")))["image_path"].alias("image_block_paths"))
    )


def link_images(blocks: DataFrame, figures: DataFrame) -> DataFrame:
    """Adds up to four images of the caption's page; tables without images need no join."""
    empty = F.array().cast("array<string>")
    if "image_path" not in blocks.columns:
        return figures.withColumn("image_block_paths", empty)
    linked = figures.join(page_images(blocks), PAGE, "left")
    return linked.withColumn("image_block_paths", F.coalesce("image_block_paths", empty))


def link_snapshots(figures: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Adds ``page_snapshot_path`` from a table (doc_id, page_number, page_snapshot_path), if there is one."""
    if pages is None:
        return figures.withColumn("page_snapshot_path", F.lit(None).cast("string"))
    return figures.join(pages.select(*PAGE, "page_snapshot_path"), PAGE, "left")


def extract_figures(
    blocks: DataFrame, annotated: DataFrame, snapshots: DataFrame | None = None
) -> DataFrame:
    figures = link_references(annotated, extract_captions(annotated))
    figures = link_snapshots(link_images(blocks, figures), snapshots)
    return figures.select(
        *FIGURE, "figure_id", "caption", "page_number", "caption_block_ids", "reference_block_ids",
        "referenced_text_spans", "image_block_paths", "page_snapshot_path",
    )


def bullets(items: Column, otherwise: str) -> Column:
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(items) > 0, lines).otherwise("- " + otherwise)


def figure_entry() -> Column:
    missing = labels.text("missing")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("### "), F.coalesce(F.nullif("figure_id", F.lit("")), F.lit(labels.text("unnumbered_figure")))),
        F.coalesce(F.nullif("caption", F.lit("")), F.lit(missing)),
        F.lit(""),
        F.lit(labels.text("body_references")),
        bullets(F.col("referenced_text_spans"), missing),
    )


def figures_sections(figures: DataFrame) -> DataFrame:
    """The ``figures`` section of every document that has figures."""
    entries = F.array_sort(F.collect_list(F.struct("caption_order", figure_entry().alias("entry"))))
    return (
        figures.groupBy("doc_id")
        .agg(F.array_join(entries["entry"], "\n\n").alias("content"))
        .select(
            "doc_id",
            F.lit("figures").alias("section_key"),
            "content",
            F.lit(0).alias("place"),
            F.lit("figures").alias("source"),
        )
    )


def rank_figures(figures: DataFrame, context: DataFrame | None) -> DataFrame:
    """Adds ``score`` and ``rank`` and keeps the four best figures of each document.

    ``context`` (doc_id, context_text) is the text in which a figure number must occur; None means that
    the ``figures`` section is part of it, which names every figure.
    """
    named = F.lit(True)
    if context is not None:
        figures = figures.join(context, "doc_id", "left")
        named = F.lower("context_text").contains(F.lower("figure_id"))
    score = (
        F.when(named & (F.col("figure_id") != ""), 2).otherwise(0)
        + F.when(F.size("referenced_text_spans") > 0, 2).otherwise(0)
        + F.when(F.col("caption").rlike("(?i)" + K.RESULT_CAPTION_PATTERN), 1).otherwise(0)
    )
    best = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "caption_order")
    ranked = figures.withColumn("score", score).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= K.FIGURES_SELECTED).drop("context_text")


def rank_context(sections: DataFrame, with_figures: bool = False) -> DataFrame:
    keys = [k for k in K.RANK_CONTEXT_SECTIONS if with_figures or k != "figures"]
    return (
        sections.filter(F.col("section_key").isin(*keys))
        .groupBy("doc_id")
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("position", "content")))["content"], "\n").alias("context_text"))
    )
