"""Block flags and positions: the row-level facts that every structure operator reads.

Both page rules (one heading per key and page, caption runs end with the page) look at one page only,
so a page is the scan unit: rows are distributed by ``(doc_id, page_number)`` and a document with very
many blocks is spread over its pages. What must run through a whole document (positions and counters)
is a count, so it is added up once per page and carried over as an offset per page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstruct import constants as K
from docstruct.functions import text as T

DOC = ["doc_id"]
PAGE = ["doc_id", "page_number"]


def text_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.filter((F.col("block_type") == "text") & (F.col("text") != ""))


def flag_blocks(blocks: DataFrame) -> DataFrame:
    """Text blocks with each line predicate evaluated once (narrow: no shuffle)."""
    text, lowered = F.col("text"), F.col("lowered")
    words = [w for ws in K.FALLBACK_KEYWORDS.values() for w in ws]
    # The lower-cased text is a column of its own so that it is computed once for all predicates.
    rows = text_blocks(blocks).withColumn("lowered", F.lower(text))
    return rows.withColumns(
        {
            "is_noise": T.is_noise(text, lowered),
            "is_citation": T.is_citation_line(text, lowered),
            "is_venue": T.is_venue_line(text, lowered),
            "is_author": T.is_author_line(text),
            "heading_key": T.heading_key(text, lowered),
            "figure_id": T.figure_id(text),
            "closes": T.closes_sentence(text),
            "has_keyword": T.contains_any(lowered, words),
            "has_words": text.rlike(r"(?U)[^\s\x00-\x1f\x7f]"),
            "is_short": F.length(text) < K.CAPTION_MIN_CHARS,
        }
    ).drop("lowered")


def page_offsets(flagged: DataFrame) -> DataFrame:
    """One row per page: its own counts and how much of each lies on earlier pages of the document."""
    per_page = flagged.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("page_texts"),
        F.size(F.collect_set("heading_key")).cast("bigint").alias("page_headings"),
        F.count_if("closes").alias("page_closes"),
        F.count("figure_id").alias("page_captions"),
    )
    pages = Window.partitionBy(*DOC).orderBy("page_number")
    before = pages.rowsBetween(Window.unboundedPreceding, -1)

    def carried(name: str):
        return F.coalesce(F.sum(name).over(before), F.lit(0))

    def beside(step):
        """The next page that way has a caption, or it is a single block and the one after it has."""
        near, far = step("page_captions", 1).over(pages) > 0, step("page_captions", 2).over(pages) > 0
        return F.coalesce(near, F.lit(False)) | F.coalesce((step("page_texts", 1).over(pages) == 1) & far, F.lit(False))

    return per_page.select(
        *PAGE,
        "page_texts",
        carried("page_texts").alias("texts_before"),
        carried("page_headings").alias("headings_before"),
        carried("page_closes").alias("closes_before"),
        carried("page_captions").alias("captions_before"),
        beside(F.lag).alias("caption_behind"),
        beside(F.lead).alias("caption_ahead"),
    )


def annotate_blocks(flagged: DataFrame) -> DataFrame:
    """Adds ``text_pos``, ``is_heading``, ``section_seq``, ``run_id``, ``caption_order``, ``near_caption``.

    * ``is_heading``: first heading of its key on the page; a later one is body text.
    * ``section_seq``: how many headings are at or before the block (0 = before the first).
    * ``run_id``: how many sentence-closing blocks come before; blocks of one run share sentences.
    * ``caption_order``: number of the caption run that the block belongs to, else NULL.
    * ``near_caption``: the block can lie within two blocks of the start of a caption.
    * ``run_matters``: its run has a keyword on this page or can go on on another one.

    Only flags are read, not the text: where no text is asked for, none moves.
    """
    page = Window.partitionBy(*PAGE).orderBy("order_index")
    earlier = page.rowsBetween(Window.unboundedPreceding, -1)
    so_far = page.rowsBetween(Window.unboundedPreceding, 0)

    starts = F.col("figure_id").isNotNull()
    heading = F.col("heading_key").isNotNull()
    first_of_key = heading & ~F.array_contains(F.col("seen_keys"), F.col("heading_key"))
    stops_run = (
        starts
        | heading
        | F.col("is_short")
        | F.col("last_y0").isNull()
        | (F.col("y0") - F.col("last_y0") > K.CAPTION_MAX_GAP)
    )
    run_head = F.when(~F.col("is_noise") & stops_run, F.struct("order_index", starts.alias("is_caption")))
    local = (
        flagged.withColumns(
            {
                "page_pos": F.row_number().over(page) - 1,
                "seen_keys": F.collect_set("heading_key").over(earlier),
                "last_y0": F.last(F.when(~F.col("is_noise"), F.col("y0")), ignorenulls=True).over(earlier),
                "page_close": F.coalesce(F.count_if("closes").over(earlier), F.lit(0)),
                "page_caption": F.count("figure_id").over(so_far),
                "caption_close_by": F.max(starts).over(page.rowsBetween(-2, 2)),
            }
        )
        .withColumns({"is_heading": F.coalesce(first_of_key, F.lit(False)), "run_head": run_head})
        .withColumns(
            {
                "page_heading": F.count_if("is_heading").over(so_far),
                "run_head": F.last("run_head", ignorenulls=True).over(so_far),
            }
        )
    )
    in_caption = ~F.col("is_noise") & F.coalesce(F.col("run_head.is_caption"), F.lit(False))
    over_edge = ((F.col("page_pos") < 2) & F.col("caption_behind")) | (
        (F.col("page_pos") >= F.col("page_texts") - 2) & F.col("caption_ahead")
    )
    matters = F.max(F.col("has_keyword") | F.col("at_page_edge")).over(Window.partitionBy(*PAGE, "run_id"))
    return (
        local.join(page_offsets(flagged), PAGE)
        .withColumns(
            {
                "text_pos": F.col("texts_before") + F.col("page_pos"),
                "section_seq": F.col("headings_before") + F.col("page_heading"),
                "run_id": F.col("closes_before") + F.col("page_close"),
                "caption_order": F.when(
                    in_caption, F.col("captions_before") + F.col("page_caption") - 1
                ).cast("int"),
                "near_caption": F.col("caption_close_by") | over_edge,
                "at_page_edge": (F.col("page_pos") == 0) | (F.col("page_pos") == F.col("page_texts") - 1),
            }
        )
        .withColumn("run_matters", matters)
        .drop(
            "seen_keys", "last_y0", "page_close", "page_caption", "caption_close_by", "page_heading",
            "run_head", "page_pos", "page_texts", "texts_before", "headings_before", "closes_before",
            "captions_before", "caption_behind", "caption_ahead", "is_short",
        )
    )


def fold_text(rows: DataFrame, keys: list[str], separator: str, text: str = "text") -> DataFrame:
    """Joins the texts of each group in reading order, in one move of the texts."""
    folded = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("page_number", "order_index", F.col(text).alias("piece")))).alias("pieces")
    )
    return folded.select(*keys, F.array_join(F.col("pieces.piece"), separator).alias(text))
