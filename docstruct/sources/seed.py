"""Ordered page blocks derived from the ``documents`` table (the test corpus of FIXTURES.md).

Every document is one row, so its blocks are built with array functions inside that row: reading,
templating, ordering and paging need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (position, modulus, remainder, text). {d} = doc_id, {y} = two-digit year.
TEMPLATES = [
    (1, 1, 0, "Scalable indexing of corpus number {d}"),
    (2, 3, 0, "Ada Lovelace1, Alan Turing2 & Grace Hopper"),
    (3, 4, 1, "Nature Machine Intelligence | Volume 7 | April 20{y} | 639-649"),
    (4, 5, 2, "https://doi.org/10.1038/s42256-0{y}-{d}."),
    (5, 2, 0, "Published online: 21 February 20{y}"),
    (6, 3, 1, "Abstract"),
    (115, 2, 1, "1. Introduction"),
    (125, 4, 0, "Downloaded from https://example.com/{d}"),
    (135, 3, 2, "Materials and Methods"),
    (142, 2, 0, "Figure 1 compares accuracy and latency of (a) ours vs. (b) baseline {d}."),
    (143, 3, 0, "Page 2"),
    (144, 5, 0, "Error bars show the spread over ten runs of the pipeline."),
    (155, 1, 0, "As shown in Fig. 1, the improvement holds for corpus {d}."),
    (165, 2, 1, "RESULTS"),
    (175, 3, 1, "Fig. 2a | Overview of the workflow; table of stable parts."),
    (176, 7, 0, "short"),
    (185, 4, 2, "Results and Discussion"),
    (195, 2, 0, "Conclusions"),
]

BLOCKS_PER_PAGE = 12


def seeded_rows() -> Column:
    """The lines of ``text`` and the templates of the document, with their positions, in any order."""
    doc = F.col("doc_id")
    year = (F.lit(10) + doc % 15).cast("string")

    def template(pos: int, modulus: int, remainder: int, text: str):
        filled = F.replace(F.replace(F.lit(text), F.lit("{d}"), doc.cast("string")), F.lit("{y}"), year)
        row = F.struct(F.lit(pos).alias("pos"), filled.alias("txt"))
        return F.when(doc % modulus == remainder % modulus, row)

    body = F.filter(
        F.transform(
            F.split("text", "\n", -1),
            lambda line, i: F.struct((i * 10 + 100).alias("pos"), line.alias("txt")),
        ),
        lambda x: F.trim(x["txt"]) != "",
    )
    return F.concat(body, F.array_compact(F.array(*[template(*t) for t in TEMPLATES])))


def seeded_blocks(documents: DataFrame) -> DataFrame:
    doc = F.col("doc_id")
    exploded = documents.filter(F.col("text").isNotNull()).select(
        "doc_id", F.posexplode(F.array_sort(seeded_rows())).alias("order_index", "b")
    )
    page = F.floor(F.col("order_index") / BLOCKS_PER_PAGE).cast("int") + 1
    slot = F.col("order_index") % BLOCKS_PER_PAGE
    gap = F.when((doc + F.col("order_index")) % 5 == 0, 90).otherwise(0)
    return exploded.select(
        "doc_id",
        F.concat(F.lit("p"), page.cast("string"), F.lit("_b"), slot.cast("string")).alias("block_id"),
        page.alias("page_number"),
        "order_index",
        F.lit("text").alias("block_type"),
        F.col("b.txt").alias("text"),
        (slot * 60 + gap).cast("double").alias("y0"),
        F.when(F.col("b.pos") == 1, 18.0).otherwise(10.0).alias("max_size"),
    )


def _spans(kind: str, **fields) -> Column:
    """One row of ``schemas.SPANS`` without its document and page; what is not given is NULL."""
    types = {"raw_index": "int", "line_index": "int", "span_index": "int", "text": "string", "size": "double", "bbox": "array<double>", "image_path": "string"}
    values = {**{n: F.lit(None) for n in types}, "raw_type": F.lit(kind), **fields}
    return F.struct(*[values[n].cast(types.get(n, "string")).alias(n) for n in (*types, "raw_type")])


def seeded_spans(documents: DataFrame) -> DataFrame:
    """Page spans (``schemas.SPANS``) whose blocks are those of ``seeded_blocks``, broken into lines and spans, and images.

    A text is halved into two lines, the first line into two spans of different size; some blocks have a blank line, some
    pages a block of blanks. Every second page has an image, every fifth document two, every page one that is too small.
    """
    blocks = seeded_blocks(documents)
    doc, page, slot = F.col("doc_id"), F.col("page_number"), (F.col("order_index") % BLOCKS_PER_PAGE).cast("int")
    text, size = F.col("text"), F.col("max_size")
    half, quarter = F.floor(F.length(text) / 2).cast("int"), F.floor(F.length(text) / 4).cast("int")
    box = F.array(F.lit(0.0), F.col("y0"), F.lit(400.0), F.col("y0") + 12)

    def span(line: int, at: int, part: Column, height: Column) -> Column:
        return _spans("text", raw_index=slot, line_index=F.lit(line), span_index=F.lit(at), text=part, size=height, bbox=box)

    parts = [
        span(0, 0, F.substring(text, F.lit(1), quarter), size - 2),
        span(0, 1, F.substring(text, quarter + 1, half - quarter), size),
        span(2, 0, F.substring(text, half + 1, F.length(text)), size - 1),
        F.when((doc + slot) % 4 == 0, span(1, 0, F.lit(" \u00a0\t"), F.lit(30.0))),
    ]

    def image(index: int, width: float, name: str) -> Column:
        path = F.concat(F.lit("img/"), doc.cast("string"), F.lit("_"), page.cast("string"), F.lit(f"_{name}.png"))
        corner = F.array(F.lit(0.0), F.lit(700.0), F.lit(width), F.lit(760.0))
        return _spans("image", raw_index=F.lit(index), bbox=corner, image_path=path)

    blank = _spans("text", raw_index=F.lit(15), line_index=F.lit(0), span_index=F.lit(0), text=F.lit(" \u00a0"), size=F.lit(9.0), bbox=F.array(*[F.lit(0.0)] * 4))
    # A page's images come with its first block.
    extras = [
        F.when(slot == 0, image(12, 39.0, "small")),
        F.when((slot == 0) & ((doc + page) % 2 == 0), image(13, 80.0, "a")),
        F.when((slot == 0) & (doc % 5 == 0), image(14, 40.0, "b")),
        F.when((slot == 0) & (page == 2), blank),
    ]
    return blocks.select("doc_id", "page_number", F.inline(F.array_compact(F.array(*parts, *extras))))


def seeded_snapshots(documents: DataFrame) -> DataFrame:
    """Rendered pages (``schemas.SNAPSHOTS``): the even ones of each document, and an empty last one of every seventh."""
    doc, page = F.col("doc_id"), F.col("page_number")
    # Only the number of blocks matters: no block is made.
    last = F.floor((F.size(seeded_rows()) - 1) / BLOCKS_PER_PAGE).cast("int") + 1
    ends = documents.filter(F.col("text").isNotNull()).groupBy("doc_id").agg(F.max(last).alias("last"))
    all_pages = F.sequence(F.lit(1), F.col("last") + F.when(doc % 7 == 0, 1).otherwise(0))
    pages = ends.select("doc_id", "last", F.explode(all_pages).alias("page_number")).filter((page % 2 == 0) | (page > F.col("last")))
    path = F.concat(F.lit("pages/"), doc.cast("string"), F.lit("_"), page.cast("string"), F.lit(".png"))
    return pages.select("doc_id", "page_number", path.alias("page_snapshot_path"))
