"""Reading files and page spans, and checking what may enter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docstruct import constants as K
from docstruct.functions import text as T


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Whole text and Markdown files: one row per file, the stripped text doubling as Markdown."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return text_documents(files, F.col("value"))


def text_documents(files: DataFrame, value: Column) -> DataFrame:
    """The path is the id: unlike a hash of it, it cannot coincide with another one."""
    text = T.strip(value)
    return files.select(
        F.col("path").alias("doc_id"),
        "path",
        T.infer_title(text).alias("title"),
        text.alias("raw_text"),
        text.alias("markdown"),
        F.lit("plain_text").alias("parser_kind"),
    )


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*(\.[^./]+)$", 1))


def route_documents(files: DataFrame, path: str = "path") -> DataFrame:
    pdf = F.lower(path).endswith(".pdf")
    return files.withColumn("route", F.when(pdf, "pdf").otherwise("plain_text"))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """File names and lengths; contents are not read.

    Spark's file sources leave out empty files, so those never get in this way. A table of uploads that
    lists them has them rejected with a reason by ``validate_files``.
    """
    return spark.read.format("binaryFile").load(path).select("path", "length")


def validate_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (path, length) -> (accepted with ``kind``, rejected with ``reason``)."""
    kind = F.element_at(T.literal_map(K.UPLOAD_KINDS), suffix(F.col("path")))
    reason = F.when(kind.isNull(), "unsupported_suffix").when(F.col("length") == 0, "empty_file")
    checked = files.withColumns({"kind": kind, "reason": reason})
    return (
        checked.filter(F.col("reason").isNull()).drop("reason"),
        checked.filter(F.col("reason").isNotNull()).drop("kind"),
    )


def assemble_blocks(spans: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Page spans (``schemas.SPANS``) -> ordered blocks.

    Spans are joined per line and lines per block; a group is one block of one page, so it is small.
    The reading order of a document needs the number of kept blocks on earlier pages, which is carried
    over from one row per page. Spans move once, texts and images together, to their page; lines, blocks
    and places on the page are made there. ``keep`` is handed these rows and gives them back written, so that
    they are made once for the order, the blocks and all that is asked of the blocks.
    """
    raw = ["doc_id", "page_number", "raw_index", "raw_type"]
    is_text, box = F.col("raw_type") == "text", F.col("bbox")
    large = (box[2] - box[0] >= K.IMAGE_MIN_SIDE) & (box[3] - box[1] >= K.IMAGE_MIN_SIDE)
    spans = spans.filter(is_text | ((F.col("raw_type") == "image") & large)).repartition("doc_id", "page_number")
    lines = spans.groupBy(*raw, "line_index").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(is_text, F.struct("span_index", "text"))))["text"], "").alias("joined"),
        F.max("size").alias("size"),
        F.first("bbox").alias("bbox"),
        F.collect_list(F.when(~is_text, F.struct("bbox", "image_path"))).alias("images"),
    )
    groups = (
        lines.withColumn("line", T.clean_text(F.col("joined")))
        .filter(~is_text | (F.col("line") != ""))
        .groupBy(*raw)
        .agg(
            F.array_join(F.array_sort(F.collect_list(F.struct("line_index", "line")))["line"], " ").alias("text"),
            F.max("size").alias("max_size"),
            F.first("bbox").alias("bbox"),
            F.flatten(F.collect_list("images")).alias("images"),
        )
    )

    def block(kind: str, text: Column, size: Column, bbox: Column, path: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("block_type"), text.alias("text"), size.alias("max_size"), bbox.alias("bbox"), path.alias("image_path")
        )

    text_block = block("text", F.col("text"), F.col("max_size"), box, F.lit(None).cast("string"))
    images = F.transform("images", lambda x: block("image", F.lit(""), F.lit(0.0), x["bbox"], x["image_path"]))
    blocks = groups.select(*raw[:3], F.inline(F.when(is_text, F.array(text_block)).otherwise(images)))
    on_page = F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("raw_index")) - 1
    blocks = blocks.withColumn("on_page", on_page)
    return number_blocks(keep(blocks) if keep else blocks)


def number_blocks(kept: DataFrame) -> DataFrame:
    """Ids and reading order for the kept blocks of (doc_id, page_number, raw_index) with their places on the page."""
    page = ["doc_id", "page_number"]
    before = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        kept.groupBy(*page)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*page, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    return (
        kept.join(offsets, page)
        .select(
            "doc_id",
            F.concat(F.lit("p"), F.col("page_number"), F.lit("_b"), F.col("raw_index")).alias("block_id"),
            "page_number",
            (F.col("before") + F.col("on_page")).cast("int").alias("order_index"),
            "block_type",
            "text",
            F.col("bbox")[1].alias("y0"),
            "max_size",
            "bbox",
            "image_path",
        )
    )
