"""Continuous ingest: new files go through the same structure plan as a batch.

Every rule looks at whole documents. Text files hold one document each. The blocks of a document may come in several
files and micro-batches: where they say how many there are (``block_total``), they wait in a table until all are there.
Rows of a document that an earlier micro-batch has already turned into tables, or given up, are rejected and listed,
never made a second document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from docstruct.plans import staging
from docstruct.plans.corpus import REPORT_PLAN, Corpus
from docstruct.sources.files import text_documents


def read_text_stream(spark: SparkSession, path: str, files_per_batch: int = 10_000) -> DataFrame:
    files = (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    return text_documents(files, F.col("value"))


def ingest_texts(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    return (
        read_text_stream(spark, path)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )


def _batches_before(spark: SparkSession, path: str, batch_id: int, columns: str) -> DataFrame:
    """Rows of the folders of earlier micro-batches; none if there are none yet."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if batch_id == 0 or not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], columns)
    return spark.read.parquet(path).filter(F.col("batch") < batch_id)


def settle(blocks: DataFrame, batch_id: int, patience: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Waiting and new blocks -> (complete documents' blocks, blocks that wait on, ids given up).

    A document is complete when it has ``block_total`` different blocks. It is given up when more than ``patience``
    micro-batches have passed since its first block came (``first_batch``).
    """
    rows = blocks.dropDuplicates(["doc_id", "block_id"])
    state = rows.groupBy("doc_id").agg(
        (F.count(F.lit(1)) >= F.max("block_total")).alias("complete"), F.min("first_batch").alias("since")
    )
    # Written once: three results read it.
    marked = staging.stage(rows.join(state, "doc_id"), "marked")
    open_rows = marked.filter(~F.col("complete"))
    late = F.col("since") < batch_id - patience
    columns = [c for c in blocks.columns if c != "first_batch"]
    return (
        marked.filter("complete").select(*columns),
        open_rows.filter(~late).select(*columns, F.col("since").alias("first_batch")),
        open_rows.filter(late).select("doc_id").distinct(),
    )


def ingest_blocks(blocks: DataFrame, out: str, checkpoint: str, patience: int = 10) -> StreamingQuery:
    """Stream of blocks -> tables ``structure``, ``sections``, ``figures`` and ``rejected``, one folder per micro-batch.

    Writing a folder by batch number makes a repeated micro-batch replace its own output. ``rejected`` has
    ``(doc_id, reason)``: documents that came again after their micro-batch, whose new rows are left out, and those that
    ``patience`` micro-batches have not completed. With a column ``block_total`` blocks of open documents are kept in
    ``waiting``, of which only the folder of the last micro-batch counts; without it all blocks of a document are
    taken to come together.
    """
    in_parts = "block_total" in blocks.columns

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with staging.scope(spark):
            key = f"doc_id {dict(batch.dtypes)['doc_id']}, batch int"
            done = _batches_before(spark, f"{out}/structure", batch_id, key).select("doc_id")
            given_up = _batches_before(spark, f"{out}/rejected", batch_id, key + ", reason string")
            seen = done.unionByName(given_up.filter(F.col("reason") == "incomplete").select("doc_id"))
            again = batch.select("doc_id").distinct().join(seen, "doc_id", "left_semi")
            rejected = again.withColumn("reason", F.lit("document_seen_before"))
            if batch_id > 0:
                batch = batch.join(seen, "doc_id", "left_anti")
            if in_parts:
                batch = batch.withColumn("first_batch", F.lit(batch_id))
                if batch_id > 0:
                    kept = spark.read.schema(batch.schema).parquet(f"{out}/waiting/batch={batch_id - 1}")
                    batch = kept.unionByName(batch)
                batch, waiting, lost = settle(staging.stage(batch, "arrived"), batch_id, patience)
                waiting.write.mode("overwrite").parquet(f"{out}/waiting/batch={batch_id}")
                rejected = rejected.unionByName(lost.withColumn("reason", F.lit("incomplete")))
            rejected.write.mode("overwrite").parquet(f"{out}/rejected/batch={batch_id}")
            corpus = Corpus(batch.drop("block_total"), staged=REPORT_PLAN)
            for name in ("structure", "sections", "figures"):
                getattr(corpus, name).write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
            if in_parts and batch_id > 1:
                # A repeated micro-batch reads the folder before it, no older one.
                staging.delete(spark, f"{out}/waiting/batch={batch_id - 2}")

    return (
        blocks.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
