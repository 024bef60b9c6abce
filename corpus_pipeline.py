"""The training-data pipeline: quality, line dedup, near-dedup, decontamination, packing over ``documents``."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstruct.llm.common import cut, drop, passing_cuts, table
from docstruct.llm.decontam import drop_contaminated
from docstruct.llm.kneser_ney import keep_good
from docstruct.llm.linededup import dedup_passages
from docstruct.llm.packing import pack_documents
from docstruct.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity the classifier accepts."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines (of any length) and passages that an earlier document has; ``n_chars`` follows the text."""
    done = dedup_passages(docs, counts=False, short=True)
    if "n_chars" not in docs.columns:
        return done
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, placed in sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", packing),
]
#: SQL expresses neither the model nor the units of lines nor the packing; tests/llm holds the stages against brute force and run() against its stages.
ORACLE_SQL = None


#: Rows that are handed to Python at once. Whole texts and what is made of them lie in a worker twice and more; the
#: stages share an executor, whose workers keep what the stage before has taken.
ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of at most ``ROWS`` rows for Python inside; the session's own number again afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(ROWS if before <= 0 else min(ROWS, before)))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage has read is deleted then."""
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark):
        before = None
        for _, stage in STAGES[:-1]:
            with passing_cuts() as keep:
                docs = keep(cut(stage(spark, docs, sf_dir)))
            if before is not None:
                drop(before)
            before = docs
        return STAGES[-1][1](spark, docs, sf_dir)
