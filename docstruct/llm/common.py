"""Helpers that several training-data operators share: written cuts, hashed filters, components, global order."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OWN: dict[str, str] = {}
_INSIDE: ContextVar[list[DataFrame] | None] = ContextVar("cuts", default=None)
#: Whether a query's shuffle files go when it has ended, instead of when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own only for a session in one process that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{named.rstrip('/')}/docstruct-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and returns it read back: its lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    made = spark.read.schema(df.schema).parquet(path)
    made._cut = path
    inside = _INSIDE.get()
    if inside is not None:
        inside.append(made)
    return made


def drop(*tables: DataFrame) -> None:
    """Deletes cuts that nothing reads any more."""
    for made in tables:
        spark = made.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made._cut)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing_cuts() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Cuts made inside are deleted at the end, but those that are handed to the function it gives.

    For steps whose result is a written table: what it was made of is no longer read.
    """
    kept: list[DataFrame] = []

    def keep(made: DataFrame) -> DataFrame:
        kept.append(made)
        return made

    token = _INSIDE.set([])
    try:
        yield keep
    finally:
        inside = _INSIDE.get()
        _INSIDE.reset(token)
        stays = {made._cut for made in kept}
        drop(*[made for made in inside if made._cut not in stays])
        outer = _INSIDE.get()
        if outer is not None:
            outer.extend(made for made in inside if made._cut in stays)


def drop_cuts(spark: SparkSession) -> None:
    """Deletes what ``cut`` has written in this application; call it once the results are stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Hands the memory that Arrow keeps after a batch back to the system: a worker that waits for its next task holds it else."""
    pa.default_memory_pool().release_unused()


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all other letters as they are; ``lower`` does it where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def row_key(doc_id: str, text: str) -> Column:
    """Tells rows apart where ids repeat or are null: rows with the same id and text are the same row."""
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (a struct of all columns), ``d`` and ``k``: so that no column of ``docs`` clashes with an operator's own."""
    return docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[doc_id].alias("d"), row_key(doc_id, text).alias("k")
    )


BITS = 23  # 2 ** 23 bits: one megabyte, whatever the number of keys


def bit_filter(keys: DataFrame, key: str, bits: int = BITS) -> Column:
    """A scalar array of ``2 ** bits`` bits that has the bit of each ``key`` set: a Bloom filter of one hash.

    Its size is fixed, so that it can be sent to every task. It only saves shuffled rows: a join on the
    key itself must follow, and with very many keys it fills up and lets all rows through to that join.
    """
    words = 1 << (bits - 6)
    spark = keys.sparkSession
    at = F.shiftrightunsigned(F.col(key), 64 - bits)
    filled = keys.select(
        F.shiftright(at, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({key}, {64 - bits}) & 63 as int))").alias("b")
    )
    empty = spark.range(words).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b"))
    dense = filled.unionByName(empty).groupBy("w").agg(F.bit_or("b").alias("b"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits")).scalar()


def in_filter(bits: Column, key: Column, n_bits: int = BITS) -> Column:
    at = F.shiftrightunsigned(key, 64 - n_bits)
    word = F.get(bits, F.shiftright(at, 6).cast("int"))
    return F.expr("1L") == F.call_function("shiftright", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.expr("1L"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table: one row ``(node, component)`` per node, component = its least node.

    Alternating large and small stars: every round links nodes to the least node that they or their
    neighbours know, in two grouped minima and two joins; no node's neighbours meet in one task. Each round
    is written. The rounds grow with the logarithm of the number of nodes. Self-loops only name a node.
    """
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node")))
    pairs = cut(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    nodes = cut(nodes.where(F.col("node").isNotNull()).distinct())
    state = None
    while True:
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not now[0] or tuple(now) == state:
            break
        state = tuple(now)
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = cut(both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
        pairs = cut(small.where(F.col("u") != F.col("v")).distinct())
    return nodes.join(pairs.select(F.col("u").alias("node"), "v"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )


def in_order(df: DataFrame, *keys: str, at: str = "at") -> DataFrame:
    """``df`` in the global order of ``keys`` with each row's place from 0, without one task holding all rows.

    A range shuffle and a sort per range; the ranges' row counts (one row per range) carry the places on.
    ``keys`` should tell rows apart; equal rows get their places in any order.
    """
    parts = cut(
        df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys])
        .sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
        .withColumn("_m", F.monotonically_increasing_id())
        .withColumn("_p", F.shiftrightunsigned("_m", 33))
    )
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_p").agg(F.count("*").alias("_n")).withColumn(
        "_s", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))
    )
    return parts.join(starts.drop("_n"), "_p").withColumn(at, F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop(
        "_p", "_m", "_s"
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def same_row(d: str = "d2", k: str = "k2") -> Column:
    """Join condition of a ``packed`` table and ``(d2, k2)``; NULL ids are equal."""
    return F.col("d").eqNullSafe(F.col(d)) & (F.col("k") == F.col(k))


def without(docs: DataFrame, bad: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id and text key are not in ``bad`` (``d2, k2``), with all their columns.

    An anti-join that moves few texts: rows whose bit is not set in the fixed-size filter of ``bad`` are surely
    kept and stay where they are; only the others are shuffled for the exact join.
    """
    bits = bit_filter(bad.select(F.xxhash64("d2", "k2").alias("h")), "h")
    rows = packed(docs, doc_id, text).withColumn("maybe", in_filter(bits, F.xxhash64("d", "k")))
    checked = rows.where("maybe").join(bad, same_row(), "left_anti")
    return rows.where("NOT maybe").select("row").union(checked.select("row")).select("row.*")


def small(df: DataFrame, most: int = 4096) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows, counted here; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions, F.lit(False))
