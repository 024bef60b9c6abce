"""Merkle manifest of a dataset: one tree per group of rows, one over the groups, stored in blocks of van Emde Boas layout.

Every ``ARITY`` consecutive nodes of a level are hashed to one node of the next. A block is an aligned subtree of ``LEVELS``
levels below its root; its digests lie in one byte string, recursively: the upper half of the levels first, then each
subtree of the lower half. Where a node lies follows from its depth and number alone, by arithmetic; the same arithmetic
serves building a block and reading siblings from it. The roots of a tree's blocks are the leaves of its next tier of blocks.

A task holds one block at a time (``ARITY ** LEVELS`` leaves, 315 KB), whatever the size of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstruct.llm.common import cut

#: Nodes hashed together; levels of a block below its root.
ARITY, LEVELS = 3, 8
_SIZE = 32  # bytes of a digest

_BLOCKS = "grp string, block bigint, depth int, n int, nodes binary, root binary"
_PATHS = "grp string, pos bigint, path binary, subroot binary, root binary"


def digest_of(*values: Column) -> Column:
    """Digest of some values: each is ``-`` if null, else its UTF-8 length, a colon and itself."""
    text = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tree_size(levels: int, arity: int = ARITY) -> int:
    return (arity**levels - 1) // (arity - 1)


def address(levels: int, depth: int, number: np.ndarray, arity: int = ARITY) -> np.ndarray:
    """Places in the layout of the nodes ``number`` at ``depth`` of a complete tree with ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(number)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, number, arity)
    lower, inside = levels - upper, depth - upper
    subtree, within = np.divmod(number, arity**inside)
    return tree_size(upper, arity) + subtree * tree_size(lower, arity) + address(lower, inside, within, arity)


@lru_cache(maxsize=32)
def places(depth: int, level: int) -> np.ndarray:
    """``address`` of all nodes of a level of a block whose leaves are at ``depth``."""
    return address(depth + 1, level, np.arange(ARITY**level, dtype=np.int64))


def depth_of(n: int) -> int:
    """Levels below the root that ``n`` leaves need."""
    depth = 0
    while ARITY**depth < n:
        depth += 1
    return depth


def build_block(leaves: list[bytes], depth: int) -> bytes:
    """A block over its leaves; where there are fewer than fit, the places of the missing nodes are zero."""
    out = bytearray(tree_size(depth + 1) * _SIZE)
    level = leaves
    for k in range(depth, -1, -1):
        at = places(depth, k)
        for place, node in zip(at[: len(level)].tolist(), level):
            out[place * _SIZE : (place + 1) * _SIZE] = node
        if k:
            level = [fold_run(level[i : i + ARITY]) for i in range(0, len(level), ARITY)]
    return bytes(out)


def fold_run(run: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(run).hex().encode()).digest()


def siblings(nodes: bytes, depth: int, n: int, number: int) -> bytes:
    """The path of leaf ``number`` of ``n`` in a block, from the leaf up.

    For each level: one byte for the place in its run, one for the length of the run, then the run's other digests.
    """
    out = []
    for k in range(depth, 0, -1):
        own = number % ARITY
        start = number - own
        length = min(ARITY, n - start)
        out.append(bytes((own, length)))
        at = places(depth, k)
        out += [nodes[p * _SIZE : (p + 1) * _SIZE] for j in range(length) if j != own for p in (int(at[start + j]),)]
        number //= ARITY
        n = -(-n // ARITY)
    return b"".join(out)


def steps(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    """What stands left and right of the own digest at each level of a path."""
    at = 0
    while at < len(path):
        own, length = path[at], path[at + 1]
        middle = at + 2 + own * _SIZE
        end = at + 2 + (length - 1) * _SIZE
        yield path[at + 2 : middle], path[middle:end]
        at = end


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and a path lead to."""
    for left, right in steps(path):
        leaf = hashlib.sha256((left + leaf + right).hex().encode()).digest()
    return leaf


def path_digest(path: bytes) -> str:
    """Digest of all siblings of a path."""
    return hashlib.sha256("".join((left + right).hex() for left, right in steps(path)).encode()).hexdigest()


def numbered(leaves: DataFrame, group: str, *order: str) -> DataFrame:
    """``leaves`` with their place ``pos`` in their group and the group's ``size``; rows equal in ``order`` in any order.

    The rows are sorted by range over the whole table, so that a group with a third of them lies in many tasks. Rows are
    counted per range and group; these counts carry the places on.
    """
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    parts = cut(
        leaves.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_m", F.monotonically_increasing_id())
        .withColumn("_p", F.shiftrightunsigned("_m", 33))
    )
    own = Window.partitionBy("_g")
    heads = (
        parts.groupBy("_p", F.col(group).alias("_g")).agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(own.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("size", F.sum("_n").over(own))
        .withColumnRenamed("_p", "_q")
    )
    return parts.join(heads, (F.col("_p") == F.col("_q")) & F.col(group).eqNullSafe(F.col("_g"))).select(
        *leaves.columns, (F.col("_before") + F.col("_m") - F.col("_first")).alias("pos"), "size"
    )


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks from leaves sorted by group, block and place."""
    current, leaves, size = None, [], 0

    def closed() -> list[tuple]:
        if current is None:
            return []
        depth = depth_of(size) if size <= ARITY**LEVELS else LEVELS
        nodes = build_block(leaves, depth)
        return [(*current, depth, len(leaves), nodes, nodes[:_SIZE])]

    columns = ["grp", "block", "depth", "n", "nodes", "root"]
    for batch in batches:
        rows, held = [], 0
        for grp, block, digest, whole in batch[["grp", "block", "digest", "size"]].itertuples(index=False, name=None):
            key = (None if pd.isna(grp) else grp, block)
            if key != current:
                rows += closed()
                held += len(rows[-1][4]) if rows else 0
                current, leaves, size = key, [], whole
                if held > 1 << 23:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            leaves.append(bytes(digest))
        if rows:
            yield pd.DataFrame(rows, columns=columns)
    if current is not None:
        yield pd.DataFrame(closed(), columns=columns)


def block_of(pos: str = "pos") -> Column:
    return F.floor(F.col(pos) / ARITY**LEVELS).cast("long")


def tiers(leaves: DataFrame) -> list[DataFrame]:
    """All blocks of all trees over ``(grp, pos, size, digest)``: the first tier has the leaves, the last no tree of two blocks."""
    most = leaves.agg(F.max("size")).first()[0] or 0
    out = []
    while True:
        dealt = leaves.select("grp", block_of().alias("block"), "pos", "size", "digest")
        built = dealt.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos").mapInPandas(_build, _BLOCKS)
        out.append(cut(built))
        if most <= ARITY**LEVELS:
            return out
        # Trees of one block end here; the others go on with their blocks' roots.
        blocks = F.count("*").over(Window.partitionBy("grp"))
        leaves = out[-1].select("grp", F.col("block").alias("pos"), blocks.alias("size"), F.col("root").alias("digest")).where("size > 1")
        most = -(-most // ARITY**LEVELS)


def _leaf_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The paths of all leaves of some blocks, each continued by the block's own."""
    for batch in batches:
        for grp, block, depth, n, nodes, path, subroot, root in batch[
            ["grp", "block", "depth", "n", "nodes", "path", "subroot", "root"]
        ].itertuples(index=False, name=None):
            nodes, path = bytes(nodes), bytes(path)
            paths = [siblings(nodes, depth, n, k) + path for k in range(n)]
            start = block * ARITY**LEVELS
            yield pd.DataFrame({"grp": grp, "pos": range(start, start + n), "path": paths, "subroot": subroot, "root": root})


def with_paths(blocks: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first tier's blocks, each with the ``path`` from its root to the dataset's, its tree's ``subroot`` and the ``root``.

    ``tops``: ``grp, path, root`` of every tree. Only blocks move, never leaves.
    """
    t = tops.select(F.col("grp").alias("g2"), F.col("path").alias("top_path"), F.col("root").alias("top_root"))
    above = None
    for tier in reversed(blocks):
        rows = tier.join(t, F.col("grp").eqNullSafe(F.col("g2"))).select(
            "grp", "block", "depth", "n", "nodes", F.col("root").alias("own"), "top_path", "top_root"
        )
        if above is None:
            rows = rows.select("grp", "block", "depth", "n", "nodes", F.col("top_path").alias("path"), F.col("own").alias("subroot"), F.col("top_root").alias("root"))
        else:
            up = cut(above.mapInPandas(_leaf_paths, _PATHS)).select(F.col("grp").alias("g3"), "pos", "path", "subroot", "root")
            rows = rows.join(up, F.col("grp").eqNullSafe(F.col("g3")) & (F.col("block") == F.col("pos")), "left").select(
                "grp", "block", "depth", "n", "nodes", F.coalesce("path", "top_path").alias("path"),
                F.coalesce("subroot", "own").alias("subroot"), F.coalesce("root", "top_root").alias("root"),
            )
        above = rows
    return above


def _audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Checks of leaves that follow their block: sorted by group and block, the block's row first."""
    names = ["doc_id", "grp", "pos", "leaf", "subroot", "root", "path", "folded_root", "proof_sha256", "verified"]
    block = None
    for batch in batches:
        rows = []
        for doc, grp, number, pos, digest, shown, depth, n, nodes, path, subroot, root in batch[_AUDIT].itertuples(index=False, name=None):
            if pos < 0:
                block = (number * ARITY**LEVELS, int(depth), int(n), bytes(nodes), bytes(path), bytes(subroot), bytes(root))
                continue
            start, depth, n, nodes, path, subroot, root = block
            whole = siblings(nodes, depth, n, pos - start) + path
            end = fold(bytes(shown), whole)
            rows.append((doc, grp, pos, bytes(digest).hex(), subroot.hex(), root.hex(), whole, end.hex(), path_digest(whole), end == root))
        if rows:
            yield pd.DataFrame(rows, columns=names)


_AUDIT = ["doc_id", "grp", "block", "pos", "digest", "shown", "depth", "n", "nodes", "path", "subroot", "root"]


class Manifest:
    """The manifest of a table of ``(doc_id, grp, digest, shown)``, built and written once.

    ``digest`` is a row's leaf, ``shown`` the digest that an auditor finds in its place. Groups are in the order of their
    names (null first, by bytes), rows in that of their ids (null first), repeated ids in that of their digests.
    """

    def __init__(self, leaves: DataFrame) -> None:
        self.leaves = cut(numbered(cut(leaves), "grp", "doc_id", "digest", "shown"))
        self.blocks = tiers(self.leaves)
        #: Trees have one block in the tier where they end, the last with a row of their own number 0 alone.
        roots = self.blocks[0].select("grp", "root").where(F.col("block") == 0)
        for tier in self.blocks[1:]:
            later = tier.where(F.col("block") == 0).select(F.col("grp").alias("g2"), F.col("root").alias("r2"))
            roots = roots.join(later, F.col("grp").eqNullSafe(F.col("g2")), "left").select("grp", F.coalesce("r2", "root").alias("root"))
        trees = cut(numbered(roots.withColumn("whole", F.lit("")), "whole", "grp"))
        over = trees.select(F.lit("").alias("grp"), "pos", "size", F.col("root").alias("digest"))
        #: Blocks of the tree over the groups' roots.
        self.top = tiers(over)
        start = self.top[-1].where(F.col("block") == 0).select("grp", F.lit(b"").alias("path"), "root")
        paths = with_paths(self.top, start).mapInPandas(_leaf_paths, _PATHS).select("pos", "path", "root")
        self.groups = cut(trees.select("grp", "pos").join(paths, "pos").select("grp", "path", "root"))

    def proofs(self) -> DataFrame:
        """One row per leaf: ``doc_id, grp, pos, leaf, subroot, root, path, folded_root, proof_sha256, verified``.

        ``path`` is the proof itself (``siblings``); ``folded_root`` what it and the shown digest lead to.
        """
        blocks = with_paths(self.blocks, self.groups)
        kinds = dict(blocks.dtypes)
        leaves = self.leaves.select(
            F.col("doc_id").cast("string").alias("doc_id"), "grp", block_of().alias("block"), "pos", "digest", "shown",
            *[F.lit(None).cast(kinds[c]).alias(c) for c in ("depth", "n", "nodes", "path", "subroot", "root")],
        )
        none = F.lit(None)
        heads = blocks.select(
            none.cast("string").alias("doc_id"), "grp", "block", F.lit(-1).cast("long").alias("pos"), none.cast("binary").alias("digest"),
            none.cast("binary").alias("shown"), "depth", "n", "nodes", "path", "subroot", "root",
        )
        dealt = leaves.union(heads).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
        proved = dealt.select(*_AUDIT).mapInPandas(
            _audit,
            "doc_id string, grp string, pos bigint, leaf string, subroot string, root string, path binary, folded_root string, proof_sha256 string, verified boolean",
        )
        return proved.withColumn("doc_id", F.col("doc_id").cast("long"))


def document_leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Leaves of a documents table: digests of doc_id, source, lang, n_chars and text, grouped by source.

    Rows for which ``tampered`` holds show the digest of their text without line feeds.
    """
    fields = [docs[c] for c in ("doc_id", "source", "lang", "n_chars")]
    digest = digest_of(*fields, docs["text"])
    changed = tampered & docs["text"].contains("\n") if tampered is not None else F.lit(False)
    shown = F.when(changed, digest_of(*fields, F.replace(docs["text"], F.lit("\n"), F.lit(""))))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].alias("grp"), digest.alias("digest"), shown.alias("shown")).withColumn(
        "shown", F.coalesce("shown", "digest")
    )


def half_tampered(doc_id: Column) -> Column:
    """Documents whose id has an even CRC-32 as decimal text; null ids are left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def verify_documents(docs: DataFrame) -> DataFrame:
    """Builds the manifest of ``docs`` and proves every row against it, half of the rows after tampering with them.

    Null values have digests of their own, texts of any length are hashed where they lie, repeated rows are leaves of their
    own, an empty table has no rows and no root, columns beyond the five are not looked at.
    """
    rows = Manifest(document_leaves(docs, half_tampered(docs["doc_id"]))).proofs()
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
