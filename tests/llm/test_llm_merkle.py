"""The Merkle manifest against a plain tree, and the arithmetic of its blocks."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from docstruct.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return levels


def others(levels, at):
    """Left and right siblings of a leaf, level by level."""
    for level in levels[:-1]:
        start = at - at % 3
        yield level[start:at], level[at + 1 : start + 3]
        at //= 3


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_version(rows):
    """``rows``: (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for doc, source, lang, n, text in rows:
        leaf = H(*map(value, (doc, source, lang, n, text)))
        shown = leaf
        if doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0:
            shown = H(*map(value, (doc, source, lang, n, None if text is None else text.replace("\n", ""))))
        trees.setdefault(source, []).append((doc is not None, doc or 0, leaf, shown, doc))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: levels_of([r[2] for r in sorted(trees[s])]) for s in order}
    top = levels_of([built[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, (_, _, leaf, shown, doc) in enumerate(sorted(trees[s])):
            steps = [*others(built[s], at), *others(top, k)]
            end = shown
            for left, right in steps:
                end = H(*left, end, *right)
            proof = H(*[x for left, right in steps for x in (*left, *right)])
            out.append((doc, leaf, built[s][-1][0], top[-1][0], proof, end, end == top[-1][0]))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for k in range(400):
        source = rng.choice(["hot", "hot", "hot", None, "", "é", "z", f"own{k}"])
        text = rng.choice([None, "", "one", "a\nb\n", "\n", "ß\nß" * 50])
        out.append((rng.choice([k, k, 5, None]), source, rng.choice(["en", None]), rng.choice([None, k]), text))
    out += [out[3], out[3], (2**60 + 1, "hot", "en", 3, "big\nid")]
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_verified_documents(spark, rows, monkeypatch, levels):
    monkeypatch.setattr(M, "LEVELS", levels)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    done = _worker_levels(spark, docs, levels)
    assert sorted(map(tuple, done), key=repr) == plain_version(rows)


def _worker_levels(spark, docs, levels):
    """Blocks of few levels, in the Python workers as well, so that a small table has several tiers."""
    build, leaf_paths, audit = M._build, M._leaf_paths, M._audit

    def low(fn):
        def run(batches):
            from docstruct.llm import merkle

            merkle.LEVELS = levels
            yield from getattr(merkle, fn)(batches)

        return run

    M._build, M._leaf_paths, M._audit = low("_build"), low("_leaf_paths"), low("_audit")
    try:
        return M.verify_documents(docs).collect()
    finally:
        M._build, M._leaf_paths, M._audit = build, leaf_paths, audit


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_few_rows(spark, n):
    rows = [(k, "s", "en", 1, f"a\n{k}") for k in range(n)]
    done = M.verify_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, done), key=repr) == plain_version(rows)


def test_empty_table_and_clashing_columns(spark):
    assert M.verify_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(k, "s", "en", 1, "a\nb", "x", 9, b"y") for k in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA + ", grp string, pos int, root binary")
    assert sorted(map(tuple, M.verify_documents(docs).collect()), key=repr) == plain_version([r[:5] for r in rows])


def test_any_change_is_found(spark):
    """A leaf that is not the one of the manifest never leads to the root; the others still do."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, f"s{k % 4}", None, 1, f"text {k}") for k in range(60)], SCHEMA)
    leaves = M.document_leaves(docs).withColumn("shown", F.when(F.col("doc_id") == 17, F.unhex(F.lit("00" * 32))).otherwise(F.col("shown")))
    proofs = M.Manifest(leaves).proofs().collect()
    assert {p.doc_id for p in proofs if not p.verified} == {17}
    good = next(p for p in proofs if p.doc_id == 3)
    assert M.fold(bytes.fromhex(good.leaf), bytes(good.path)).hex() == good.root


@pytest.mark.parametrize("levels", range(1, 8))
def test_addresses_fill_the_layout(levels):
    at = np.concatenate([M.address(levels, d, np.arange(3**d)) for d in range(levels)])
    assert sorted(at.tolist()) == list(range(M.tree_size(levels)))


def test_subtrees_lie_together():
    """Every subtree of the lower half is one run of places, as is the upper half."""
    levels, upper = 7, 3
    top = np.concatenate([M.address(levels, d, np.arange(3**d)) for d in range(upper)])
    assert sorted(top.tolist()) == list(range(M.tree_size(upper)))
    for k in range(3**upper):
        inside = np.concatenate([M.address(levels, upper + d, np.arange(3**d) + k * 3**d) for d in range(levels - upper)])
        assert inside.max() - inside.min() + 1 == len(inside) == M.tree_size(levels - upper)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 10, 28, 81])
def test_block_and_siblings(n):
    leaves = [hashlib.sha256(str(k).encode()).digest() for k in range(n)]
    depth = M.depth_of(n)
    block = M.build_block(leaves, depth)
    assert block[:32].hex() == levels_of([x.hex() for x in leaves])[-1][0]
    for k in range(n):
        assert M.fold(leaves[k], M.siblings(block, depth, n, k)) == block[:32]
