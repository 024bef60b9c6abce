"""Near copies in large groups of candidates: families, chains of edits, crowds that share a passage."""

import os
import random

import pytest

from docstruct.llm import common
from docstruct.llm import simhash as S


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(words)), n):
        out[at] = f"e{rng.randrange(10**6)}"
    return out


def brute(texts):
    """Ids by least reachable id, and the number of links."""
    sets = [frozenset(S.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    n = 0
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                n += 1
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: top(k) for k in range(len(texts))}, n


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in S.near_copies(rows).collect()}


def two_families(rng):
    """Two texts that share three quarters of their words, and sixty edited copies of each."""
    common = prose(rng, 170)
    return [" ".join(edited(rng, common + own, 1)) for own in (prose(rng, 30), prose(rng, 30)) for _ in range(60)]


def chain(rng):
    """Each text replaces a few more words of the one before it: the ends have little in common."""
    words, out = prose(rng, 300), []
    for k in range(26):
        words = words[:]
        words[(k * 11) % 300] = f"c{k}"
        words[(k * 11 + 5) % 300] = f"d{k}"
        out.append(" ".join(words))
    return out


def crowd(rng):
    """Texts that share half of their words with all the others; a few of them are near copies of each other."""
    passage, out = prose(rng, 100), []
    for k in range(120):
        out.append(" ".join(prose(rng, 50) + passage + prose(rng, 50)))
        if k % 12 == 0:
            out.append(" ".join(edited(rng, out[-1].split(), 2)))
    return out


@pytest.mark.parametrize("make", [two_families, chain, crowd])
def test_large_groups_lose_no_link(spark, make):
    texts = make(random.Random(7))
    want, links = brute(texts)
    assert links >= 10
    assert found(spark, texts) == want


def test_families_stay_apart(spark):
    texts = two_families(random.Random(7))
    assert len(set(brute(texts)[0].values())) == 2


def test_rows_without_id_words_or_company(spark):
    rows = [(None, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (5, "x"), (5, "y z"), (5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in S.near_copies(docs).collect() if r.doc_id is not None)
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (5, 5), (5, 5)]
    kept = sorted(((r.doc_id, r.text) for r in S.keep_one(docs).collect()), key=str)
    assert len(kept) == 4 and (None, "a b c d e f g") in kept and {k for k, _ in kept} == {None, 1, 3, 5}
    assert S.keep_one(docs.where("false")).count() == 0


def test_fingerprints_link_what_shingle_sets_do_not(spark):
    """A passage repeated many times rules the fingerprint, and few of the different shingles."""
    rng = random.Random(5)
    passage = prose(rng, 13)
    texts = [" ".join(passage * 200 + prose(rng, 20)) for _ in range(4)] + [" ".join(prose(rng, 60)) for _ in range(4)]
    links = {(a, b) for a in range(8) for b in range(a) if (S.fingerprint(S.shingle_hashes(texts[a], 3)) ^ S.fingerprint(S.shingle_hashes(texts[b], 3))).bit_count() <= 2}
    assert links and brute(texts)[1] == 0
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in S.near_groups(docs).collect()}
    assert found(spark, texts) == groups
    assert sorted(r.doc_id for r in S.keep_one(docs).collect()) == sorted(set(groups.values()))


def written(spark, monkeypatch):
    """Rows of every cut of the near copies from now on."""
    rows = []

    def cut(df):
        made = common.cut(df)
        rows.append(made.count())
        return made

    monkeypatch.setattr(S, "cut", cut)
    return rows


def test_a_crowd_is_not_looked_at_in_every_set_of_samples(spark, monkeypatch):
    """Texts with two thirds of their words in common, none similar to another one; was 64 rows and more for each."""
    rng = random.Random(11)
    passage, rows = prose(rng, 120), written(spark, monkeypatch)
    texts = [" ".join(prose(rng, 30) + passage + prose(rng, 30)) for _ in range(150)]
    assert found(spark, texts) == {k: k for k in range(150)}
    assert max(rows) <= 24 * len(texts)


def test_dense_family_loses_no_link(spark):
    """Edited copies of one text, most of them a little less than similar to each other: pivots find few of the links."""
    rng = random.Random(3)
    words = prose(rng, 120)
    texts = [" ".join(edited(rng, words, rng.choice([1, 2, 3]))) for _ in range(90)]
    want, links = brute(texts)
    assert 20 < links < 90 * 89 / 4 and len(set(want.values())) > 1
    assert found(spark, texts) == want


def test_links_of_every_text_of_an_id(spark):
    """One id with two texts, each the near copy of another row."""
    rng = random.Random(4)
    x, y = prose(rng, 80), prose(rng, 80)
    rows = [(1, " ".join(x)), (1, " ".join(y)), (2, " ".join(edited(rng, x, 1))), (3, " ".join(edited(rng, y, 1)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in S.near_copies(docs).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_only_what_is_read_stays_written(spark):
    rng = random.Random(9)
    texts = [" ".join(edited(rng, prose(random.Random(k % 5), 60), 1)) for k in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[0]), (None, texts[0])], "doc_id long, text string")
    want = {top for top in brute(texts)[0].values()}

    def folders():
        at = common.shared_folder(spark).removeprefix("file:")
        return set(os.listdir(at)) if os.path.exists(at) else set()

    before = folders()
    kept = S.keep_one(docs)
    assert len(folders() - before) == 1
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)
    assert kept.where("doc_id IS NULL").count() == 1
