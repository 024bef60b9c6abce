"""Line chunks, near copies, fingerprints and contamination against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from docstruct.llm import decontam as D
from docstruct.llm import linededup as L
from docstruct.llm import simhash as S
from docstruct.llm.common import components, in_order

VOCABULARY = [f"w{k}x" for k in range(400)]


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    passage = " ".join(sentence(rng, 9) for _ in range(8))
    out = []
    for k in range(60):
        parts = [sentence(rng, rng.randint(3, 12)) for _ in range(rng.randint(4, 14))]
        if k % 4 == 0:
            parts.insert(rng.randrange(len(parts)), passage)
        out.append(rng.choice([" ", "\n"]).join(parts))
    for k in range(20):
        words = out[k].split(" ")
        for _ in range(len(words) // 60):
            words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    return [*out, out[3], out[3], None, "", "  ", "one two"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


def roots(links, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_lines_and_chunks_are_the_text(texts):
    for text in texts:
        assert "".join(L.lines_of(text or "")) == (text or "") == "".join(c for c, _ in L.chunks_of(text))


def test_chunks_fall_into_step_again(texts):
    tail = " ".join(texts[:3])
    one, two = L.chunks_of("Some start. " + tail), L.chunks_of("Quite another start here. And more of it. " + tail)
    assert len(set(one) & set(two)) > 0.7 * len(one)


def test_line_dedup_against_brute_force(docs, texts):
    got = {r.doc_id: r.text for r in L.dedup_lines(docs).collect()}
    seen, expected = set(), {}
    often = Counter(b for t in texts for _, b in L.chunks_of(t) if b)
    for k, text in enumerate(texts):
        left = []
        for chunk, body in L.chunks_of(text):
            if body and often[body] > 1 and body in seen:
                continue
            seen.add(body)
            left.append(chunk)
        expected[k] = None if text is None else "".join(left)
    assert got == expected
    assert sum(len(t or "") for t in got.values()) < sum(len(t or "") for t in texts)


def test_planted_passages_go_whole(spark):
    rng = random.Random(11)
    rows, plain, passages = [], {}, {}
    for n in range(1, 7):
        for sep in (" ", "\n"):
            long = [sentence(rng, 60 // n + 1) for _ in range(n)]
            short = [sentence(rng, 3) for _ in range(20)] if n == 6 else []
            for passage in filter(None, (long, short)):
                for copy in range(3):
                    k = len(rows)
                    before, after = ([sentence(rng, rng.randint(2, 12)) for _ in range(rng.randint(0, 5))] for _ in range(2))
                    rows.append((k, sep.join(before + passage + after)))
                    plain[k], passages[k] = before + after, (passage, copy)
    got = {r.doc_id: r for r in L.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for k, (passage, copy) in passages.items():
        left = [x.strip() for x in L.lines_of(got[k].text)]
        if copy:
            assert left == plain[k] and got[k].n_removed == len(passage)
        else:
            assert got[k].text == rows[k][1] and got[k].n_removed == 0


@pytest.mark.parametrize("bits", [64, 7])
def test_passages_against_brute_force(docs, texts, bits):
    """With 7 bits nearly every hash stands for several bodies, and bytes decide."""
    got = {r.doc_id: r.text for r in L.dedup_passages(docs, bits=bits).collect()}
    first, expected = {}, {}
    for k, text in enumerate(texts):
        lines, units = L.units_of(text)
        assert "".join(lines) == (text or "")
        gone = set()
        for a, b, body in units:
            assert len(body.split()) >= 8 and (b == a + 1 or len(body.split("\n")) == b - a)
            at = first.setdefault(body, (k, b))
            if at[0] < k or at[1] <= a:
                gone |= set(range(a, b))
        expected[k] = None if text is None else "".join(x for j, x in enumerate(lines) if j not in gone)
    assert got == expected


@pytest.mark.parametrize("bits", [64, 7])
def test_short_lines_against_brute_force(spark, texts, bits):
    """Every line between line feeds keeps one place, whatever its length; sentences inside a paragraph stay."""
    rng = random.Random(7)
    notes = ["Top", "All rights reserved. See here.", "One. Two.", " \u00a0", ""]
    made = ["\n".join(rng.choice(notes + [sentence(rng, rng.randint(1, 9))]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    made += ["\n \n Top. One\n\nTop", "Top. One. Two. Top.", "Top", "\n\n", "Top \n  ", "One. Two. \n", *texts]
    got = {r.doc_id: r for r in L.dedup_passages(spark.createDataFrame(enumerate(made), "doc_id long, text string").repartition(4), bits=bits, short=True).collect()}
    first = {}
    for k, text in enumerate(made):
        lines, units = L.units_of(text)
        at, words = 0, {}
        for j, line in enumerate(lines):
            words.setdefault(at, []).append((j, line.strip()))
            at += "\n" in (line if j else line.lstrip())
        for group in words.values():
            body = "\n".join(x for _, x in group)
            if 0 < len(body.split()) < 8:
                units.append((group[0][0], group[-1][0] + 1, body))
        gone = set()
        for a, b, body in sorted(units):
            at = first.setdefault(body, (k, b))
            if at[0] < k or at[1] <= a:
                gone |= set(range(a, b))
        assert got[k].text == (None if text is None else "".join(x for j, x in enumerate(lines) if j not in gone))


def test_fingerprints_and_components_against_brute_force(docs, texts):
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = max(1, len(words) - 2) if words else 0
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(n)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = S.near_groups(docs).collect()
    prints = {k: brute(t) for k, t in enumerate(texts)}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == prints
    links = [(a, b) for a in prints for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 2]
    assert {r.doc_id: r.component_id for r in rows} == roots(links, prints)


def test_links_of_close_fingerprints_lose_no_group(spark):
    rng, found = random.Random(3), set()
    for _ in range(150):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 7)):
            found.add(x - (1 << 64) if x >> 63 else x)
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
    found = sorted(found)
    table = spark.createDataFrame([(f,) for f in found], "fp long")
    got = {r.node: r.component for r in components(S.fingerprint_links(table)).collect()}
    links = [(a, b) for k, a in enumerate(found) for b in found[:k] if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2]
    assert links and {f: got.get(f, f) for f in found} == roots(links, found)


def test_ring_condition_follows_from_the_distance(spark):
    rng, rows = random.Random(8), []
    for _ in range(300):
        x = rng.getrandbits(63)
        y = x
        for _ in range(rng.randint(0, 4)):
            y ^= 1 << rng.randrange(63)
        rows.append((x, y))
    table = spark.createDataFrame(rows, "x long, y long")
    kept = table.select(S.on_ring(F.col("x"), F.col("y"), 2).alias("ring"), S.hamming(F.col("x"), F.col("y")).alias("n")).collect()
    assert all(r.ring for r in kept if r.n <= 2) and not all(r.ring for r in kept)


def test_near_copies_against_brute_force(docs, texts):
    got = {r.doc_id: r.component_id for r in S.near_copies(docs).collect()}
    sets = {k: frozenset(S.shingle_hashes(t, 5).tolist()) for k, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert got == roots(links, sets)
    assert S.keep_one(docs).count() == len(set(got.values()))


def test_near_copies_with_far_fingerprints_are_found(spark):
    """Pairs at 0.8 or more whose fingerprints differ in over 20 bits, which a Hamming bound would lose."""
    rng, rows, n = random.Random(12), [], 0
    while n < 12:
        words = [f"q{rng.randrange(10**9)}" for _ in range(9)]
        a, b = " ".join(words[:8]), " ".join(words)
        x, y = (S.fingerprint(S.shingle_hashes(t, 5)) for t in (a, b))
        if S.jaccard(a, b) >= 0.8 and ((x ^ y) & ((1 << 64) - 1)).bit_count() > 20:
            rows += [(2 * n, a), (2 * n + 1, b)]
            n += 1
    got = {r.doc_id: r.component_id for r in S.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k - k % 2 for k in range(2 * n)}


def test_contamination_against_brute_force(spark, docs, texts):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    items = {k: " ".join((t or "").split()[k % 3 : 14 + k]) for k, t in enumerate(texts[:9])}
    items |= {20: "w1x", 21: "w2x W3X", 22: "", 23: None, 24: items[1], 25: "w5x w6x w7x w8x"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = {r.doc_id: r for r in D.contamination(docs, bench).collect()}
    windows = defaultdict(set)
    for k, text in items.items():
        w = words(text)
        for s in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[s : s + 10])].add(str(k))
    for k, text in enumerate(texts):
        w, hit, owners = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                if tuple(w[s : s + size]) in windows:
                    hit |= set(range(s, s + size))
                    owners |= windows[tuple(w[s : s + size])]
        r = rows[k]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(owners), bool(hit))
        import hashlib

        assert r.items_sha256 == hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()
    assert D.contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_components_of_chains_hubs_and_loops(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (301, 300), (300, 301)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == roots(links, {n for pair in links for n in pair})


def test_global_order_has_every_place_once(spark):
    table = spark.createDataFrame([(k * 37 % 101, k) for k in range(300)], "a int, b int").repartition(7)
    rows = in_order(table, "a", "b").orderBy("at").collect()
    assert [r.at for r in rows] == list(range(300))
    assert [(r.a, r.b) for r in rows] == sorted((r.a, r.b) for r in rows)
