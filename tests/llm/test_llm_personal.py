"""Personal data against the patterns as stated and a plain version of the bootstrapping."""

import hashlib
import random
import re

import pytest
import regex

from docstruct.llm import personal as P

STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
    return True


def seeds(text):
    return [(k, m.start(), m.end()) for k, p in STATED.items() for m in re.finditer(p, text) if passes(k, m.group())]


def context_patterns(text, prev, start, end, nxt):
    plain = lambda s: regex.sub(r"\s+", " ", re.sub("[0-9]+", "0", s.lower()))
    before, after = plain(text[max(prev, start - 48) : start]), plain(text[end : min(nxt, end + 48)])
    one = regex.search(r"\p{L}{1,24}[^\p{L}]{0,8}$", before)
    two = regex.search(r"\p{L}{1,24}[^\p{L}]{1,8}\p{L}{1,24}[^\p{L}]{0,8}$", before)
    right = regex.search(r"^[^\p{L}]{0,8}\p{L}{1,24}", after)
    out = [f"1:{one.group()}"] if one else []
    out += [f"2:{two.group()}"] if two else []
    return out + ([f"3:{one.group()}_{right.group()}"] if one and right else [])


def plain_version(rows):
    """Spans of every row, base ones and all, by a scan of each text and dictionaries."""
    token = "[0-9A-Za-z@._%+/#-]"
    occurrences, edges, known = [], {}, {}
    for row, (_, text) in enumerate(rows):
        text = text or ""
        base = seeds(text)
        found = []
        for kind, p in STATED.items():
            ms = list(re.finditer(p, text))
            for k, m in enumerate(ms):
                if passes(kind, m.group()):
                    prev = ms[k - 1].end() if k else 0
                    nxt = ms[k + 1].start() if k + 1 < len(ms) else len(text)
                    found.append((kind, m.group(), context_patterns(text, prev, m.start(), m.end(), nxt)))
                    known.setdefault(m.group(), {})[kind] = 1000
        ms = [m for m in re.finditer(rf"{token}+", text) if len(re.findall("[0-9]", m.group())) >= 4]
        for k, m in enumerate(ms):
            hit = re.sub("^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "", m.group())
            start = m.start() + m.group().index(hit)
            end = start + len(hit)
            if any(s < end and e > start for _, s, e in base):
                continue
            prev = ms[k - 1].end() if k else 0
            nxt = ms[k + 1].start() if k + 1 < len(ms) else len(text)
            found.append((None, hit, context_patterns(text, prev, start, end, nxt)))
            occurrences.append((row, hit, start, end))
        for _, hit, patterns in found:
            for p in patterns:
                edges.setdefault(p, set()).add(hit)
    first, size = {h: dict(k) for h, k in known.items()}, sum(map(len, known.values()))
    for _ in range(P.ROUNDS):
        accepted = {}
        for p, hits in edges.items():
            for kind in STATED:
                scores = [known[h][kind] for h in hits if kind in known.get(h, {})]
                if len(scores) >= P.SUPPORT and sum(scores) // len(hits) >= P.CONFIDENCE:
                    accepted[p, kind] = sum(scores) // len(hits)
        known = {h: dict(k) for h, k in first.items()}
        for (p, kind), confidence in accepted.items():
            for h in edges[p]:
                scores = known.setdefault(h, {})
                scores[kind] = max(scores.get(kind, 0), confidence)
        if sum(map(len, known.values())) == size:
            break
        size = sum(map(len, known.values()))
    order = list(STATED)
    more = [(row, min(known[h], key=lambda k: (-known[h][k], order.index(k))), s, e) for row, h, s, e in occurrences if known.get(h)]
    out = []
    for row, (doc, text) in enumerate(rows):
        base = seeds(text or "")
        every = sorted(base + [(k, s, e) for r, k, s, e in more if r == row], key=lambda x: (order.index(x[0]), *x[1:]))
        show = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        counts = [sum(k == kind for k, _, _ in base) for kind in order]
        out.append((doc, *counts, hashlib.sha256(show(base).encode()).hexdigest(), show(every)))
    return sorted(out, key=repr)


def table(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, P.personal_table(docs).collect()), key=repr)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(4)
    word = lambda: rng.choice(["ruth", "asked", "over", "the", "mill", "ä", "stone"])
    around = lambda x: f"{word()} {word()} {x} {word()}."
    rows = [(100 + k, around(f"phone: +1 (743) 555-38{k:02}")) for k in range(60)]
    rows += [(k, around(f"Phone: 555-31{k}")) for k in range(10, 25)]  # no base span; the context tells
    rows += [(30 + k, around(f"reach me under 555-31{k}")) for k in range(10, 25)]  # known by then
    rows += [(500, around("reach me under 555-3999")), (501, around("invoice 2024-3999"))]
    rows += [(90 + k, around(f"mail to ann{k}@b.example.com")) for k in range(5)]
    return rows + [(60 + k, around(f"the year {1900 + k}")) for k in range(20)]


def test_contexts_find_more(spark, planted):
    done = table(spark, planted)
    assert done == plain_version(planted)
    spans = {r[0]: r[-1] for r in done}
    assert all(spans[k].startswith("phone:") for k in (10, 15, 24, 45, 54))
    assert all(spans[k] == "" for k in (501, *range(60, 80)))
    assert spans[500].startswith("phone:")  # by the pattern that the second round found


def test_odd_rows(spark):
    odd = [None, "", "@", "a@b", "a@b.c", "a@b.c_d@e.f", "a@b..c@d.e", "x@y.z.", "a@-.-", "é@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4", "1.2.3"]
    odd += ["4111111111111111", "4111 1111-1111 1111", "4111  1111 1111 1111", "4111111111111112", "4111-1111-1111-1111-", "+1 (743) 555-3824", "+1", "+12", "++1 2345678 ("]
    odd += ["𝒳𝒳 a@b.c 𝒳 1.2.3.4", "1" * 3000, "1 " * 3000, "a." * 3000 + "@", "x@" + "a." * 3000, "a@b.c " * 500, "4111111111111111 " * 3, "1234#1234", "..1234.."]
    rows = list(enumerate(odd)) + [(4, "other text with this id: 10.0.0.1"), (None, "a@b.c"), (None, "a@b.c"), (None, None)] + [(77, "+49 30 1234567")] * 4
    assert table(spark, rows) == plain_version(rows)


def test_random_texts(spark):
    rng = random.Random(9)
    make = lambda chars, n: "".join(rng.choice(chars) for _ in range(rng.randint(0, n)))
    rows = [(k, make(rng.choice(["a.@-_ 1", "12. 5", "+1 ()-", "0123456789 -", "a1@. +-\n(é"]), 60)) for k in range(900)]
    assert table(spark, rows) == plain_version(rows)


def test_long_runs_take_no_longer(spark):
    """Texts on which the patterns as stated need a time that grows with the square, and the spans they have."""
    texts = {"a" * 400_000: 0, "1" * 400_000: 0, "1.1.1.1." * 50_000: 50_000, "a.@" * 100_000: 0, "+1(" * 100_000: 0, "a@b." + "c." * 150_000: 1, "1 1-" * 100_000: 0}
    done = table(spark, list(enumerate(texts)))
    assert [sum(r[1:5]) for r in sorted(done)] == list(texts.values())


def test_empty_table_and_clashing_columns(spark):
    assert P.personal_table(spark.createDataFrame([], "doc_id long, text string, kind string")).count() == 0
    docs = spark.createDataFrame([(1, "x a@b.c", 5, "k", 2, 1)], "doc_id long, text string, kind int, k string, start int, d int")
    assert P.personal_table(docs).first().spans == "email:2:7"
    assert tuple(P.masked(docs).first()) == (1, "x [email]", 5, "k", 2, 1)


def test_masked(spark):
    texts = ["mail a@b.c or 1.2.3.4, +1 (743) 555-3824.", None, "", "nothing", "é a@1.2.3.4 é", "𝒳 4111111111111111"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    done = [r.text for r in P.masked(docs).orderBy("doc_id").collect()]
    assert done == ["mail [email] or [ip], [phone].", None, "", "nothing", "é [email] é", "𝒳 [card]"]


def test_only_dataframe_operations(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = P.personal_table(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExternalRDD", plan)
