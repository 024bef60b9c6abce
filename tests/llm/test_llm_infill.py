"""Fill-in-the-middle against a plain version, and back again."""

import hashlib
import random
import re

import pytest

from docstruct.llm import infill as I


def plain_version(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if text == "" or re.search("<[PSM]>", text):
        return n, "plain", None, None, text, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if h[3] % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(k, "".join(rng.choice(["a", "é", "𝒳", "\n", "\n\n", "word ", "\r"]) for _ in range(rng.randint(0, 60)))) for k in range(80)]
    odd = ["", None, "\n", "\n\n\n", "no line end", "a<P>b\nc\n", "x\n<M>", "<S>", "< P>\n<p>\n", "ß" * 50_000, "long\n" * 30_000]
    out += [(100 + k, t) for k, t in enumerate(odd)]
    out += [(7, "another text\nunder an id that is taken\n"), (None, "no id\nat all\n"), (None, None), (None, "no id\nat all\n")]
    return out + [(55, "the same row\nthree times\n")] * 3 + [(300 + k, "one text\nmany ids\n") for k in range(20)]


def expected(rows, digest=lambda x: x):
    return sorted(((d, *p[:4], digest(p[4]), digest(p[5])) for d, t in rows for p in [plain_version(d, t)]), key=repr)


def test_texts(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    done = I.infill_texts(docs, size=1000)
    assert sorted(map(tuple, done.collect()), key=repr) == expected(rows)


def test_digests(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    done = I.infill_digests(docs)
    assert done.dtypes[0] == ("doc_id", "bigint")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted(map(tuple, done.collect()), key=repr) == expected(rows, digest)


def test_pieces_are_bounded_and_ordered(spark):
    text = "some line\n" * 2000
    pieces = I.sorted_pieces(I.infill_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), size=64)).collect()
    assert [p.place for p in pieces] == list(range(len(pieces)))
    assert max(len(p.piece) for p in pieces) <= 64
    assert "".join(p.piece for p in pieces) == plain_version(1, text)[4]


def test_rates(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "'a\nb\nc\n' AS text")
    assert {r.form for r in I.infill_texts(docs, rate=0).collect()} == {"plain"}
    assert {r.form for r in I.infill_texts(docs, suffix_first=0).collect()} == {"psm"}
    some = [r.form for r in I.infill_texts(docs, rate=50, suffix_first=100).collect()]
    assert 100 < some.count("plain") < 200 and set(some) == {"plain", "spm"}


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, key string")
    assert I.infill_digests(none).count() == 0
    one = spark.createDataFrame([(1, "a\nb", "k", 2, "o", 9)], "doc_id long, text string, key string, place int, output string, n int")
    assert tuple(I.infill_texts(one).first()) == (1, *plain_version(1, "a\nb"))
