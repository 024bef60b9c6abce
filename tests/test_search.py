import random
import re

from docstruct.operators import search as Q
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string"


def expected_hits(text, keyword, max_hits, window):
    """The rule as a pattern: the first matches of the trimmed keyword in any case that do not overlap."""
    plain = re.sub("\r\n?", "\n", text)
    spots = [m.start() for m in re.finditer(re.escape(keyword.strip()), plain, re.IGNORECASE)][:max_hits]
    return [
        (number, spot, plain[max(spot - window, 0) :][: min(spot, window) + len(keyword) + window].strip().replace("\n", " "))
        for number, spot in enumerate(spots, 1)
    ]


def test_keyword_search_follows_the_rule(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aAb\n\r .é$\\E") for _ in range(rnd.randint(0, 120))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    for keyword in ("a", "Ab ", "aa", "\\E", "$", ".", "é b"):
        found = {}
        for r in Q.keyword_search(docs, keyword, 4, 6).collect():
            found.setdefault(r.doc_id, []).append((r.hit_no, r.position, r.snippet))
        for i, text in enumerate(texts):
            assert sorted(found.get(i, [])) == expected_hits(text, keyword, 4, 6), (keyword, text)


def test_many_keywords_equal_single_searches(spark):
    docs = spark.createDataFrame([(0, "one two One"), (1, "two"), (2, "")], DOCS)
    many = Q.multi_keyword_search(docs, ["one", "two", " ", "one"], 5, 4)
    single = Q.keyword_search(docs, "one", 5, 4).withColumn("keyword", F.lit("one")).unionByName(
        Q.keyword_search(docs, "two", 5, 4).withColumn("keyword", F.lit("two"))
    )
    columns = ["doc_id", "keyword", "hit_no", "position", "snippet"]
    assert sorted(many.select(columns).collect()) == sorted(single.select(columns).collect())


def test_messages(spark):
    docs = spark.createDataFrame([(0, "find me"), (1, "nothing")], DOCS)
    rows = {r.doc_id: r for r in Q.keyword_messages(docs, "ME").collect()}
    assert rows[0].message == "[Hit 1] ...find me..." and rows[1].status == "no_match"
    assert {r.status for r in Q.keyword_messages(docs, "  ").collect()} == {"empty_keyword"}
    assert Q.keyword_search(docs, "").count() == 0


def test_extract_section(spark):
    text = "Title\r\nAbstract:\nshort\n1. Methods\nwe do\nIV) Findings\nfound\nSummary -\nend"
    docs = spark.createDataFrame([(0, text), (1, "no headings here")], DOCS)

    def section(name):
        return {r.doc_id: (r.status, r.content) for r in Q.extract_section(docs, name).collect()}

    assert section("Method")[0] == ("found", "1. Methods\nwe do")
    assert section("results")[0] == ("found", "IV) Findings\nfound\nSummary -\nend")
    assert section(" methods ")[0] == ("found", "1. Methods\nwe do")
    assert section("unknown")[0] == ("not_found", None)
    assert section("introduction")[0] == ("not_found", None)
    assert section("abstract")[0] == ("found", "Abstract:\nshort")
    assert section("abstract")[1] == ("prefix", "no headings here")
    # A trailing "Summary -" keeps its space after the dash is cut, so it is no heading.
    assert section("conclusion")[0] == ("not_found", None)


def test_section_is_cut_at_4000(spark):
    docs = spark.createDataFrame([(0, "Results\n" + "x" * 9000), (1, "y" * 9000)], DOCS)
    assert len(Q.extract_section(docs, "results").filter("doc_id = 0").first().content) == 4000
    assert len(Q.extract_section(docs, "abstract").filter("doc_id = 1").first().content) == 2500
    whole = Q.extract_section(docs, "results", limit=None).filter("doc_id = 0").first().content
    assert len(whole) == 9008 and len(Q.extract_section(docs, "abstract", prefix_limit=None).filter("doc_id = 1").first().content) == 9000
