"""Structure and figure operators against SQL on random blocks, including one very large document."""

import random

import duckdb
import pytest

import oracles as O
from docstruct.operators import evidence as E
from docstruct.operators import figures as G
from docstruct.operators import structure as S
from docstruct.plans.corpus import REPORT_PLAN, Corpus
from pyspark.sql import functions as F

SCHEMA = (
    "doc_id bigint, block_id string, page_number int, order_index int, block_type string, text string, "
    "y0 double, max_size double"
)
POOL = [
    "Abstract", "1. Introduction", "RESULTS", "Results and Discussion", "Methods", "Conclusions", "Discussion",
    "Figure 1 compares accuracy of ours vs. theirs in a plot", "Fig. 1 | Overview of the pipeline (a) and (B) parts",
    "Fig. 2a: short text here", "As shown in Fig. 1, and (Fig.2A) the speed improves a lot over time.",
    "See Figure 1a and Figs. 1 for no hit, only text that is long enough to be a neighbour.", "Page 2", "17",
    "Downloaded from https://x.y", "Published online: 3 May 2019", "Ada Lovelace1, Alan Turing & Grace Hopper",
    "Nature Machine Intelligence | Volume 7", "Doe et al., wrote this in 2001", "https://doi.org/10.1038/s42256-019-1.",
    "doi 10.1000/abc.def-", "short", "tiny bit", "Article A very large title Check for updates",
    "We combine an approach. It was demonstrated! The accuracy", "increase is a viable path. Then nothing",
    "a sentence that does not end and has the code rate", "Science Advances 2020", "  ", "experi- mental evi- dence , ok .",
    "This long line is meant as an abstract candidate because it has more than eighty characters in it, surely.",
    "Another long line that is meant as an abstract candidate with more than eighty characters in it, for certain.",
]


def random_rows(seed, docs, most):
    rnd = random.Random(seed)
    rows = []
    for d in range(docs):
        n = most if d == 0 else rnd.randint(1, 45)
        page, slot = 1, 0
        for i in range(n):
            if slot and rnd.random() < 0.12:
                page, slot = page + rnd.choice([1, 1, 2]), 0
            text = rnd.choice(POOL)
            y0 = rnd.choice([10.0, 50.0, 100.0, 150.0, 230.0, 400.0])
            rows.append((d, f"p{page}_b{slot}", page, i, "text", text, y0, rnd.choice([8.0, 10.0, 12.5, 13.0, 18.0])))
            slot += 1
    return rows


@pytest.fixture(scope="module", params=[1, 2])
def both(request, spark):
    rows = random_rows(request.param, 150, 1500)
    con = duckdb.connect()
    con.execute(
        "CREATE TABLE blocks (doc_id BIGINT, block_id VARCHAR, page_number INT, order_index INT, block_type VARCHAR,"
        " text VARCHAR, y0 DOUBLE, max_size DOUBLE)"
    )
    con.executemany("INSERT INTO blocks VALUES (?, ?, ?, ?, ?, ?, ?, ?)", rows)
    return Corpus(spark.createDataFrame(rows, SCHEMA), staged=REPORT_PLAN), con


def compare(df, con, parts, select):
    res = con.execute("WITH " + ",".join(parts) + " " + select)
    names = [d[0] for d in res.description]
    theirs = sorted(repr(r) for r in res.fetchall())
    mine = sorted(repr(tuple(r)) for r in df.select(*names).collect())
    assert mine == theirs
    assert mine


def joined(c):
    return F.array_join(c, " | ").alias(c)


def test_positions_and_captions(both):
    corpus, con = both
    annotated = corpus.annotated.select("doc_id", "order_index", "text_pos", "is_heading", "section_seq", "caption_order")
    compare(annotated, con, [O.FLAGGED],
            "SELECT doc_id, order_index, text_pos, is_heading, CAST(section_seq AS BIGINT) AS section_seq, caption_order FROM an")


def test_front_matter(both):
    corpus, con = both
    front = corpus.front.select("doc_id", "title", joined("authors"), "venue", "year", "fallback_abstract")
    compare(
        front, con, [O.FLAGGED, O.TITLE],
        """, docs AS (SELECT DISTINCT doc_id FROM p1) SELECT d.doc_id, nullif(title, '') AS title, coalesce(authors, '') AS authors,
        nullif(venue, '') AS venue, year, nullif(abstract, '') AS fallback_abstract
        FROM docs d LEFT JOIN titles USING (doc_id) LEFT JOIN authors USING (doc_id) LEFT JOIN venues USING (doc_id)
        LEFT JOIN years USING (doc_id) LEFT JOIN abstracts USING (doc_id)""",
    )


def test_doi(both):
    corpus, con = both
    compare(S.best_doi(corpus.flagged).select("doc_id", "doi"), con, [O.FLAGGED, O.DOI], "SELECT doc_id, doi FROM dois")


def test_sections(both):
    corpus, con = both
    parts = [O.FLAGGED, O.TITLE, O.SECTIONS]
    headed = "SELECT doc_id, section_key, content, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INT) AS position FROM headed"
    compare(corpus.headed, con, parts, headed)
    keyword = S.keyword_sections(corpus.annotated, corpus.places)
    compare(keyword, con, parts, "SELECT doc_id, section_key, content FROM keyword_sections")


def test_all_sections(both):
    corpus, con = both
    compare(
        corpus.sections, con, [O.FLAGGED, O.TITLE, O.SECTIONS, O.FIGURES, O.ALL_SECTIONS],
        "SELECT doc_id, section_key, content, position, source FROM all_sections",
    )


def test_figures(both):
    corpus, con = both
    figures = corpus.figures.select(
        "doc_id", "caption_order", "figure_id", "caption", joined("reference_block_ids"), joined("referenced_text_spans")
    )
    compare(
        figures, con, [O.FLAGGED, O.FIGURES],
        """SELECT doc_id, caption_order, figure_id, caption, array_to_string(ref_ids, ' | ') AS reference_block_ids,
        array_to_string(spans, ' | ') AS referenced_text_spans FROM figures""",
    )


def test_evidence(both):
    corpus, con = both
    analyses = E.figure_analyses(E.figure_evidence(corpus.figures, E.figure_artifacts(corpus.figures))).select(
        "doc_id", "caption_order", "experiment_focus", joined("compared_items"), joined("metrics_or_axes"),
        joined("main_observations"), "consistency_check",
    )
    compare(
        analyses, con, [O.FLAGGED, O.FIGURES, O.ARTIFACTS],
        """SELECT doc_id, caption_order, experiment_focus, array_to_string(compared_items, ' | ') AS compared_items,
        array_to_string(metrics_or_axes, ' | ') AS metrics_or_axes, array_to_string(main_observations, ' | ') AS main_observations,
        consistency_check FROM analyses""",
    )


def test_rank_keeps_four_per_document(both):
    corpus, _ = both
    ranked = G.rank_figures(corpus.figures, G.rank_context(corpus.sections))
    assert ranked.groupBy("doc_id").count().filter("count > 4").count() == 0
    assert ranked.filter("doc_id = 0").count() == 4
