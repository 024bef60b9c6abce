import json

import pytest

from docstruct import constants as K
from docstruct import labels, schemas
from docstruct.functions import payload as P
from docstruct.operators import evidence as E
from docstruct.operators import responses as M
from pyspark.sql import functions as F


def responses(spark, *raw, kind="draft"):
    return spark.createDataFrame([(i, i, kind, r) for i, r in enumerate(raw)], schemas.RESPONSES)


@pytest.mark.parametrize(
    "raw, found",
    [
        ('x ```json {"a": 1} ``` {"b": 2}', '{"a": 1}'),
        ('``` {"a": {}} ```', '{"a": {}}'),
        ('text {"a": 1} more } end', '{"a": 1} more }'),
        ("no braces", None),
        ("} {", None),
        (None, None),
    ],
)
def test_extract_json(value, raw, found):
    assert value(P.extract_json, raw) == found


def test_read_objects_and_quality(spark):
    read = M.read_objects(
        responses(spark, '{"a": 1}', '```json\n{"a":\n"x\ny"}\n```', "[1]", '{"a": 1} {"b": 2}', "none", "{'a': 1}", '{"a"')
    )
    assert [r.status for r in read.orderBy("doc_id").collect()] == ["parsed", "parsed"] + ["fallback"] * 5
    assert {(r.status, r.n) for r in M.parse_quality(read).collect()} == {("parsed", 2), ("fallback", 5)}


def test_draft_keeps_text_with_raw_newline(spark):
    raw = """```json
{"title": "A Real Title", "authors": ["Ann One", "Bo Two"], "doi": "10.1/x", "venue": "Some Venue", "year": 2025,
 "abstract": "first
second", "sections": {"1. Introduction": "Text of it", "zeta": 5, "empty": ""}, "section_order": ["introduction"],
 "figures": [{"figure_id": "Figure 9", "page_number": "3", "caption": 7}, "x"], "discarded_noise": "one", "uncertainties": null}
```"""
    d = M.parse_drafts(responses(spark, raw)).first()
    assert (d.title, d.venue, d.year, d.abstract) == ("A Real Title", "Some Venue", "2025", "first second")
    assert d.authors == ["Ann One", "Bo Two"] and d.discarded_noise == ["one"] and d.uncertainties == []
    assert [(s.section_key, s.content) for s in d.sections] == [("introduction", "Text of it"), ("zeta", "5")]
    assert [(f.figure_id, f.page_number, f.caption) for f in d.figures] == [("Figure 9", 3, "7")]


def test_draft_limits(spark):
    raw = json.dumps({"title": "t" * 400, "authors": ["a" * 100] * 40})
    d = M.parse_drafts(responses(spark, raw)).first()
    assert len(d.title) == 300 and len(d.authors) == 30 and len(d.authors[0]) == 80


def test_apply_drafts(spark):
    structure = spark.createDataFrame(
        [(i, "Rule title", ["R A"], "10.1/r", None, "2020", "rule", 1, 1, [], ["n"], []) for i in range(2)],
        schemas.STRUCTURE,
    )
    sections = spark.createDataFrame(
        [(i, k, f"{k} text", p, "heading") for i in range(2) for p, k in enumerate(["title", "abstract", "results", "figures"])],
        schemas.SECTIONS,
    )
    figures = spark.createDataFrame(
        [(i, 0, "Figure 1", "cap", 1, ["b"], [], [], [], None) for i in range(2)], schemas.FIGURES
    )
    raw = json.dumps({"title": "New", "venue": "V", "sections": {"method": "m", "results": "new r"}, "section_order": ["results"]})
    meta, secs, figs = M.apply_drafts(structure, sections, figures, M.parse_drafts(responses(spark, raw, "bad")))
    rows = {r.doc_id: r for r in meta.collect()}
    assert (rows[0].title, rows[0].venue, rows[0].doi) == ("New", "V", "10.1/r")
    assert (rows[1].title, rows[1].venue) == ("Rule title", None)
    found = {}
    for r in secs.orderBy("doc_id", "position").collect():
        found.setdefault(r.doc_id, []).append((r.section_key, r.content))
    assert [k for k, _ in found[0]] == ["title", "results", "abstract", "method", "figures"]
    assert dict(found[0])["results"] == "new r" and dict(found[0])["title"] == "New"
    assert [k for k, _ in found[1]] == ["title", "abstract", "results", "figures"]
    assert figs.count() == 2


def evidence(spark, n):
    row = ("Figure 1", "cap", 1, "line_chart", ["a", "b"], ["time"], ["e1"], ["r1"], "noop", "中", [])
    return spark.createDataFrame([(i, 0, *row) for i in range(n)], schemas.EVIDENCE)


def reply():
    item = {"figure_id": "Figure 1", "figure_title_or_caption": "A", "main_observations": ["one\ntwo"], "metrics_or_axes": "speed",
            "claimed_conclusion": "c" * 300, "confidence": ""}
    return "```json\n" + json.dumps({"analyses": [item, 3]}) + "\n```"


def test_parse_analyses(spark):
    rows = {r.doc_id: r for r in M.parse_analyses(responses(spark, reply(), "no object"), evidence(spark, 2)).collect()}
    assert rows[0].main_observations == ["one two"] and rows[0].metrics_or_axes == ["speed"]
    assert len(rows[0].claimed_conclusion) == 280 and rows[0].confidence == labels.text("insufficient")
    assert rows[1].claimed_conclusion == labels.text("insufficient")
    assert rows[1].consistency_check.startswith("自动回退") and rows[1].confidence == "中"


def test_old_limit_makes_long_replies_unreadable(spark):
    one = responses(spark, reply())
    assert M.parse_analyses(one, evidence(spark, 1), K.REPLY_CHARS_FIGURES).first().consistency_check.startswith("自动回退")


def test_parse_or_keep(spark):
    raw = json.dumps({"evidences": [{"figure_id": "F", "direct_evidence": ["d"] * 9}, "x"]})
    got = M.parse_or_keep(
        responses(spark, raw, '{"evidences": ["x"]}'), "evidences", K.EVIDENCE_LIMITS, evidence(spark, 2), "evidence_quality"
    )
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows[0].direct_evidence) == 6 and rows[0].figure_id == "F" and rows[1].figure_id == "Figure 1"


def test_every_document_keeps_one_set_of_analyses(spark):
    rows = [(1, 0, "figures", reply()), (2, 0, "figures", "bad"), (3, 1, "figures", "bad"), (4, 1, "figures", reply())]
    got = M.parse_analyses(spark.createDataFrame(rows, schemas.RESPONSES), evidence(spark, 3)).collect()
    assert sorted((r.doc_id, r.main_observations == ["one two"]) for r in got) == [(0, False), (1, True), (2, False)]


def test_panels_of_replies_are_kept(spark):
    figures = spark.createDataFrame([(k, 0, "cap (a)", 1, "Figure 1") for k in range(2)], "doc_id long, caption_order int, caption string, page_number int, figure_id string")
    fallback = figures.select("doc_id", "caption_order", "page_number", "figure_id", E.caption_panels(F.col("caption"), F.col("figure_id")).alias("panels"), F.lit("x").alias("confidence"))
    raw = json.dumps({"artifacts": [{"figure_id": "F", "panels": [{"panel_id": "p", "axes": ["x"]}, 3]}]})
    rows = {r.doc_id: r for r in M.parse_or_keep(responses(spark, raw), "artifacts", K.ARTIFACT_LIMITS, fallback, "confidence").collect()}
    assert [(p.panel_id, p.axes, p.summary) for p in rows[0].panels] == [("p", ["x"], "")] and rows[1].panels[0].panel_label == "a"


def test_long_drafts_are_read_whole(spark):
    raw = json.dumps({"title": "T", "abstract": "x" * 130000})
    assert M.parse_drafts(responses(spark, raw)).first().title == "T"
    assert M.parse_drafts(responses(spark, raw), K.REPLY_CHARS_DRAFT).first().title == ""


PAPER = {
    "metadata": {"title": ["A", " B "], "authors": "Solo", "year": 2024},
    "extracted_notes": "wrong",
    "novelty": None,
    "strengths": ["s", " "],
    "limitations": "l",
    "reproducibility": "r",
}


def test_normalise_paper(value):
    got = value(M.normalise_paper, json.dumps(PAPER))
    assert got.metadata.title == "A B" and got.metadata.authors == ["Solo"] and got.metadata.year == "2024"
    assert got.extracted_notes.datasets == [] and got.novelty == "" and got.strengths == ["s"] and got.limitations == ["l"]


def test_paper_checks(value):
    assert value(M.looks_like_paper, json.dumps(PAPER)) is True
    assert value(M.looks_like_paper, '{"metadata": {}}') is False
    assert value(M.is_valid_paper, json.dumps(PAPER)) is False
    assert value(M.is_valid_paper, '{"metadata": {"title": "t"}, "strengths": []}') is True
    assert value(M.paper_or_default, json.dumps(PAPER)).metadata.title == ""


def test_prompts(spark):
    docs = spark.createDataFrame([(1, None, "body")], "doc_id bigint, title string, focus_text string")
    prompt = M.reader_prompts(docs, M.RESEARCH_PAPER).first().prompt
    assert labels.text("untitled_document") in prompt and "body" in prompt and "6. Results" in prompt
    assert "markdown_report" in M.analyst_prompts(docs, M.GENERAL_TEXT).first().prompt
    blocks = spark.createDataFrame(
        [(1, "p1_b0", 1, 0, "text", "x" * 300, 0.0, 9.0, [], None), (1, "p1_b1", 1, 1, "image", "", 0.0, 0.0, [], None)],
        schemas.BLOCKS,
    )
    shown = M.structuring_prompts(blocks, docs.select("doc_id", "title")).first().prompt
    assert "- p1_b0 | page=1 | type=text | text=" + "x" * 240 + "\n- p1_b1 | page=1 | type=image" in shown
    ev = evidence(spark, 1)
    assert '"figure_type":"line_chart"' in M.figure_prompts(ev, "figures", "Analyse.", evidences=ev).first().prompt


def test_user_functions(spark):
    docs = spark.createDataFrame([(1, "p")], "doc_id bigint, prompt string")

    def model(batch):
        return batch.assign(raw=batch["prompt"] + "!")[["doc_id", "raw"]]

    assert M.apply_model(docs, model, "doc_id bigint, raw string").first().raw == "p!"
    assert E.extract_semantics(docs, model, "doc_id bigint, raw string").first().raw == "p!"


def test_figure_golden(spark):
    figures = spark.createDataFrame(
        [(1, 0, "Figure 1", "Figure 1 shows accuracy and latency of (a) x vs. (B) y", 2, ["b"], ["c"],
          ["In Figure 1 the accuracy grows."], ["img/1.png", "img/2.png"], "pages/2.png")],
        schemas.FIGURES,
    )
    artifact = E.limit_artifacts(E.figure_artifacts(figures)).first()
    assert artifact.axes == ["accuracy", "latency"] and artifact.crop_path == "img/1.png"
    assert artifact.figure_type == "result_figure" and artifact.confidence == "中"
    assert [p.panel_id for p in artifact.panels] == ["Figure 1_a", "Figure 1_b"]
    assert artifact.direct_evidence[-1] == labels.text("evidence_image") and artifact.uncertainties == []
    ev = E.figure_evidence(figures, E.figure_artifacts(figures))
    assert ev.first().compared_items == ["Figure 1 shows accuracy and latency of (a) x", ". (B) y In Figure 1 the accuracy grows."]
    analysis = E.figure_analyses(ev).first()
    assert analysis.claimed_conclusion == labels.text("insufficient")
    alone = E.figure_evidence(figures, E.figure_artifacts(figures).limit(0)).first()
    assert alone.figure_type == "unknown" and alone.evidence_quality == "低" and len(alone.direct_evidence) == 1
