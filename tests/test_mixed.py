"""From files to reports: both kinds of documents, drafts upstream of everything, figure replies."""

import json

import pytest

from docstruct import schemas
from docstruct.plans import mixed as X
from docstruct.plans.corpus import Corpus
from docstruct.sources.seed import seeded_blocks


def span(path, page, block, text, kind="text", box=(0.0, 0.0, 400.0, 300.0), size=10.0, image=None):
    return (path, page, block, 0, 0, text, size, list(box), kind, image)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("uploads")
    (out / "a.txt").write_text("  A plain text\nwith two lines.\n")
    (out / "b.md").write_text("# Marked up\n\nText.")
    (out / "c.pdf").write_bytes(b"%PDF")
    (out / "d.exe").write_bytes(b"x")
    return out


@pytest.fixture(scope="module")
def tables(spark, folder, tmp_path_factory):
    path = f"file:{folder}/c.pdf"
    spans = [
        span(path, 1, 0, "A parsed title", size=18.0, box=(0.0, 40.0, 300.0, 60.0)),
        span(path, 1, 1, "Abstract", box=(0.0, 90.0, 300.0, 100.0)),
        span(path, 1, 2, "This is what the parsed abstract says about it.", box=(0.0, 110.0, 300.0, 130.0)),
        span(path, 2, 0, "", "image", image="c/p2_0.png"),
        span(path, 2, 1, "Figure 1 compares accuracy of both.", box=(0.0, 310.0, 300.0, 330.0)),
        span("file:/elsewhere/z.pdf", 1, 0, "Not among the files"),
    ]
    schema = schemas.SPANS.replace("doc_id bigint", "doc_id string")
    replies = [
        (1, path, "draft", json.dumps({"title": "A drafted title", "sections": {"Results": "Drafted results."}})),
        (2, path, "analyses", json.dumps({"analyses": [{"figure_id": "Figure 1", "claimed_conclusion": "Both are good."}]})),
        (3, f"file:{folder}/a.txt", "draft", json.dumps({"title": "No draft for plain texts"})),
    ]
    results = [(f"file:{folder}/a.txt", "", "It has two lines.", ["short"], [], "", "{}")]
    out = str(tmp_path_factory.mktemp("out"))
    X.run_files(
        spark, f"file:{folder}", spark.createDataFrame(spans, schema), out,
        spark.createDataFrame(results, schemas.RESULTS.replace("doc_id bigint", "doc_id string")),
        spark.createDataFrame(replies, schemas.RESPONSES.replace("doc_id bigint", "doc_id string")),
    )
    return {
        "reports": {r.doc_id[-5:]: r.markdown_report for r in spark.read.parquet(f"{out}/markdown_reports").collect()},
        "json": {r.doc_id[-5:]: r.asDict() for r in spark.read.json(f"{out}/json_reports").collect()},
        "focus": {r.doc_id[-5:]: r.focus_text for r in spark.read.parquet(f"{out}/focus").collect()},
        "prompts": {r.doc_id[-5:]: r.prompt for r in spark.read.parquet(f"{out}/reader_prompts").collect()},
        "parsed": spark.read.parquet(f"{out}/parsed_markdown").collect(),
        "rejected": spark.read.parquet(f"{out}/rejected").collect(),
    }


def test_every_accepted_file_has_its_report(tables):
    assert set(tables["reports"]) == {"a.txt", "/b.md", "c.pdf"}
    assert [(r.path[-5:], r.reason) for r in tables["rejected"]] == [("d.exe", "unsupported_suffix")]
    assert "It has two lines." in tables["reports"]["a.txt"] and "A plain text" in tables["reports"]["a.txt"]
    assert [r.name[-15:] for r in tables["parsed"]] == ["c.pdf.parsed.md"] and "A parsed title" in tables["parsed"][0].markdown


def test_drafts_come_before_focus_and_reports(tables):
    assert "标题：A drafted title" in tables["reports"]["c.pdf"]
    assert "## Results\nDrafted results." in tables["focus"]["c.pdf"] and "parsed abstract" in tables["focus"]["c.pdf"]
    assert "A drafted title" in tables["prompts"]["c.pdf"] and "A plain text" in tables["prompts"]["a.txt"]
    assert tables["focus"]["a.txt"] == "A plain text\nwith two lines."


def test_figure_replies_and_images(tables):
    data = json.loads(tables["json"]["c.pdf"]["structured_data"])
    assert [a["claimed_conclusion"] for a in data["figure_analyses"]] == ["Both are good."]
    assert "Both are good." in tables["reports"]["c.pdf"]
    assert data["semantic_artifacts"][0]["image_block_paths"] == ["c/p2_0.png"]
    assert data["source_structure"] == {
        "parser_kind": "pdf", "page_count": 2, "doi": "", "section_order": ["title", "abstract", "results", "figures"], "figure_count": 1
    }
    plain = json.loads(tables["json"]["a.txt"]["structured_data"])
    assert plain["source_structure"] == {"parser_kind": "plain_text", "page_count": None, "doi": "", "section_order": [], "figure_count": 0}


def test_without_texts_and_replies_the_parse_stands(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 12")
    parsed = Corpus(seeded_blocks(docs), staged=X.PARSED_PLAN)
    same = X.MixedCorpus(parsed)
    key = lambda rows: sorted(map(tuple, rows))
    columns = ["doc_id", "section_key", "content"]
    assert key(same.sections.select(*columns).collect()) == key(parsed.sections.select(*columns).collect())
    order = ["doc_id", "section_order", "figure_count", "title", "authors"]
    assert key(same.structure.select(*order).collect()) == key(parsed.structure.select(*order).collect())
    assert key(same.focus.select("doc_id", "focus_text").collect()) == key(parsed.focus.select("doc_id", "focus_text").collect())
    assert same.analyses.count() == parsed.analyses.count()
