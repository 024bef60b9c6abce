from docstruct.operators.figures import extract_figures
from docstruct.operators.blocks import annotate_blocks, flag_blocks
from docstruct.schemas import SPANS
from docstruct.sources import files as S
from docstruct.sources import sinks
from pyspark.sql import functions as F


def test_read_text_corpus(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n\n  Example Title\n\nSecond line.\n", encoding="utf-8")
    (tmp_path / "b.md").write_text("\xa0\n", encoding="utf-8")
    docs = {r.path.rsplit("/", 1)[1]: r for r in S.read_text_corpus(spark, str(tmp_path)).collect()}
    assert docs["a.txt"].title == "Example Title"
    assert docs["a.txt"].raw_text == docs["a.txt"].markdown == "Example Title\n\nSecond line."
    assert docs["b.md"].title is None and docs["b.md"].raw_text == ""
    assert docs["a.txt"].parser_kind == "plain_text"


def test_validate_files(spark, tmp_path):
    for name, content in {"a.PDF": "x", "b.md": "x", "c.txt": "x", "d.docx": "x", "e.txt": "", "name": "x"}.items():
        (tmp_path / name).write_text(content)
    ok, _ = S.validate_files(S.read_uploads(spark, str(tmp_path)))
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in ok.collect()}
    assert kinds == {"a.PDF": "pdf", "b.md": "plain_text", "c.txt": "plain_text"}
    listed = [(p.name, p.stat().st_size) for p in tmp_path.iterdir()]
    ok, rejected = S.validate_files(spark.createDataFrame(listed, "path string, length bigint"))
    assert {r.path for r in ok.collect()} == {"a.PDF", "b.md", "c.txt"}
    assert {r.path: r.reason for r in rejected.collect()} == {
        "d.docx": "unsupported_suffix", "e.txt": "empty_file", "name": "unsupported_suffix",
    }


def test_route(spark):
    rows = S.route_documents(spark.createDataFrame([("x/a.PDF",), ("b.txt",)], "path string")).collect()
    assert [r.route for r in rows] == ["pdf", "plain_text"]


def spans(spark):
    box = [0.0, 12.0, 100.0, 60.0]
    rows = [
        (1, 1, 0, 0, 0, "The ", 10.0, box, "text", None),
        (1, 1, 0, 0, 1, "ﬁrst\xa0 line", 12.0, box, "text", None),
        (1, 1, 0, 1, 0, "   ", 30.0, box, "text", None),
        (1, 1, 0, 2, 0, "next", 9.0, box, "text", None),
        (1, 1, 1, 0, 0, " \t", 9.0, box, "text", None),
        (1, 1, 2, None, None, None, None, [0.0, 0.0, 39.0, 80.0], "image", "small.png"),
        (1, 1, 3, None, None, None, None, [0.0, 5.0, 40.0, 45.0], "image", "kept.png"),
        (1, 2, 0, 0, 0, "Fig. 1 | A caption of the page", 9.0, box, "text", None),
        (1, 2, 1, None, None, None, None, [0.0, 0.0, 90.0, 90.0], "image", "two.png"),
    ]
    return spark.createDataFrame(rows, SPANS)


def test_assemble_blocks(spark):
    blocks = S.assemble_blocks(spans(spark)).orderBy("order_index").collect()
    assert [(b.block_id, b.order_index, b.block_type) for b in blocks] == [
        ("p1_b0", 0, "text"), ("p1_b3", 1, "image"), ("p2_b0", 2, "text"), ("p2_b1", 3, "image"),
    ]
    assert blocks[0].text == "The first line next"
    assert blocks[0].max_size == 12.0 and blocks[0].y0 == 12.0
    assert blocks[1].text == "" and blocks[1].max_size == 0.0 and blocks[1].image_path == "kept.png"


def test_images_of_one_place_all_stay(spark):
    large, small = [0.0, 0.0, 50.0, 50.0], [0.0, 0.0, 50.0, 9.0]
    rows = [
        (1, 1, 0, None, None, None, None, large, "image", "a.png"), (1, 1, 0, None, None, None, None, large, "image", "b.png"),
        (1, 1, 0, None, None, None, None, None, "image", "no box.png"), (1, 1, 0, None, None, None, None, small, "image", "low.png"),
        (1, 1, 0, None, 0, "text beside", None, small, "text", None), (1, 1, 1, 0, 0, "x", 1.0, large, "drawing", None), (1, 1, 2, 0, 0, None, 1.0, large, "text", None),
    ]
    blocks = S.assemble_blocks(spark.createDataFrame(rows, SPANS)).collect()
    assert sorted((b.block_type, b.text, b.image_path) for b in blocks) == [("image", "", "a.png"), ("image", "", "b.png"), ("text", "text beside", None)]
    assert sorted(b.order_index for b in blocks) == [0, 1, 2] and {b.block_id for b in blocks} == {"p1_b0"}


def test_images_and_snapshots(spark):
    blocks = S.assemble_blocks(spans(spark))
    pages = spark.createDataFrame([(1, 2, "pages/2.png")], "doc_id bigint, page_number int, page_snapshot_path string")
    figure = extract_figures(blocks, annotate_blocks(flag_blocks(blocks)), pages).first()
    assert figure.image_block_paths == ["two.png"]
    assert figure.page_snapshot_path == "pages/2.png"
    assert figure.referenced_text_spans == []


def test_sinks(spark, tmp_path):
    parsed = spark.createDataFrame(
        [(1, "pdf", "# x"), (2, "pdf", ""), (3, "plain_text", "y")], "doc_id bigint, parser_kind string, markdown string"
    )
    sinks.write_parsed_markdown(parsed, f"{tmp_path}/parsed")
    assert [(r.doc_id, r.name) for r in spark.read.parquet(f"{tmp_path}/parsed").collect()] == [(1, "1.parsed.md")]
    sinks.write_json_reports(parsed, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 3
    reports = parsed.select("doc_id", F.col("markdown").alias("markdown_report"))
    sinks.write_markdown_reports(reports, f"{tmp_path}/md")
    assert spark.read.parquet(f"{tmp_path}/md").count() == 3
    sinks.export_text_files(reports.filter("doc_id <> 2"), f"{tmp_path}/files", "doc_id", "markdown_report")
    assert "# x" in [p.read_text().strip() for p in (tmp_path / "files").glob("name=1/*.txt")]
