import json

import duckdb
import pytest

import oracles
from docstruct import schemas
from docstruct.operators import reports as R
from docstruct.operators import responses as M
from docstruct.plans import run
from docstruct.plans.corpus import REPORT_PLAN, Corpus
from docstruct.plans.queries import QUERIES
from docstruct.sources.seed import seeded_blocks
from docstruct.streaming.ingest import ingest_blocks, ingest_texts
from pyspark.sql import functions as F

PAPER = {
    "metadata": {"title": "", "authors": ["Ann One"], "venue": "V", "year": "2024"},
    "extracted_notes": {"research_problem": "", "core_method": "# m", "datasets": ["D1", "D2"], "experimental_setup": "", "main_results": ""},
    "novelty": "", "strengths": ["- s"], "limitations": [], "reproducibility": "yes",
}


def results(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schemas.RESULTS)


def chapter(text, name):
    return text.split(name + "\n", 1)[1].split("\n#", 1)[0].strip()


def test_general_and_paper_reports(spark):
    docs = spark.createDataFrame([(0, "Doc title"), (1, "Other")], "doc_id bigint, title string")
    given = results(
        spark,
        ("", "sum", ["k"], [], "", '{"sections": {"a_b": "x", "list": ["q", "w"]}, "datasets": [], "n": 0}'),
        ("", "sum", [], ["l"], "", json.dumps(PAPER)),
    )
    rows = {r.doc_id: r for r in R.result_reports(M.complete_results(given, docs), "通用文本分析报告").collect()}
    general, paper = rows[0].markdown_report, rows[1].markdown_report
    assert general.startswith("# 通用文本分析报告\n\n## 标题\nDoc title\n\n## 摘要\nsum\n\n## 要点\n- k\n\n## 局限性\n- 未明确说明\n")
    assert "### 章节信息\n- **A B：** x\n- **List：** ['q', 'w']\n\n### 数据集\n- 未明确说明" in general
    assert paper.startswith("# 论文分析报告\n\n## 基础信息\n- **标题：** Other\n- **作者：** Ann One\n")
    assert chapter(paper, "## 数据集") == "D1, D2" and chapter(paper, "## 优点") == "- - s"


@pytest.mark.parametrize("name", ["general_reports", "sentence_counts"])
def test_odd_documents_against_sql(spark, tmp_path, name):
    texts = ["a\nb", "a\r\nb", "a\rb", "", "\n \n", "\x1c\nabc", "\x0bv\x0cw\x1cx", "a\u2028b\x85c\xa0", "  lead\n\n\n tail ", "# h\n- b\n\n\n\nd", "x" * 250, None]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    rows += [(1, "id again", "de", "t", 3), (None, "no id", "en", "u", 5), (None, "none either", "en", "v", 0), (50, "x", "en", 'q"uo\\te\'s\n\t', -1)]
    rows += [(51, "x", None, "s", 1), (52, "x", "en", None, 1), (53, "x", "en", "s", None), (54, "x", "null", "[]", 10**15)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    found = con.execute(oracles.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(map(repr, map(tuple, QUERIES[name](spark, str(tmp_path)).select(*columns).collect()))) == sorted(map(repr, found.fetchall()))


def test_given_report_is_kept(spark):
    kept = R.result_reports(results(spark, ("t", "", [], [], "# done", "{}")), "x").first()
    assert kept.markdown_report == "# done"


def test_research_report(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 4")
    corpus = Corpus(seeded_blocks(docs), staged=REPORT_PLAN)
    tables = run.research_tables(corpus, results(spark, ("", "the sum", ["- first"], [], "", json.dumps(PAPER))))
    reports = {r.doc_id: r.markdown_report for r in tables["markdown_reports"].collect()}
    assert set(reports) == {0, 1, 2, 3}
    first = reports[0]
    for head in ("## 1. 基本信息", "## 6. 图表分析", "### 6.3 图文一致性", "## 9. 总结"):
        assert head in first
    assert "- 标题：Scalable indexing of corpus number 0\n- 作者：Ann One\n- 发表平台：V\n- 年份：2024" in first
    assert "> 这篇论文主要研究内容可概括为：the sum\n> 核心方法是m。" in first
    assert chapter(first, "### 3.1 背景") == "first"
    assert chapter(first, "### 5.1 实验设置") == "涉及数据集：D1, D2。"
    assert chapter(first, "### 5.4 作者结论") == "the sum"
    assert "D1, D2" in chapter(first, "### 8.1 适用场景")
    assert first.endswith("## 9. 总结\nthe sum\n")
    assert chapter(reports[3], "## 9. 总结") == "未明确说明"
    merged = {r.doc_id: json.loads(r.structured_data) for r in tables["json_reports"].collect()}
    assert merged[0]["metadata"]["title"] == "Scalable indexing of corpus number 0"
    assert merged[0]["figure_analyses"][0]["figure_id"] == "Figure 1"
    assert merged[0]["source_structure"]["figure_count"] == 1 and "figures" in merged[0]["selected_sections"]
    parsed = tables["parsed_markdown"].filter("doc_id = 0").first().markdown
    assert parsed.startswith("# PDF 结构化解析\n\n## 基础信息\n- **标题：** Scalable indexing of corpus number 0\n- **作者：** Ada Lovelace, ")
    assert "\n\n## 图表元数据\n\n### Figure 1\n- **Caption：** Figure 1 compares" in parsed
    assert corpus.focus.filter(F.length("focus_text") > 12000 + 100).count() <= 4


def test_details(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 2")
    corpus = Corpus(seeded_blocks(docs), staged=REPORT_PLAN)
    assert "**直接证据：**\n- caption 摘要" in R.evidence_details(corpus.evidence).filter("doc_id = 0").first().evidence_text
    assert "**作者结论：** 不足以判断" in R.analysis_details(corpus.analyses).filter("doc_id = 0").first().analysis_text


def test_run_corpus(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 3")
    seeded_blocks(docs).write.parquet(f"{tmp_path}/blocks")
    run.run_corpus(spark, f"{tmp_path}/blocks", f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/markdown_reports").count() == 3
    assert spark.read.parquet(f"{tmp_path}/out/parsed_markdown").count() == 3
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/texts")
    run.run_corpus(spark, f"{tmp_path}/texts", f"{tmp_path}/gen", mode="general_text", results=results(spark, ("", "s", [], [], "", "{}")))
    assert spark.read.parquet(f"{tmp_path}/gen/markdown_reports").count() == 1


def test_filled_metadata_keeps_what_is_there(spark):
    rows = [
        (0, '{"title":"X","keywords":["a"],"doi":"10.1","a\\"b":1}', "T", ["A"], "V", None),
        (1, '{"title":"","authors":[],"year":0}', "T", ["A"], None, "2020"),
        (2, '"text"', "T", [], None, None),
        (3, None, "", [], "", ""),
    ]
    table = spark.createDataFrame(rows, "doc_id long, meta string, title string, authors array<string>, venue string, year string")
    made = table.select("doc_id", R.filled_metadata(F.try_parse_json("meta")).alias("j")).collect()
    got = {r.doc_id: json.loads(r.j) for r in made}
    assert got[0] == {"title": "X", "keywords": ["a"], "doi": "10.1", 'a"b': 1, "authors": ["A"], "venue": "V"}
    assert got[1] == {"title": "T", "authors": ["A"], "year": "2020"}
    assert got[2] == {"title": "T"} and got[3] == {}


def test_values_are_shown_by_their_kind(spark):
    payload = {"n": 0, "m": 1.5, "f": False, "t": True, "l": [1, "it's", 'a"b', True, None], "o": {"x": [1, 2], "y": 0, "z": "s", "e": []}, "s": "text"}
    row = spark.createDataFrame([(json.dumps(payload),)], "j string").select(R.structured_blocks(F.col("j")).alias("t")).first().t
    blocks = dict(b.split("\n", 1) for b in row.split("### ")[1:])
    gap = R.MISSING
    expected = {"N": gap, "M": "1.5", "F": gap, "T": "True", "S": "text", "L": "- 1\n- it's\n- a\"b\n- True\n- None", "O": f"- **E：** {gap}\n- **X：** [1, 2]\n- **Y：** {gap}\n- **Z：** s"}
    # Members of nested objects are shown by name: VARIANT keeps them so.
    assert {k: v.strip() for k, v in blocks.items()} == expected


def test_general_mode_asks_for_results(spark, tmp_path):
    with pytest.raises(ValueError, match="results"):
        run.run_corpus(spark, str(tmp_path), str(tmp_path), mode="general_text")


def test_a_document_in_two_files_is_rejected_the_second_time(spark, folder, tmp_path):
    blocks = seeded_blocks(spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 2"))
    for part in (blocks.filter("doc_id = 0"), blocks.filter("doc_id = 1 OR page_number = 1")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(blocks.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest_blocks(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(300)
    assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/out/structure").collect()) == [0, 1]
    assert [(r.doc_id, r.reason) for r in spark.read.parquet(f"{tmp_path}/out/rejected").collect()] == [(0, "document_seen_before")]


def test_parts_wait_for_their_document(spark, folder, tmp_path):
    """Document 0 comes in three parts (one block twice), 1 never completes, 2 is whole; late rows of either are rejected."""
    blocks = seeded_blocks(spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 3"))
    totals = blocks.groupBy("doc_id").agg(F.count("*").alias("block_total"))
    blocks = blocks.join(totals, "doc_id")
    first = "(doc_id = 0 AND order_index < 4) OR (doc_id = 1 AND order_index < 2) OR doc_id = 2"
    parts = [first, "doc_id = 0 AND order_index BETWEEN 3 AND 7", "doc_id = 0 AND order_index > 7", "doc_id = 1 AND order_index = 3", "doc_id IN (0, 1)"]
    seen = []
    for part in parts:
        blocks.filter(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(blocks.schema).parquet(f"{tmp_path}/in")
        ingest_blocks(stream, f"{tmp_path}/out", f"{tmp_path}/check", patience=2).awaitTermination(300)
        seen.append(sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/out/structure").collect()))
    assert seen == [[2], [2], [0, 2], [0, 2], [0, 2]]
    rejected = {(r.doc_id, r.reason, r.batch) for r in spark.read.parquet(f"{tmp_path}/out/rejected").collect()}
    assert rejected == {(1, "incomplete", 3), (0, "document_seen_before", 4), (1, "document_seen_before", 4)}
    whole = Corpus(seeded_blocks(spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id IN (0, 2)"))).sections
    streamed = spark.read.parquet(f"{tmp_path}/out/sections").drop("batch")
    assert sorted(map(repr, streamed.select(whole.columns).collect())) == sorted(map(repr, whole.collect()))
    assert sorted(p.name for p in (tmp_path / "out" / "waiting").iterdir() if p.is_dir()) == ["batch=3", "batch=4"]


def test_ingest_streams(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for low in (0, 3):
        seeded_blocks(docs.filter(f"doc_id >= {low} and doc_id < {low + 3}")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    blocks = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest_blocks(blocks, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(300)
    whole = Corpus(seeded_blocks(docs.filter("doc_id < 6"))).sections
    streamed = spark.read.parquet(f"{tmp_path}/out/sections").drop("batch")
    assert sorted(map(repr, streamed.select(whole.columns).collect())) == sorted(map(repr, whole.collect()))
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "a.txt").write_text("\nHello\nthere")
    ingest_texts(spark, f"{tmp_path}/txt", f"{tmp_path}/texts", f"{tmp_path}/check2").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/texts").first().title == "Hello"
