"""The stages together, and the cases every stage must bear: nulls, blanks, long texts, repeats, clashing columns, no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from docstruct.llm import common, kneser_ney, linededup, simhash
from docstruct.llm.queries import QUERIES

CLASHING = ["row", "d", "k", "_d", "_k", "key", "h", "pos", "u", "n_removed", "doc_ID2", "lines", "fp", "token"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    good = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 60").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [
        (1001, None, "en", "a", None), (1002, "", None, None, 0), (1003, " \n\t ", "en", "a", 4), (None, "A text without a number. It has two lines.", "en", "a", 1),
        (None, None, None, None, None), (1004, "word " * 30000, "en", "a", 1), (1005, "One row. Twice the same one, and it is here.", "en", "a", 1),
        (1005, "One row. Twice the same one, and it is here.", "en", "a", 1), (1006, "\U0001f600 ß İ 中文 " * 5, "de", "a", 1),
    ]
    docs = good.union(spark.createDataFrame(odd, SCHEMA))
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit("x"))
    path = str(tmp_path_factory.mktemp("odd"))
    docs.write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stage_keeps_columns_and_takes_odd_rows(spark, tables, name, stage):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    done = stage(spark, docs, tables)
    rows = done.collect()
    if name != "best_fit_packing":
        assert done.columns == docs.columns
        assert {r["token"] for r in rows} == {"x"}
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stage_takes_an_empty_table(spark, tables, name, stage):
    docs = spark.createDataFrame([], SCHEMA)
    assert stage(spark, docs, tables).count() == 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n[:4] in ("op2_", "op3_", "op4_", "op5_", "op6_", "op8_", "op9_")])
def test_query_answers_for_every_row(spark, tables, name):
    rows = QUERIES[name](spark, tables).collect()
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id").collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs}
    if name[:4] not in ("op2_", "op4_"):
        assert len(rows) == len(docs)


@pytest.mark.parametrize("name,stage", P.STAGES[:3])
def test_a_task_needs_one_python_worker(spark, tables, monkeypatch, name, stage):
    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return common.cut(df)

    for module in (kneser_ney, linededup, simhash):
        monkeypatch.setattr(module, "cut", cut)
    stage(spark, spark.read.parquet(f"{tables}/documents.parquet"), tables)
    nodes = [plan.count("ArrowEvalPython [") + plan.count("MapInPandas ") for plan in plans]
    assert max(nodes) == 1


def test_pipeline_is_its_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, tables)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, docs.select(key).collect())) == sorted(map(str, P.run(spark, tables).select(key).collect()))


def test_no_line_stays_twice_after_line_dedup(spark, tables):
    rows = [(1, "Page top\nThe first text has words of its own here.\nMIT License."), (2, "Page top\nAnother text, other words, and as many of them.\nMIT License."), (3, "MIT License.")]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in rows], SCHEMA)
    got = {r.doc_id: (r.text, r.n_chars) for r in P.lines(spark, docs, tables).collect()}
    alone = "Another text, other words, and as many of them.\n"
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: (alone, len(alone)), 3: ("", 0)}
