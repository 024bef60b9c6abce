"""Physical plans: no pair joins, early rank cuts, pruned scans, one distribution by page."""

import re

import pytest
from pyspark.sql import functions as F

from docstruct.operators import figures as G
from docstruct.operators import jobs as J
from docstruct.operators import search as Q
from docstruct.operators import structure as S
from docstruct.operators.blocks import annotate_blocks, flag_blocks, fold_text
from docstruct.plans.corpus import FIGURE_ROWS, REPORT_PLAN, Corpus
from docstruct.plans.queries import QUERIES
from docstruct.plans.staging import stage
from docstruct.sources.files import assemble_blocks
from docstruct.sources.seed import seeded_blocks, seeded_spans
from docstruct.sources.tables import read_table


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("blocks"))
    seeded_blocks(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).write.mode("overwrite").parquet(path)
    return Corpus(spark.read.parquet(path))


def plan(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def test_positions_use_one_distribution_by_page(corpus, capsys):
    text = plan(corpus.annotated, capsys)
    tree = text.split("\n\n")[0]
    # Rows move once, by page; the other exchanges carry page counts.
    assert len(re.findall(r"hashpartitioning\(doc_id#\d+L, page_number#\d+, 4\), ENSURE", text)) <= 3
    assert "SinglePartition" not in text and "Cartesian" not in tree


@pytest.mark.parametrize(
    "build",
    [
        lambda c: G.mention_candidates(c.annotated),
        lambda c: G.rank_figures(c.figures, None),
        lambda c: S.discarded_noise(c.flagged),
        lambda c: S.keyword_sections(c.annotated, c.places),
    ],
)
def test_top_n_is_cut_before_the_shuffle(corpus, capsys, build):
    assert "WindowGroupLimit" in plan(build(corpus), capsys)


def test_log_tail_is_cut_before_the_shuffle(spark, folder, capsys):
    logs = J.event_logs(spark.read.parquet(f"{folder}/events.parquet"))
    assert "WindowGroupLimit" in plan(J.log_tail(logs), capsys)


def test_search_reads_two_columns_without_shuffle(spark, folder, capsys):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = plan(Q.keyword_search(docs, "the"), capsys)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "Exchange" not in text


def test_page_one_filter_reaches_the_scan(corpus, capsys):
    assert re.search(r"PushedFilters: \[.*EqualTo\(page_number,1\)", plan(corpus.front, capsys))


def test_reading_adds_no_shuffle(spark, folder, capsys):
    assert "Exchange" not in plan(read_table(spark, f"{folder}/documents.parquet"), capsys)


# Queries with eager parts (writes, streams) are left to the value checks.
LAZY = [
    "clean_text", "block_flags", "block_positions", "titles", "authors", "doi", "venue_year", "fallback_abstract",
    "sections", "keyword_fallback", "noise", "captions", "figure_references", "figure_artifacts", "keyword_search",
    "multi_keyword_search", "extract_section", "job_latest", "job_transitions", "job_progress", "log_tail",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_pair_joins_and_no_python(spark, folder, capsys, name):
    text = plan(QUERIES[name](spark, folder), capsys)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text


def moves(df) -> list[str]:
    """What the shuffles of a plan are dealt by, without the numbers of the columns."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [",".join(re.findall(r"(\w+)#", x)) for x in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]


@pytest.fixture
def merged(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_section_texts_move_once(merged, folder):
    spark = merged
    c = Corpus(seeded_blocks(spark.read.parquet(f"{folder}/documents.parquet")), staged=("blocks", "places"))
    found = moves(S.heading_sections(c.annotated, c.places))
    assert found.count("doc_id,section_seq") == 2 and "doc_id,page_number,section_seq" not in found
    hits = moves(S.keyword_hits(c.annotated, c.places))
    assert "doc_id,run_id" in hits and not any("page_number" in x for x in hits)
    assert "page_number" not in ",".join(moves(fold_text(c.annotated, ["doc_id"], " ")))


def test_runs_that_stay_have_no_keyword(spark, folder):
    """What does not move could not have given a sentence: no keyword on its page, and its run ends there."""
    c = Corpus(seeded_blocks(spark.read.parquet(f"{folder}/documents.parquet")), staged=("blocks",))
    runs = c.annotated.groupBy("doc_id", "run_id").agg(F.max("has_keyword").alias("k"), F.bool_and("run_matters").alias("all"), F.bool_or("run_matters").alias("any"))
    assert runs.where("k AND NOT all").count() == 0 and runs.where("NOT any").count() > 0
    across = c.annotated.groupBy("doc_id", "run_id").agg(F.countDistinct("page_number").alias("pages"), F.bool_and("run_matters").alias("all"))
    assert across.where("pages > 1 AND NOT all").count() == 0


def test_spans_move_once_to_their_page(merged, folder):
    spans = seeded_spans(merged.read.parquet(f"{folder}/documents.parquet"))
    found = moves(assemble_blocks(spans))
    assert not any("raw_index" in x for x in found) and len(found) <= 6


def test_spans_are_made_once_for_texts_and_images(merged, folder):
    """one scan and one move of the spans; order, flags and images are read from what was made of them."""
    spans = seeded_spans(merged.read.parquet(f"{folder}/documents.parquet"))
    made = []

    def keep(rows):
        made.append(rows)
        return stage(rows, "page_blocks")

    blocks = assemble_blocks(spans, keep)
    assert moves(made[0]) == ["doc_id,page_number"] and plan_text(made[0]).count("Scan parquet") == 2  # tree and details
    figures = plan_text(Corpus(blocks).figures)
    assert "page_blocks" in figures and "documents.parquet" not in figures
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, assemble_blocks(spans).collect()))


def test_staging_leaves_no_shuffle_files(spark, folder):
    """what is staged takes its shuffle files with it."""

    def files():
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {x.toString() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()) if "shuffle_" in x.toString()}

    before = files()
    stage(spark.read.parquet(f"{folder}/documents.parquet").repartition("doc_id"), "moved")
    assert files() <= before


def plan_text(df):
    qe = df._jdf.queryExecution()
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(qe, "formatted")


def test_places_move_no_text(spark, folder):
    """F16: which sections there are is known from flags; only these are shuffled."""
    blocks = seeded_blocks(spark.read.parquet(f"{folder}/documents.parquet"))
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan_text(Corpus(blocks).places))
    assert moved and not any("text#" in columns for columns in moved)


def test_figures_stage_only_their_rows(spark, folder):
    """F8: what no figure can be made of is not written, and nothing is lost by it."""
    blocks = seeded_blocks(spark.read.parquet(f"{folder}/documents.parquet"))
    whole = Corpus(blocks, staged=("blocks",))
    rows = G.figure_rows(whole.annotated)
    assert rows.count() < whole.annotated.count()
    assert not {"has_keyword", "is_author", "run_id"} & set(rows.columns)
    key = ["doc_id", "caption_order"]
    own = Corpus(blocks, staged=FIGURE_ROWS).figures.orderBy(*key).collect()
    assert own == G.extract_figures(blocks, whole.annotated).orderBy(*key).collect()


def test_only_pages_beside_a_caption_have_its_neighbours(spark):
    rows = []
    for n in range(18):
        text = "Figure 1. What it shows here" if n == 5 else f"a long line of body text, number {n}, about nothing"
        rows.append((1, f"b{n}", n // 6 + 1, n, "text", text, float(n % 6) * 60, 10.0))
    names = "doc_id long, block_id string, page_number int, order_index int, block_type string, text string, y0 double, max_size double"
    marked = annotate_blocks(flag_blocks(spark.createDataFrame(rows, names))).filter("near_caption").collect()
    assert sorted(r.order_index for r in marked) == [3, 4, 5, 6, 7]


def test_texts_move_once_to_their_document(spark, folder):
    """F6, F7, F9 to F14: focus and raw texts are made of one reading of the sections, abstracts without the blocks."""
    blocks = seeded_blocks(spark.read.parquet(f"{folder}/documents.parquet"))
    c = Corpus(blocks, staged=REPORT_PLAN)
    for df in (c.focus, c.parsed_documents.select("doc_id", "raw_text", "sections")):
        assert len(re.findall(r"ReadSchema: \S*content:string", plan_text(df))) == 1
    assert "caption_order" not in plan_text(c.abstracts)
    assert "is_title" in c.annotated.columns
    plain = Corpus(blocks)
    assert sorted(c.front.collect()) == sorted(plain.front.collect())
    assert sorted(c.abstracts.collect()) == sorted(plain.abstracts.collect())
    keys = {r.doc_id: r.selected_sections for r in S.selected_sections(c.sections).collect()}
    assert all(r.selected_sections == keys.get(r.doc_id, []) for r in c.focus.collect())
