import re

import pytest

from docstruct import constants as K
from docstruct.functions import text as T
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a b\xa0c\x03d", "a b c d"),
        ("ﬁnal ﬂow", "final flow"),
        ("  one \n two ", "one two"),
        ("x , y ; z .", "x, y; z."),
        ("pre- and", "preand"),
        ("é- à", "éà"),
        ("a - b", "a - b"),
        ("\xa0 \t", ""),
    ],
)
def test_clean_text(value, text, expected):
    assert value(T.clean_text, text) == expected


def test_clean_title(value):
    assert value(T.clean_title, "Article A study https://x.org/1 Check for updates doi:10.1/2 of articles") == (
        "A study of articles"
    )


@pytest.mark.parametrize(
    "text, noise",
    [
        (" Downloaded from https://a.b ", True),
        ("12", True),
        ("Page 3 of 4", True),
        ("Received: 1 May", True),
        ("Receivedly", False),
        ("The page 3", False),
        ("© Copyright", False),
    ],
)
def test_noise(value, text, noise):
    assert value(T.is_noise, text) is noise


def test_citation_needs_word_after_dot(value):
    assert value(T.is_citation_line, "Sci. Adv.7") is True
    assert value(T.is_citation_line, "Sci. Adv. 7") is False
    assert value(T.is_citation_line, "Doe et al., 2020") is True


def test_venue_line_is_substring_rule(value):
    assert value(T.is_venue_line, "soft tissue") is True
    assert value(T.is_venue_line, "signature") is False


def test_author_line(value):
    assert value(T.is_author_line, "Ada Lovelace1, Alan Turing2") is True
    assert value(T.is_author_line, "Ada Lovelace went home") is False
    assert value(T.is_author_line, "Aa Bb Cc Dd Ee") is False


@pytest.mark.parametrize(
    "text, key",
    [
        ("1. Introduction", "introduction"),
        ("MATERIALS AND METHODS", "method"),
        ("Results — and Discussion", "results"),
        ("Introduction to it", None),
        ("123", None),
    ],
)
def test_heading_key(value, text, key):
    assert value(T.heading_key, text) == key


def test_canonical_key_keeps_unknown(value):
    assert value(T.canonical_section_key, "2 Methods!") == "method"
    assert value(T.canonical_section_key, "Related_Work 1") == "related work"


@pytest.mark.parametrize(
    "text, found",
    [("Fig. 2a | x", "Figure 2A"), (" FIGURE 12 shows", "Figure 12"), ("Figs. 1", None), ("see Fig. 1", None), ("Fig 1ab", None)],
)
def test_figure_id(value, text, found):
    assert value(T.figure_id, text) == found


def test_figure_mentions(value):
    assert value(T.figure_mentions, "Fig. 1a and (Fig.1), figure 2; Figs. 3, FIG 2") == ["1A", "1", "2"]


def test_doi_candidates(value):
    assert value(T.doi_candidates, "https://doi.org/10.1038/s42256-1). and 10.12345/abc- x") == ["10.1038/s42256-1"]


def test_author_names(value):
    assert value(T.author_names, "Ada Lovelace1 & Alan Turing†, Ada Lovelace2") == ["Ada Lovelace", "Alan Turing"]


def test_sanitize(value):
    assert value(lambda c: T.sanitize_text(c, 5), " a\r\nb\x07c  d e") == "a b c"
    assert value(lambda c: T.sanitize_text(c, 5), None) == ""
    assert value(lambda c: T.sanitize_list(c, 2, 3), [None, " ", "abcd", "e", "f"], "array<string>") == ["abc", "e"]
    assert value(lambda c: T.sanitize_list(c, 2, 3), None, "array<string>") == []
    assert value(lambda c: T.sanitize_scalar_as_list(c, 3), "abcd") == ["abc"]


def test_strip_markdown(value):
    assert value(T.strip_markdown, "## A\n- b\n\n\n\nc ") == "A\nb\n\nc"
    # Blank lines before a bullet go with it.
    assert value(T.strip_markdown, "b\n\n\n* c") == "b\nc"
    assert value(T.strip_markdown, " # ") is None
    assert value(T.clean_list, ["- a", "#", None, "b"], "array<string>") == ["a", "b"]


def test_tool_heading(value):
    assert value(T.tool_heading, " 1. Methods: ") == "methods"
    assert value(T.tool_heading, "IV) Results") == "results"
    assert value(T.tool_heading, "1.2. Methods") == "2. methods"
    assert value(T.tool_heading, "1 Methods") == "1 methods"


def test_infer_title(value):
    assert value(T.infer_title, "\n \xa0\n  Example Title \n\nSecond") == "Example Title"
    assert value(T.infer_title, " \n\t") is None
    assert len(value(T.infer_title, "x" * 300)) == 200


def test_small_helpers(value):
    assert value(T.coerce_int, " 12 ") == 12
    assert value(T.coerce_int, "1.5x") is None
    assert value(T.unique, ["a", "", "b", "a"], "array<string>") == ["a", "b"]
    assert value(T.section_title, "experimental_setup") == "Experimental Setup"
    for key in ("f1-score", "3d_view", "it's_OK", "état-final"):
        assert value(T.section_title, key) == key.replace("_", " ").title()
    assert value(lambda c: T.stored_suffix(c, F.lit("pdf")), "x/NAME.PDF") == ".pdf"
    assert value(lambda c: T.stored_suffix(c, F.lit("pdf")), "name") == ".pdf"
    assert value(lambda c: T.stored_suffix(c, F.lit("plain_text")), ".hidden") == ".txt"
    assert value(lambda c: T.log_file_stamp(c.cast("timestamp"), "UTC"), "2024-05-06 07:08:09") == "analysis_20240506_070809"
    assert value(T.closes_sentence, "End. \n") is True
    assert value(T.closes_sentence, "  ") is False


def test_sentences_keep_accents(value):
    assert value(T.sentences, "Un é. Deux!\xa0Trois? fin") == ["Un é.", "Deux!", "Trois?", "fin"]


def test_every_constant_passes_its_own_hint(spark):
    """The cheap look for a hint word before the patterns must not shut out any constant."""
    aliases = spark.createDataFrame(list(K.SECTION_ALIASES.items()), "alias string, key string")
    assert aliases.filter(~F.coalesce(T.heading_key(F.col("alias")) == F.col("key"), F.lit(False))).count() == 0
    for rule, patterns in ((T.is_citation_line, K.CITATION_PATTERNS), (T.is_venue_line, K.VENUE_LINE_PATTERNS)):
        plain = [(re.sub(r"\\b", "", p).replace("\\", ""),) for p in patterns]
        # A mark at the end of a word needs a letter after it to be a word's end.
        lines = spark.createDataFrame([(f"x {p}" + ("x" if p[-1] in ".," else ""),) for (p,) in plain], "line string")
        assert lines.filter(~rule(F.col("line"))).count() == 0
