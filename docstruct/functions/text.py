"""Text functions as Spark column expressions (no Python runs per row).

Regular expressions that use ``\\w``, ``\\b``, ``\\s`` or ``\\d`` carry the ``U`` flag so that accented
letters and non-breaking spaces count as in Unicode-aware engines. Absent values are NULL.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docstruct import constants as K

# Every character that counts as white space at the ends of a string.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_pattern(patterns: list[str], flags: str) -> str:
    return f"(?{flags})(?:" + "|".join(patterns) + ")"


def contains_any(col: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(w) for w in words])


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITE_SPACE))


def not_blank(col: Column) -> Column:
    """The stripped text, or NULL when nothing is left."""
    return F.nullif(strip(col), F.lit(""))


# White space and control characters, except where they are one single space already.
_UNEVEN_SPACE = r"(?U)[\s\x00-\x1f\x7f&&[^ ]][\s\x00-\x1f\x7f]*| [\s\x00-\x1f\x7f]+"


def collapse(col: Column) -> Column:
    """White space and control characters -> single spaces, none at the ends."""
    return F.trim(F.regexp_replace(col, _UNEVEN_SPACE, " "))


def clean_text(col: Column) -> Column:
    text = F.regexp_replace(col, _UNEVEN_SPACE, " ")
    text = F.replace(F.replace(text, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    text = F.regexp_replace(text, r" ([,.;:])", "$1")
    # The literal leads, so that the look-arounds are tried at hyphens only.
    text = F.regexp_replace(text, r"(?U)- (?<=\w- )(?=\w)", "")
    return F.trim(text)


def clean_title(col: Column) -> Column:
    text = clean_text(col)
    for pattern in K.TITLE_DROP_PATTERNS:
        text = F.regexp_replace(text, "(?iU)" + pattern, " ")
    return clean_text(text)


def first_line(col: Column, ends: str = r"\n\r") -> Column:
    """First line with content, stripped, at most 200 characters; NULL when there is none. ``ends`` are what ends a line."""
    first = F.regexp_extract(col, rf"(?U)([^\s\x1c-\x1f][^{ends}]*)", 1)
    return F.nullif(F.substring(strip(first), 1, K.TITLE_CHARS), F.lit(""))


def infer_title(col: Column) -> Column:
    """The first line of a file, which other separators end too."""
    return first_line(col, r"\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}")


def normalise_newlines(col: Column) -> Column:
    return F.regexp_replace(col, r"\r\n?", "\n")


def lines(col: Column) -> Column:
    """What stands between line feeds; a carriage return is a character like others."""
    return F.split(col, "\n", -1)


def sentences(col: Column) -> Column:
    return F.split(col, r"(?U)(?<=[.!?])\s+", -1)


# --- line predicates ---------------------------------------------------------------


# ``lowered`` is the lower-cased text where the caller has it as a column already.
# Cheap substring tests come first: most lines fail them, and the expression after ``&`` is then skipped.


def lower(col: Column, lowered: Column | None) -> Column:
    return F.lower(col) if lowered is None else lowered


def is_noise(col: Column, lowered: Column | None = None) -> Column:
    rules = "|".join(p.removeprefix("^") for p in K.NOISE_PATTERNS)
    return lower(col, lowered).rlike(rf"(?U)^[\s\x1c-\x1f]*(?:{rules})")


def is_citation_line(col: Column, lowered: Column | None = None) -> Column:
    lowered = lower(col, lowered)
    hinted = contains_any(lowered, ["et al.,", "sci. adv.", "science advances"])
    return hinted & lowered.rlike(any_pattern(K.CITATION_PATTERNS, "U"))


def is_venue_line(col: Column, lowered: Column | None = None) -> Column:
    lowered = lower(col, lowered)
    hinted = contains_any(lowered, ["volume", "issue", "nature", "sci. adv."])
    return hinted & lowered.rlike(any_pattern(K.VENUE_LINE_PATTERNS, "U"))


def is_author_line(col: Column) -> Column:
    """Two runs of names; marks and digits count as white space between the words of a name."""
    name = K.AUTHOR_NAME_PATTERN.replace(r"\s", rf"[\s{K.AUTHOR_MARKS}\d]")
    return F.regexp_count(col, F.lit("(?U)" + name)) >= 2


def closes_sentence(col: Column) -> Column:
    """True when a sentence ends with the text, so that what follows starts a new one."""
    ended = reduce(lambda a, b: a | b, [col.endswith(mark) for mark in ".!?"])
    trimmed = F.right(F.rtrim(col, F.lit(WHITE_SPACE)), F.lit(1)).isin(".", "!", "?")
    return F.coalesce(ended | trimmed, F.lit(False))


# --- headings, figure ids ------------------------------------------------------------


def heading_key(col: Column, lowered: Column | None = None) -> Column:
    stems = ["abstract", "introduction", "background", "result", "discussion", "method", "experimental", "conclusion"]
    letters = F.lower(F.trim(F.regexp_replace(col, r"[^A-Za-z]+", " ")))
    key = F.element_at(literal_map(K.SECTION_ALIASES), letters)
    return F.when(contains_any(lower(col, lowered), stems), key)


def canonical_section_key(col: Column) -> Column:
    key = F.trim(F.regexp_replace(F.lower(col), r"[^a-z]+", " "))
    return F.coalesce(F.element_at(literal_map(K.SECTION_ALIASES), key), key)


def tool_heading(col: Column) -> Column:
    line = F.regexp_replace(F.lower(strip(col)), r"(?U)^[0-9ivx]+\s*[.)]\s*", "")
    return F.regexp_replace(line, r"[:\-]+$", "")


def section_title(col: Column) -> Column:
    """Title case: every letter after something else is upper case, all others lower."""
    runs = F.regexp_extract_all(F.lower(F.replace(col, F.lit("_"), F.lit(" "))), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substr(r, F.lit(2)))), "")


def figure_suffix(col: Column) -> Column:
    found = F.regexp_extract(col, "(?iU)" + K.FIGURE_START_PATTERN, 1)
    starts = F.lower(F.ltrim(col, F.lit(WHITE_SPACE))).startswith("fig")
    return F.when(starts, F.nullif(F.upper(found), F.lit("")))


def figure_id(col: Column) -> Column:
    return F.concat(F.lit("Figure "), figure_suffix(col))


def figure_mentions(col: Column) -> Column:
    """Distinct upper-cased figure numbers that a text refers to."""
    found = F.regexp_extract_all(col, F.lit("(?iU)" + K.FIGURE_MENTION_PATTERN), F.lit(1))
    return F.array_distinct(F.transform(found, F.upper))


# --- front matter ----------------------------------------------------------------------


def doi_candidates(col: Column) -> Column:
    found = F.regexp_extract_all(col, F.lit("(?iU)" + K.DOI_PATTERN), F.lit(0))
    trimmed = F.transform(found, lambda x: F.rtrim(x, F.lit(K.DOI_TRIM)))
    return F.filter(trimmed, lambda x: ~x.endswith("-"))


def doi_score(doi: Column, text: Column, page: Column) -> Column:
    lowered = F.lower(text)
    return (
        F.when(lowered.contains("doi"), 4).otherwise(0)
        + F.when(lowered.contains("doi.org"), 3).otherwise(0)
        + F.when(page <= 2, 2).otherwise(0)
        + F.when(F.length(doi) >= 15, 1).otherwise(0)
    )


def venue(col: Column, lowered: Column | None = None) -> Column:
    names = ["sci. adv.", "science advances", "nature", "cell", "arxiv"]
    found = [F.nullif(F.regexp_extract(col, "(?iUd)" + p, 0), F.lit("")) for p in K.VENUE_PATTERNS]
    return F.when(contains_any(lower(col, lowered), names), clean_text(F.coalesce(*found)))


def year(col: Column) -> Column:
    return F.nullif(F.regexp_extract(col, "(?U)" + K.YEAR_PATTERN, 0), F.lit(""))


def is_dated_line(col: Column, lowered: Column | None = None) -> Column:
    return is_citation_line(col, lowered) | lower(col, lowered).contains("published")


def author_names(author_text: Column) -> Column:
    """Distinct names in order of appearance from the joined author lines."""
    text = F.regexp_replace(author_text, rf"(?U)[{K.AUTHOR_MARKS}]+|\d+", " ")
    text = F.replace(text, F.lit("&"), F.lit(","))
    found = F.regexp_extract_all(text, F.lit("(?U)" + K.AUTHOR_NAME_PATTERN), F.lit(0))
    return unique(F.transform(found, clean_text))


# --- sanitising --------------------------------------------------------------------------


def sanitize_text(col: Column, max_length: int | None = None) -> Column:
    text = collapse(F.coalesce(col, F.lit("")))
    return text if max_length is None else F.trim(F.substring(text, 1, max_length))


def sanitize_list(col: Column, max_items: int, max_length: int) -> Column:
    cleaned = F.transform(col, lambda x: sanitize_text(x, max_length))
    kept = F.slice(F.filter(cleaned, lambda x: x != ""), 1, max_items)
    return F.coalesce(kept, F.array().cast("array<string>"))


def sanitize_scalar_as_list(col: Column, max_length: int) -> Column:
    """A lone value where a list is expected becomes a list of one."""
    return sanitize_list(F.when(col.isNotNull(), F.array(col)), 1, max_length)


def strip_markdown(col: Column) -> Column:
    """Text without heading marks and bullets; NULL when nothing is left."""
    text = F.regexp_replace(strip(col), r"(?mdU)^\s*#{1,6}\s*", "")
    text = F.regexp_replace(text, r"(?mdU)^\s*[-*]\s*", "")
    return not_blank(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def clean_list(col: Column) -> Column:
    return F.array_compact(F.transform(F.coalesce(col, F.array().cast("array<string>")), strip_markdown))


def coerce_int(col: Column) -> Column:
    return strip(col).try_cast("int")


def unique(col: Column) -> Column:
    """First occurrences in order, without empty entries."""
    return F.array_distinct(F.filter(col, lambda x: x.isNotNull() & (x != "")))


def stored_suffix(filename: Column, kind: Column) -> Column:
    own = F.lower(F.regexp_extract(filename, r"[^/.][^/]*(\.[^./]+)$", 1))
    return F.when(own != "", own).when(kind == "pdf", ".pdf").otherwise(".txt")


def log_file_stamp(ts: Column, zone: str) -> Column:
    return F.concat(F.lit("analysis_"), F.date_format(F.from_utc_timestamp(ts, zone), "yyyyMMdd_HHmmss"))


def label(col: Column, mapping: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(literal_map(mapping), col), section_title(col))


def quote_pattern(text: str) -> str:
    """``text`` as a literal inside a Java regular expression."""
    return re.sub(r"([^\w\s])", r"\\\1", text)
