"""Keyword search and section lookup over whole texts, inside each row (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstruct import constants as K
from docstruct.functions import text as T


def _hits(plain: Column, low: Column, keyword: str, max_hits: int, window: int) -> Column:
    """Hits in a text with normalised newlines, given beside its lower-cased form."""
    key = keyword.lower().strip()

    def hits(parts: Column, lengths: Column) -> Column:
        def hit(i: Column) -> Column:
            before = F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda n, x: n + x)
            at = before + (i - 1) * len(key)
            left = F.greatest(at - window, F.lit(0))
            snippet = F.substring(plain, left + 1, at + len(keyword) + window - left)
            return F.struct(
                i.alias("hit_no"),
                at.alias("position"),
                F.replace(T.strip(snippet), F.lit("\n"), F.lit(" ")).alias("snippet"),
            )

        found = F.filter(F.sequence(F.lit(1), F.lit(max_hits)), lambda i: i < F.size(parts))
        return F.transform(found, hit)

    return T.let(
        F.split(low, T.quote_pattern(key), max_hits + 1),
        lambda parts: T.let(F.transform(parts, F.length), lambda lengths: hits(parts, lengths)),
    )


def keyword_hits(
    text: Column, keyword: str, max_hits: int = K.SEARCH_HITS, window: int = K.SEARCH_WINDOW
) -> Column:
    """Array of (hit_no, position, snippet); position counts characters from 0.

    ``split`` stops after ``max_hits`` cuts, so a long text is only read as far as needed. The search
    is case-insensitive and uses the stripped keyword; the snippet width uses the keyword as given.
    """
    return T.let(T.normalise_newlines(text), lambda t: T.let(F.lower(t), lambda low: _hits(t, low, keyword, max_hits, window)))


def keyword_search(
    docs: DataFrame,
    keyword: str,
    max_hits: int = K.SEARCH_HITS,
    window: int = K.SEARCH_WINDOW,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(key, hit_no, position, snippet); an empty keyword gives no rows."""
    needle = keyword.lower().strip()
    matching = docs.filter(F.lower(text).contains(needle) if needle else F.lit(False))
    return matching.select(key, F.inline(keyword_hits(F.col(text), keyword or " ", max_hits, window)))


def multi_keyword_search(
    docs: DataFrame,
    keywords: list[str],
    max_hits: int = K.SEARCH_HITS,
    window: int = K.SEARCH_WINDOW,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Searches all keywords in one pass over the texts: (key, keyword, hit_no, position, snippet)."""
    usable = [k for k in dict.fromkeys(keywords) if k.strip()]

    def tagged(plain: Column, low: Column, keyword: str) -> Column:
        return F.transform(
            _hits(plain, low, keyword, max_hits, window),
            lambda h: F.struct(
                F.lit(keyword).alias("keyword"),
                h["hit_no"].alias("hit_no"),
                h["position"].alias("position"),
                h["snippet"].alias("snippet"),
            ),
        )

    # Each text is normalised and lower-cased once for all keywords.
    found = T.let(
        T.normalise_newlines(F.col(text)),
        lambda t: T.let(F.lower(t), lambda low: F.flatten(F.array(*[tagged(t, low, k) for k in usable]))),
    )
    matching = docs.filter(T.contains_any(F.lower(text), [k.lower().strip() for k in usable]))
    return matching.select(key, F.inline(found))


def keyword_messages(
    docs: DataFrame, keyword: str, key: str = "doc_id", text: str = "text", max_hits: int = K.SEARCH_HITS
) -> DataFrame:
    """One row per document: ``status`` (hit, no_match, empty_keyword) and the numbered hit lines."""
    if not keyword.strip():
        return docs.select(key, F.lit("empty_keyword").alias("status"), F.lit(None).cast("string").alias("message"))
    lines = F.transform(
        keyword_hits(F.col(text), keyword, max_hits),
        lambda h: F.concat(F.lit("[Hit "), h["hit_no"], F.lit("] ..."), h["snippet"], F.lit("...")),
    )
    return docs.select(key, lines.alias("hit_lines")).select(
        key,
        F.when(F.size("hit_lines") > 0, "hit").otherwise("no_match").alias("status"),
        F.nullif(F.array_join("hit_lines", "\n"), F.lit("")).alias("message"),
    )


def _cut(text: Column, limit: int | None) -> Column:
    return text if limit is None else F.substring(text, 1, limit)


def section_text(
    text: Column, name: str, limit: int | None = K.SECTION_CHARS, prefix_limit: int | None = K.ABSTRACT_PREFIX_CHARS
) -> Column:
    """Struct (status, content) for one section name; status is found, prefix or not_found. No limit means whole."""
    known = {h for hs in K.TOOL_HEADINGS.values() for h in hs}
    target = name.strip().lower()
    accepted = [h for h in K.TOOL_HEADINGS.get(target, [target]) if h in known]
    nothing = F.lit(None).cast("int")

    def found(rows: Column, heads: Column) -> Column:
        start = F.get(F.filter(heads, lambda h: h["name"].isin(*accepted)), F.lit(0))["at"] if accepted else nothing
        return T.let(start, lambda at: F.when(at.isNotNull(), cut(rows, heads, at)))

    def cut(rows: Column, heads: Column, start: Column) -> Column:
        later = F.filter(heads, lambda h: h["at"] > start)
        end = F.coalesce(F.get(later, F.lit(0))["at"], F.size(rows))
        chunk = T.strip(F.array_join(F.slice(rows, start + 1, end - start), "\n"))
        return F.struct(F.lit("found").alias("status"), _cut(chunk, limit).alias("content"))

    def heading_lines(rows: Column) -> Column:
        named = F.transform(rows, lambda line, i: F.struct(i.alias("at"), T.tool_heading(line).alias("name")))
        return F.filter(named, lambda h: h["name"].isin(*sorted(known)))

    if target == "abstract":
        other = F.struct(
            F.lit("prefix").alias("status"),
            T.strip(_cut(T.normalise_newlines(text), prefix_limit)).alias("content"),
        )
    else:
        other = F.struct(F.lit("not_found").alias("status"), F.lit(None).cast("string").alias("content"))
    hit = T.let(T.lines(T.normalise_newlines(text)), lambda rows: T.let(heading_lines(rows), lambda heads: found(rows, heads)))
    return F.coalesce(hit, other)


def extract_section(
    docs: DataFrame,
    name: str,
    key: str = "doc_id",
    text: str = "text",
    limit: int | None = K.SECTION_CHARS,
    prefix_limit: int | None = K.ABSTRACT_PREFIX_CHARS,
) -> DataFrame:
    found = section_text(F.col(text), name, limit, prefix_limit)
    return docs.select(key, found.alias("s")).select(key, "s.status", "s.content")
