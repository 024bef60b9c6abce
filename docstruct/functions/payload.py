"""Reading loosely typed JSON payloads (model replies) with VARIANT columns.

A reply may hold a string where a list is expected, or the other way round; each accessor below takes
a VARIANT and coerces it. Nothing here fails on bad input: what cannot be read is NULL or empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docstruct.functions import text as T


def extract_json(col: Column) -> Column:
    """The JSON object inside a reply: a fenced block, else from the first ``{`` to the last ``}``."""
    fenced = F.regexp_extract(col, r"(?sU)```(?:json)?\s*(\{.*\})\s*```", 1)
    start = F.instr(col, "{")
    end = F.length(col) - F.instr(F.reverse(col), "}") + 1
    bare = F.when((start > 0) & F.contains(col, F.lit("}")) & (end > start), F.substring(col, start, end - start + 1))
    return F.coalesce(F.nullif(fenced, F.lit("")), bare)


def parse_object(json: Column) -> Column:
    """The object as a VARIANT; NULL when the text is not exactly one JSON object."""

    def only_object(wrapped: Column) -> Column:
        item = F.try_variant_get(wrapped, "$[0]", "variant")
        more = F.try_variant_get(wrapped, "$[1]", "variant")
        return F.when(more.isNull() & kind(item).startswith("OBJECT"), item)

    return T.let(F.try_parse_json(F.concat(F.lit("["), json, F.lit("]"))), only_object)


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def is_list(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("ARRAY"), F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def items(v: Column) -> Column:
    """List entries as VARIANTs; empty for anything that is not a list."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def texts(v: Column) -> Column:
    """Entries as strings; a scalar is a list of one; NULL is empty."""
    one = F.array(as_text(v))
    return F.array_compact(F.when(is_list(v), F.transform(items(v), as_text)).otherwise(one))


def joined_text(v: Column) -> Column:
    """A string, with list entries stripped and joined by spaces."""
    parts = F.filter(F.transform(texts(v), T.strip), lambda x: x != "")
    return F.when(is_list(v), F.array_join(parts, " ")).otherwise(F.coalesce(T.strip(as_text(v)), F.lit("")))


def stripped_list(v: Column) -> Column:
    return F.filter(F.transform(texts(v), T.strip), lambda x: x != "")


def limited_text(v: Column, limit: int) -> Column:
    return T.sanitize_text(as_text(v), limit)


def limited_list(v: Column, limit: tuple[int, int]) -> Column:
    return T.sanitize_list(texts(v), *limit)


def object_entries(v: Column, json: Column) -> Column:
    """(name, value) entries of an object in the order of its JSON text."""
    return T.let(
        F.try_variant_get(v, "$", "map<string,variant>"),
        lambda values: F.transform(
            F.json_object_keys(json), lambda k: F.struct(k.alias("name"), F.element_at(values, k).alias("value"))
        ),
    )


def has_keys(json: Column, required: list[str]) -> Column:
    wanted = F.array(*[F.lit(k) for k in required])
    return F.coalesce(F.size(F.array_except(wanted, F.json_object_keys(json))) == 0, F.lit(False))
