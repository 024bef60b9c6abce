"""URL filter: rules by host and path, and block decisions carried over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstruct.llm.common import LOWER, UPPER, components, cut

# Fixed values: (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def with_parts(df: DataFrame, url: str, to: str) -> DataFrame:
    """Adds columns ``<to>host, <to>path, <to>node``.

    The node stands for the url among links: host, path and query without scheme and fragment; NULL without ``://``.
    """
    df = df.withColumns(
        {f"{to}host": url_host(F.col(url)), f"{to}path": url_path(F.col(url)), f"{to}query": F.regexp_extract(url, _PARTS, 3)}
    )
    path = F.coalesce(F.nullif(F.col(f"{to}path"), F.lit("")), F.lit("/"))
    node = F.when(F.col(f"{to}host") != "", F.concat(f"{to}host", path, f"{to}query"))
    return df.withColumn(f"{to}node", node).drop(f"{to}query")


def ordered(rules=RULES) -> list[tuple[str, str, str]]:
    """Longest first, so that the first that fits wins."""
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))


def rule_number(host: Column, path: Column, rules=RULES) -> Column:
    """Place in ``ordered(rules)`` of the rule that fits a host or its parents and the start of the path, or NULL."""
    case = F.when(F.lit(False), F.lit(0))
    for k, (name, start, _) in enumerate(ordered(rules)):
        case = case.when(((host == name) | host.endswith("." + name)) & path.startswith(start), F.lit(k))
    return case


def rule_text(number: Column, rules=RULES) -> Column:
    return F.get(F.array(*[F.lit(h + p) for h, p, _ in ordered(rules)]).cast("array<string>"), number)


def rule_verdict(number: Column, rules=RULES) -> Column:
    return F.get(F.array(*[F.lit(v) for _, _, v in ordered(rules)]).cast("array<string>"), number)


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Redirect (``meta refresh``) and canonical links of pages as node pairs ``(a, b)``.

    Relative targets are resolved against the page's host and folder; links without a target, and those of
    pages whose url is NULL or has no ``://``, give no pair.
    """
    page, tag = F.col(url), F.col("tag")
    tags = F.filter(
        F.regexp_extract_all(F.col(html), F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0)),
        lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b|\bhttp-equiv\s*=\s*[\"']?refresh\b"),
    )
    # Written where it is few rows; filters on what follows would otherwise repeat the expressions below many times.
    found = cut(pages.select(page.alias("url"), F.explode(tags).alias("tag")))
    target = F.when(
        tag.rlike("(?i)^<link"), F.regexp_extract(tag, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    ).otherwise(F.regexp_extract(tag, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    found = found.select("url", F.replace(target, F.lit("&amp;"), F.lit("&")).alias("to"))
    found = with_parts(found, "url", "a_")
    to, base, path = F.col("to"), F.concat(F.lit("http://"), F.col("a_host")), F.col("a_path")
    whole = (
        F.when(to == "", None)
        .when(to.contains("://"), to)
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.startswith("/"), F.concat(base, to))
        .when(to.startswith("?"), F.concat(base, path, to))
        .when(to.startswith("#"), F.col("url"))
        .otherwise(F.concat(base, F.coalesce(F.nullif(F.regexp_extract(path, r"^.*/", 0), F.lit("")), F.lit("/")), to))
    )
    pairs = with_parts(found.select("a_node", whole.alias("whole")), "whole", "b_")
    return cut(pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))).where("a <> b")


def judge_urls(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str | None = "html", links: DataFrame | None = None, rules=RULES
) -> DataFrame:
    """Verdict of every page's url: ``page_id, host, path, rule, verdict``; one row per row of ``pages``.

    A rule that fits decides: the longest wins, so an explicit allow also stands against a blocked alias.
    A url without a rule is blocked if any url of its component of redirect and canonical links is blocked
    by a rule (also one that is only linked to, not a page), else allowed. ``links`` adds url pairs ``(a, b)``,
    as a crawler's redirect log has them. NULL urls and such without ``://`` have an empty host and path, no
    rule and no alias: they are allowed. Repeated rows are judged alike; other columns are left out.
    """
    pairs = []
    if html is not None:
        pairs.append(page_links(pages, url, html))
    if links is not None:
        told = with_parts(with_parts(links.select("a", "b"), "a", "a_"), "b", "b_")
        pairs.append(told.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).dropna())
    judged = with_parts(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")), "url", "").drop("url")
    judged = judged.withColumn("number", rule_number(F.col("host"), F.col("path"), rules))
    number = F.col("number")
    plain = judged.select(
        "page_id", "host", "path", rule_text(number, rules).alias("rule"), rule_verdict(number, rules).alias("verdict"), "node"
    )
    if not pairs:
        return plain.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    member = components(pairs[0].unionByName(pairs[1]) if len(pairs) > 1 else pairs[0])
    host = F.regexp_extract("node", r"^[^/?]*", 0)
    path = F.regexp_extract("node", r"^[^/?]*([^?]*)", 1)
    blocked = member.where(rule_verdict(rule_number(host, path, rules), rules) == "block").select("component").distinct()
    aliases = member.join(blocked, "component", "left_semi").select("node", F.lit(True).alias("tainted"))
    return plain.join(aliases, "node", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("verdict", F.when(F.col("tainted"), "block"), F.lit("allow")).alias("verdict"),
    )
