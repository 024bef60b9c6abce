"""HTML extraction: visible lines of pages, less what the pages with the nearest urls have too."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstruct.llm.common import bit_filter, cut, in_filter, in_order

#: Pages before and after a page, in the order of urls, that bear witness to what its nearest page shares with it.
REACH = 2
# Elements that end a block, that have no text, and that hold no main text; words of class and id.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset(
    "nav footer aside form menu dialog button select option noscript template svg canvas object audio video head label fieldset".split()
)
CONTENT = frozenset(("article", "main"))
_ASIDE_ROLE = re.compile(r"\b(?:navigation|banner|contentinfo|complementary|search|dialog|alert|menu|menubar|form)\b", re.I)
_ASIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|breadcrumbs?|comments?|commentlist|comment-list|cookies?|consent|disqus|dialog|"
    r"footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|overlay|pagination|pager|popup|promo|promoted|related|recommended|"
    r"replies|respond|share|sharing|sidebar|side-bar|skip-link|social|sponsor|sponsored|subscribe|toolbar|widget|site-header|page-header|topbar)"
    r"(?:$|[\s_-])",
    re.I,
)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)", re.S)
_NAME = re.compile(r"[\s/]*(=?[^\s/>=]*)\s*(=?)\s*")
_VALUE = re.compile(r"[^\s>]*")
#: Elements that no form on a page holds: a form around one of them is wrapped around the page.
_WRAPPED = frozenset("article main nav header footer h1".split())


def read_attributes(html: str, at: int) -> tuple[dict[str, str], int, bool]:
    """The attributes of a tag from behind its name on, the place behind the tag, and whether it closes itself.

    Quotes open a value only behind an equals sign; elsewhere they are letters like any other. A tag or value that
    is never closed ends with the page. Every character is read once.
    """
    found: dict[str, str] = {}
    while True:
        m = _NAME.match(html, at)
        at = m.end()
        value = ""
        if m[2]:
            if html[at : at + 1] in ("'", '"'):
                end = html.find(html[at], at + 1)
                if end < 0:
                    return found, len(html), False
                value, at = html[at + 1 : end], end + 1
            else:
                m2 = _VALUE.match(html, at)
                value, at = m2[0], m2.end()
        if m[1]:
            found.setdefault(m[1].lower(), value)
        if at >= len(html):
            return found, at, False
        if html[at] == ">":
            return found, at + 1, html[at - 1] == "/" and not value


def _put_aside(name: str, found: dict[str, str], inside: bool) -> bool:
    """Whether an element holds no main text. A header is a page's unless it is inside the content."""
    if name in ASIDE or (name == "header" and not inside):
        return True
    if not found or name in ("html", "body", "article", "main"):
        return False
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return True
    return bool(_ASIDE_ROLE.search(found.get("role", "")) or _ASIDE_NAME.search(f"{found.get('class', '')} {found.get('id', '')}"))


def page_lines(html: str | None) -> list[tuple[str, bool, bool]]:
    """The lines of a page in order: ``(text, aside, inside)``.

    A line is the text of a block: references decoded, white space one space, trimmed, empty ones left out.
    ``aside`` marks menus, adverts, comments, forms and the like, ``inside`` the text of an article or main
    element. Scripts, styles, comments and markup are no text. Unclosed elements end with what holds them, an unclosed
    tag with the page. A form is put aside unless it is wrapped around the page (``_WRAPPED``). Time is linear in the page.
    """
    # A state is (aside, inside, number of the form); lines of forms are put aside once all of the page is read.
    out: list[tuple[str, bool, bool, int]] = []
    buffer: list[str] = []
    stack: list[tuple[str, tuple[bool, bool, int]]] = []
    opened: Counter[str] = Counter()
    state = (False, False, 0)
    forms, wrappers = 0, set()

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append((text, *state))

    html = html or ""
    at = 0
    while True:
        m = _TAG.search(html, at)
        if m is None:
            buffer.append(html[at:])
            break
        if m.start() > at:
            buffer.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        found, at, closed = read_attributes(html, at)
        if m[1]:
            # Whatever is passed over on the way down is closed too, so that all closing tags take linear time together.
            if opened[name]:
                while stack:
                    last, before = stack.pop()
                    opened[last] -= 1
                    if last == name:
                        break
                if name in BLOCKS or before != state:
                    flush()
                state = before
            elif name in BLOCKS:
                flush()
            continue
        if name in BLOCKS:
            flush()
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        # A paragraph or item ends the one before it that was left open.
        if name in ("p", "li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
            opened[name] -= 1
            state = stack.pop()[1]
        aside, inside, form = state
        if closed and name not in BLOCKS:
            continue
        if form and name in _WRAPPED:
            wrappers.add(form)
        new = (aside or (name != "form" and _put_aside(name, found, inside)), inside or name in CONTENT, form)
        if name == "form" and not form:
            forms += 1
            new = (aside or _put_aside("div", found, inside), inside, forms)
        if new != state:
            flush()
        stack.append((name, state))
        opened[name] += 1
        state = new
    flush()
    return [(text, aside or (form > 0 and form not in wrappers), inside) for text, aside, inside, form in out]


ASIDE_LINE, OPEN_LINE, OWN_LINE, OUTER_LINE = 0, 1, 2, 3


def marked_lines(html: str | None) -> list[tuple[str, int]]:
    """All lines of a page with their kind: put aside, open to the comparison, of its article, or outside of its article.

    Without an article or main element, all that is not put aside is open: only the comparison with its neighbours tells
    the template from the text.
    """
    lines = page_lines(html)
    own = any(inside and not aside for _, aside, inside in lines)
    beyond = OUTER_LINE if own else OPEN_LINE
    return [(text, ASIDE_LINE if aside else OWN_LINE if inside else beyond) for text, aside, inside in lines]


def main_text(html: str | None, gone: set[int] | None) -> str:
    """The lines of a page that are its text; ``gone`` are the places of those that its neighbours share, None if it has none.

    An article's own lines stand: those that another page has are quoted or copied text, not template. Lines outside of
    all articles are text too if, less what is shared, they hold more characters than the articles: then
    these are teasers beside the story.
    """
    lines = marked_lines(html)
    size = {kind: sum(len(t) for k, (t, is_a) in enumerate(lines) if is_a == kind and k not in (gone or ())) for kind in (OWN_LINE, OUTER_LINE)}
    kinds = {OPEN_LINE, OWN_LINE} | ({OUTER_LINE} if gone is not None and size[OUTER_LINE] > size[OWN_LINE] else set())
    return "\n".join(t for k, (t, kind) in enumerate(lines) if kind in kinds and (kind == OWN_LINE or k not in (gone or ())))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _table(a: np.ndarray, b: np.ndarray, whole: bool = True) -> np.ndarray:
    """Lengths of the longest common subsequences of all ends of ``a`` and ``b``; of the whole of ``a`` only if not ``whole``."""
    rows = np.zeros((len(a) + 1 if whole else 2, len(b) + 1), np.int32)
    for k in range(len(a) - 1, -1, -1):
        under, row = (rows[k + 1], rows[k]) if whole else (rows[(k + 1) % 2], rows[k % 2])
        best = np.maximum(under[:-1], np.where(b == a[k], under[1:] + 1, 0))
        row[:-1] = np.maximum.accumulate(best[::-1])[::-1]
    return rows if whole else rows[0]


def _align(a: np.ndarray, b: np.ndarray, cells: int = 4_000_000) -> list[int]:
    """Places in ``a`` of a longest common subsequence; halves ``a`` where the table would be large."""
    if not len(a) or not len(b):
        return []
    if len(a) == 1 or len(a) * len(b) <= cells:
        rows, out, k, j = _table(a, b), [], 0, 0
        while k < len(a) and j < len(b):
            if b[j] == a[k] and rows[k, j] == rows[k + 1, j + 1] + 1:
                out.append(k)
                k, j = k + 1, j + 1
            elif rows[k + 1, j] == rows[k, j]:
                k += 1
            else:
                j += 1
        return out
    half = len(a) // 2
    after = _table(a[half:], b, whole=False)
    before = _table(a[:half][::-1], b[::-1], whole=False)[::-1]
    j = int(np.argmax(before + after))
    return _align(a[:half], b[:j], cells) + [half + k for k in _align(a[half:], b[j:], cells)]


def common_lines(a: list[int], b: list[int], cells: int = 4_000_000) -> list[int]:
    """Places in ``a`` of a longest common subsequence of two line lists; memory grows with the lists, not their product."""
    start = stop = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    while stop < len(a) - start and stop < len(b) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    both = set(a[start : len(a) - stop]) & set(b[start : len(b) - stop])
    left = [k for k in range(start, len(a) - stop) if a[k] in both]
    right = [h for h in b[start : len(b) - stop] if h in both]
    middle = _align(np.array([a[k] for k in left], np.int64), np.array(right, np.int64), cells)
    return [*range(start), *[left[k] for k in middle], *range(len(a) - stop, len(a))]


def neighbourhood(pages: DataFrame, reach: int = REACH) -> DataFrame:
    """``(key, partner, nearest)``: up to ``reach`` pages of the same host before and after each page in url order.

    Pages are put in the order of host and path over the whole table, in ranges, so that a host of any size is
    spread. ``nearest`` is true for one of them: of the pages just before and after, that with the longer common start
    of the path, the one before at a tie. Pages alone on their host have no row.
    """
    placed = cut(in_order(pages, "host", "path", "key"))
    rows = placed.select("at", "host", "path", "key")

    def common(other: str) -> Column:
        """Length of the common start: one less than the first place where the characters differ."""
        n = F.least(F.char_length("path"), F.char_length(other))
        same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substr("path", k, F.lit(1)) != F.substr(other, k, F.lit(1)))
        return F.coalesce(F.get(same, F.lit(0)) - 1, n)

    steps = F.array(*[F.lit(k) for k in range(-reach, reach + 1) if k])
    beside = placed.select(F.explode(steps).alias("step"), "at", F.col("host").alias("h"), F.col("path").alias("p"), F.col("key").alias("partner"))
    beside = beside.withColumn("at", F.col("at") - F.col("step"))
    near = F.when(F.abs("step") == 1, common("p"))
    met = rows.join(beside, "at").where("host = h").select("key", "partner", "step", near.alias("near"))
    best = F.max(F.struct("near", (-F.col("step")).alias("back"))).over(Window.partitionBy("key"))
    return met.withColumn("best", best).select("key", "partner", (-F.col("step") == F.col("best.back")).alias("nearest"))


def neighbours(pages: DataFrame) -> DataFrame:
    """``(key, partner)``: for each page the one of its host whose url path is nearest; no row without one."""
    return neighbourhood(pages, 1).where("nearest").select("key", "partner")


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, n_shared`` of every row: the main text, a block per line.

    Pages are paired by nearest url within their host and all their lines aligned by longest common subsequence.
    What the nearest page shares is deleted if at least half of the other pages around (``REACH``) share it too, so
    that a copy beside the page is no evidence; pages of a host with the same lines count as one. Then the lines
    that the markup puts aside go (``main_text``). ``n_shared`` counts the shared lines outside of articles. NULL and empty pages have an
    empty text; pages with a NULL url, or alone on their host, have no partner and are read by their markup only.
    Repeated rows are compared as one page. Only hashes of lines move, and the pages whose
    text the comparison may change, to be joined with the places of the shared lines. Two different pages alone on a host lose what they share outside of articles;
    so does the inner one of more than three near copies side by side.
    """
    key = F.xxhash64(F.coalesce(F.col(url), F.lit("")), F.col(url).isNull(), F.coalesce(F.col(html), F.lit("")), F.col(html).isNull())

    def slim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [marked_lines(h) for h in batch["html"]]
            yield pd.DataFrame(
                {
                    "key": batch["key"],
                    "url": batch["url"],
                    "lines": [[_hash(t) for t, _ in m] for m in made],
                    "kinds": [[k for _, k in m] for m in made],
                }
            )

    kept = "lines array<bigint>, kinds array<int>"
    rows = pages.select(key.alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    light = cut(rows.mapInPandas(slim, f"key bigint, url string, {kept}").dropDuplicates(["key"]))
    parts = r"(?s)^.*?://([^/?#]*)([^#]*)"
    host, path = (F.regexp_extract("url", parts, k) for k in (1, 2))
    urls = light.where("url IS NOT NULL").select("key", F.lower(host).alias("host"), path.alias("path"), "kinds", F.xxhash64("lines", "kinds").alias("same")).where("host <> ''")
    first = cut(urls.groupBy("host", "same").agg(F.min(F.struct("path", "key")).alias("f")).select("host", "same", "f.path", "f.key"))
    pairs = neighbourhood(first.select("host", "path", "key"))
    lines = light.select("key", "lines")

    def align(mine: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([common_lines(a.tolist(), b.tolist()) for a, b in zip(mine, other)])

    both = pairs.join(lines, "key").join(lines.select(F.col("key").alias("partner"), F.col("lines").alias("other")), "partner")
    found = both.select("key", "nearest", F.pandas_udf(align, "array<int>")("lines", "other").alias("places"))
    # At most 2 * REACH lists a page.
    found = found.groupBy("key").agg(F.max(F.when(F.col("nearest"), F.col("places"))).alias("mine"), F.collect_list(F.when(~F.col("nearest"), F.col("places"))).alias("others"))

    def witnessed(place: Column) -> Column:
        return 2 * F.size(F.filter("others", lambda o: F.array_contains(o, place))) >= F.size("others")

    found = found.select(F.col("key").alias("of"), F.filter("mine", witnessed).alias("gone"))
    named = urls.select("key", "host", "same", "kinds").join(first.select("host", "same", F.col("key").alias("of")), ["host", "same"])
    # Only what can change a text: places that are open, and pages with lines outside of their articles.
    gone = F.filter("gone", lambda k: F.get("kinds", k).isin(OPEN_LINE, OUTER_LINE))
    shared = named.join(found, "of").select("key", gone.alias("gone"), F.array_contains("kinds", OUTER_LINE).alias("outer"))
    shared = cut(shared.where((F.size("gone") > 0) | F.col("outer")).select("key", "gone"))

    def read(htmls: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for h, g in zip(htmls, gone):
            text = main_text(h, None if g is None else set(g.tolist()))
            out.append((text, len(text), 0 if g is None else len(g)))
        return pd.DataFrame(out, columns=["text", "n_chars", "n_shared"])

    # Pages that the comparison surely leaves alone stay where they are.
    maybe = in_filter(bit_filter(shared, "key"), F.col("key"))
    every = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), key.alias("key")).withColumn("maybe", maybe)
    alone = every.where("NOT maybe").select("page_id", "url", "html", F.lit(None).cast("array<int>").alias("gone"))
    done = alone.union(every.where("maybe").join(shared, "key", "left").select("page_id", "url", "html", "gone"))
    made = done.select("page_id", "url", F.pandas_udf(read, "text string, n_chars bigint, n_shared bigint")("html", "gone").alias("r"))
    return made.select("page_id", "url", "r.*")
