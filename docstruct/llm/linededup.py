"""Line dedup: lines and runs of lines, removed where another document already has them; also chunks with content-defined ends."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstruct.llm.common import bit_filter, cut, drop, give_back, in_filter, packed, row_key, same_row, small

#: Lines of the rolling hash; a chunk may end where it is 0 modulo RATE; lines and words that a chunk has at least.
WINDOW, RATE, MIN_LINES, MIN_WORDS = 2, 2, 2, 8
#: What ends a line: a line feed, or inside a paragraph the end of a sentence. It starts with a set of characters, which is what makes it fast.
_END = re.compile(r"[.!?\n](?:(?<=\n)|[.!?]*(?:\n|[^\S\n]+))")
_MASK, _BASE = (1 << 64) - 1, 0x9E3779B97F4A7C15


def lines_of(text: str) -> list[str]:
    """The lines of a text with what ends them; joined they are the text."""
    out, start = [], 0
    for m in _END.finditer(text):
        out.append(text[start : m.end()])
        start = m.end()
    if start < len(text):
        out.append(text[start:])
    return out


def chunks_of(text: str | None) -> list[tuple[str, str | None]]:
    """Cuts a text where the rolling hash over the last lines' hashes says so; joined the chunks are the text.

    An end depends on the lines before it only, so chunks fall into step again after other text. Beside each
    chunk stands what is compared of it, without the white space around it: None for chunks of fewer than
    ``MIN_LINES`` lines with text or ``MIN_WORDS`` words, which always stay.
    """
    out: list[tuple[str, str | None]] = []
    part: list[str] = []
    filled = 0
    before = [0] * WINDOW

    def close() -> None:
        chunk = "".join(part)
        body = chunk.strip()
        out.append((chunk, body if filled >= MIN_LINES and len(body.split(None, MIN_WORDS)) >= MIN_WORDS else None))

    digest = xxhash.xxh64_intdigest
    for line in lines_of(text or ""):
        part.append(line)
        bare = line.strip()
        filled += bare != ""
        before.pop(0)
        before.append(digest(bare))
        rolling = 0
        for h in before:
            rolling = (rolling * _BASE + h) & _MASK
        if len(part) >= MIN_LINES and (rolling >> 33) % RATE == 0:
            close()
            part, filled = [], 0
    if part:
        close()
    return out


def _hash(body: str) -> int:
    return xxhash.xxh64_intdigest(body) - (1 << 63)


def _bodies(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"h": _hash(b), "body": b} for _, b in chunks_of(t) if b is not None] for t in texts])


def _hashes(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted({_hash(b) for _, b in chunks_of(t) if b is not None}) for t in texts])


def _strip(texts: pd.Series, drops: pd.Series, firsts: pd.Series) -> pd.DataFrame:
    """Removes the chunks of ``drops`` everywhere and those of ``firsts`` after the first time."""
    rows = []
    for text, drop, first in zip(texts, drops, firsts):
        gone, again = set(drop if drop is not None else ()), set(first if first is not None else ())
        if not gone and not again:
            rows.append((text, 0))
            continue
        left, seen, n = [], set(), 0
        for chunk, body in chunks_of(text):
            h = None if body is None else _hash(body)
            if h is not None and (h in gone or (h in again and h in seen)):
                n += 1
                continue
            seen.add(h)
            left.append(chunk)
        rows.append(("".join(left), n))
    return pd.DataFrame(rows, columns=["text", "n_removed"])


def repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(h, n, first_id)`` of the chunks that stand at two or more places, all with the same bytes.

    Chunks are grouped by hash and text, so their bytes are compared; a hash that different texts share
    removes none of them.
    """
    each = docs.select(F.coalesce(F.col(doc_id), F.lit((1 << 63) - 1)).alias("id"), F.explode(F.pandas_udf(_bodies, "array<struct<h:bigint,body:string>>")(F.col(text))).alias("c"))
    same = each.groupBy("c.h", "c.body").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return (
        same.groupBy("h")
        .agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
        .where("texts = 1 AND n > 1")
        .select("h", "n", "first_id")
    )


def _without_repeats(docs: DataFrame, flags: DataFrame, strip_texts, doc_id: str, text: str, counts: bool) -> DataFrame:
    """``docs`` with what ``strip_texts`` leaves of the texts that ``flags`` names."""
    # Texts that surely have no repeated chunk stay where they are.
    bits = bit_filter(flags.select(F.xxhash64("_d", "_k").alias("h")), "h")
    rows = packed(docs, doc_id, text).withColumn("maybe", in_filter(bits, F.xxhash64("d", "k")))
    clean = rows.where("NOT maybe").select("row", F.struct(F.col("row")[text].alias("text"), F.lit(0).cast("long").alias("n_removed")).alias("new"))
    strip = F.pandas_udf(strip_texts, "text string, n_removed bigint")
    rest = rows.where("maybe").join(flags, same_row("_d", "_k"), "left")
    done = clean.union(rest.select("row", strip(F.col("row")[text], F.col("_drop"), F.col("_first"))))
    kept = [c for c in docs.columns if not counts or c != "n_removed"]
    columns = [F.col("new.text").alias(c) if c == text else F.col("row")[c].alias(c) for c in kept]
    return done.select(*columns, *(["new.n_removed"] if counts else []))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` without the repeated multi-line chunks of its texts; ``counts`` adds ``n_removed``.

    Of each repeated chunk the first place stays: the least id (a NULL one comes last), there the first time.
    Rows and other columns stay as they are (but a column with the count's name gives way); repeated rows are one row here and keep the same text. NULL
    and empty texts, and chunks of fewer than ``MIN_LINES`` lines or ``MIN_WORDS`` words, stay.
    """
    repeated = cut(repeated_chunks(docs, doc_id, text))
    owners = docs.select(F.col(doc_id).alias("_d"), row_key(doc_id, text).alias("_k"), F.explode(F.pandas_udf(_hashes, "array<bigint>")(F.col(text))).alias("h")).distinct()
    mine = F.coalesce(F.col("_d"), F.lit((1 << 63) - 1)) == F.col("first_id")
    flags = (
        owners.join(repeated, "h")
        .groupBy("_d", "_k")
        .agg(
            F.collect_list(F.when(~mine, F.col("h"))).alias("_drop"),
            F.collect_list(F.when(mine, F.col("h"))).alias("_first"),
        )
    )
    return _without_repeats(docs, cut(flags), _strip, doc_id, text, counts)


def _blocks(texts: pd.Series, most: int = 1 << 19) -> Iterator[list[str | None]]:
    """The texts in blocks of about ``most`` characters; a longer text stands alone."""
    block: list[str | None] = []
    chars = 0
    for text in texts:
        n = len(text) if text else 0
        if block and chars + n > most:
            yield block
            block, chars = [], 0
        block.append(text)
        chars += n + 1
    if block:
        yield block


def _text_lines(text: str | None) -> tuple[list[str], list[str]]:
    """The lines of a text, blank ones as part of the line before (at the start of the text of the one after), and what each says."""
    lines = lines_of(text or "")
    bare = [line.strip() for line in lines]
    if all(bare):
        return lines, bare
    joined: list[str] = []
    head = ""
    for line, body in zip(lines, bare):
        if body:
            joined.append(head + line)
            head = ""
        elif joined:
            joined[-1] += line
        else:
            head += line
    return (joined or [head]), [body for body in bare if body]


class Units:
    """The units of some texts: the shortest runs of lines with ``MIN_WORDS`` words, by start and end.

    A line of ``MIN_WORDS`` words is a unit by itself, a shorter one starts a run and ends one. So of any
    passage with that many words each line is in a unit within the passage, whatever stands around it.
    With ``short`` what stands between two line feeds is a unit too if it has fewer words (one or more sentences).
    A unit's hash is rolled over the hashes of its lines; ``bits`` are left of it.
    """

    def __init__(self, texts: list[str | None], bits: int = 64, short: bool = False):
        self.lines: list[list[str]] = []
        self.bare: list[str] = []
        first = [0]
        feeds: list[bool] = []
        for text in texts:
            lines, bare = _text_lines(text)
            self.lines.append(lines)
            self.bare += bare
            first.append(len(self.bare))
            if short and bare:
                # Line feeds before the first word end no line; the end of the text does.
                feeds.append("\n" in lines[0].lstrip())
                feeds += ["\n" in line for line in lines[1:]]
                feeds[-1] = True
        self.first = np.array(first)
        n = len(self.bare)
        # Words before each line; a line counts MIN_WORDS + 1 at most.
        words = np.zeros(n + 1, np.int64)
        np.cumsum(np.fromiter((len(b.split(None, MIN_WORDS)) for b in self.bare), np.int64, n), out=words[1:])
        text_of = np.repeat(np.arange(len(texts)), np.diff(self.first))
        k = np.arange(n)
        stop = np.searchsorted(words, words[:-1] + MIN_WORDS)
        start = np.searchsorted(words, words[1:] - MIN_WORDS, "right") - 1
        ahead, back = stop <= self.first[text_of + 1], start >= self.first[text_of]
        pairs = [k[ahead] << 32 | stop[ahead], start[back] << 32 | k[back] + 1]
        if feeds:
            ends = np.flatnonzero(np.array(feeds)) + 1
            begins = np.concatenate([[0], ends[:-1]])
            few = words[ends] - words[begins] < MIN_WORDS
            pairs.append(begins[few] << 32 | ends[few])
        pairs = np.unique(np.concatenate(pairs))
        self.start, self.stop = pairs >> 32, pairs & 0xFFFFFFFF
        self.of_text = np.searchsorted(self.start, self.first)
        line_hash = np.fromiter(map(xxhash.xxh64_intdigest, self.bare), np.uint64, n)
        rolled = line_hash[self.start]
        for j in range(1, MIN_WORDS + 1):
            longer = np.flatnonzero(self.start + j < self.stop)
            rolled[longer] = rolled[longer] * np.uint64(_BASE) + line_hash[self.start[longer] + j]
        self.hashes = rolled.view(np.int64) >> (64 - bits)

    def body(self, unit: int) -> str:
        """What is compared of a unit: its lines without the white space around them."""
        a, b = self.start[unit], self.stop[unit]
        return self.bare[a] if b == a + 1 else "\n".join(self.bare[a:b])


def units_of(text: str | None) -> tuple[list[str], list[tuple[int, int, str]]]:
    """The lines of one text, joined they are the text, and its units: ``(start, stop, body)``."""
    units = Units([text])
    return units.lines[0], [(int(a), int(b), units.body(k)) for k, (a, b) in enumerate(zip(units.start, units.stop))]


def _unit_hashes(bits: int, short: bool):
    def run(texts: pd.Series) -> pd.Series:
        made: list[np.ndarray] = []
        for block in _blocks(texts):
            units = Units(block, bits, short)
            made += np.split(units.hashes, units.of_text[1:-1])
        give_back()
        return pd.Series(made, dtype=object)

    return F.pandas_udf(run, "array<bigint>")


def _strip_units(bits: int, short: bool):
    """Removes the lines in units of ``drops`` everywhere, those of ``firsts`` after the first time.

    The units met by hash are given back with their bytes and the number of their places, so that these can be compared.
    ``bodies``, if any, names units by their bytes, each with whether its first place stays.
    """

    def run(texts: pd.Series, drops: pd.Series, firsts: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        rows, at = [], 0
        for block in _blocks(texts):
            units = Units(block, bits, short)
            hashes, starts, stops = (x.tolist() for x in (units.hashes, units.start, units.stop))
            for k, text in enumerate(block):
                drop, first, named = drops[at], firsts[at], bodies[at]
                at += 1
                # Plain numbers: comparing with NumPy's own is many times slower.
                gone, again = (set(x.tolist()) if x is not None else set() for x in (drop, first))
                stays = {x["body"]: x["first"] for x in named} if named is not None else {}
                out: set[int] = set()
                ends: dict[str, int] = {}
                met: dict[str, list[int]] = {}
                for unit in range(units.of_text[k], units.of_text[k + 1]) if gone or again or stays else ():
                    h = hashes[unit]
                    if h in gone or h in again:
                        body = units.body(unit)
                        met.setdefault(body, [h, 0])[1] += 1
                    elif not stays or (body := units.body(unit)) not in stays:
                        continue
                    start, stop = starts[unit], stops[unit]
                    # What overlaps the first place of the same run is part of it.
                    if h in gone or stays.get(body) is False or ends.setdefault(body, stop) <= start:
                        out.update(range(start, stop))
                numbers = np.array(list(met.values()), np.int64).reshape(-1, 2)
                base = int(units.first[k])
                left = "".join(line for j, line in enumerate(units.lines[k], base) if j not in out) if out else text
                rows.append((left, len(out), numbers[:, 0], list(met), numbers[:, 1]))
        give_back()
        return pd.DataFrame(rows, columns=["text", "n_removed", "h", "body", "n"])

    return F.pandas_udf(run, "text string, n_removed bigint, h array<bigint>, body array<string>, n array<bigint>")


def dedup_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: bool = True, bits: int = 64, short: bool = False) -> DataFrame:
    """``docs`` without the lines that stand in a repeated unit (``units_of``); ``counts`` adds ``n_removed``, the lines.

    Of each unit the first place stays: the least id (a NULL one comes last), there the first time. So every line
    keeps its first place, and a repeated passage of ``MIN_WORDS`` words goes whole, be it one line or many. With ``short``
    a repeated line of fewer words goes too, if it stands between line feeds; sentences inside a paragraph never do so alone.
    Units meet by hash (of ``bits`` bits). Only texts with a hash that repeats are read again; their units are removed and
    their bytes compared in one go. Where different bytes share a hash, which is next to never, the texts concerned are
    done again by bytes. Rows and other columns stay as they are (but a column with the count's name gives
    way); repeated rows are one row here and keep the same text. NULL and empty texts stay.
    """
    last = F.lit((1 << 63) - 1)
    hashed = docs.select(F.col(doc_id).alias("_d"), row_key(doc_id, text).alias("_k"), _unit_hashes(bits, short)(F.col(text)).alias("hs"))
    # No filter here: Spark would work the hashes out for it and once more for the result, in a second worker.
    hashed = cut(hashed)
    each = hashed.select(F.coalesce("_d", last).alias("id"), F.explode("hs").alias("h"))
    repeated = cut(each.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1").select("h", "first_id"))
    owners = hashed.select("_d", "_k", F.explode(F.array_distinct("hs")).alias("h")).where(in_filter(bit_filter(repeated, "h"), F.col("h")))
    mine = F.coalesce(F.col("_d"), last) == F.col("first_id")
    flags = cut(
        owners.join(repeated.hint("merge"), "h")
        .groupBy("_d", "_k")
        .agg(
            F.collect_set(F.when(~mine, F.col("h"))).alias("_drop"),
            F.collect_set(F.when(mine, F.col("h"))).alias("_first"),
        )
    )
    drop(hashed, repeated)
    # Texts that surely have no repeated unit stay where they are.
    maybe = in_filter(bit_filter(flags.select(F.xxhash64("_d", "_k").alias("h")), "h"), F.xxhash64("d", "k"))
    rows = packed(docs, doc_id, text).withColumn("maybe", maybe)
    clean = rows.where("NOT maybe").select("row", F.struct(F.col("row")[text].alias("text"), F.lit(0).cast("long").alias("n_removed")).alias("new"))
    flagged = rows.where("maybe").join(flags, same_row("_d", "_k"), "left").withColumn("words", F.col("row")[text])
    bare = F.col("row").withField(text, F.lit(None).cast("string")).alias("row")
    strip = _strip_units(bits, short)
    none = F.lit(None).cast("array<struct<body:string,first:boolean>>")
    done = cut(flagged.select(bare, "d", "k", strip("words", "_drop", "_first", none).alias("new")))

    met = done.select(F.coalesce("d", last).alias("id"), F.inline(F.arrays_zip("new.h", "new.body", "new.n")))
    same = met.groupBy("h", "body").agg(F.sum("n").alias("n"), F.min("id").alias("first_id"))
    clash = small(cut(same.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h")))
    stripped = done.select("row", F.struct("new.text", "new.n_removed").alias("new"))
    if clash.limit(1).count():
        mixed = done.select("d", "k", F.inline(F.arrays_zip("new.h", "new.body")))
        by_bytes = same.join(clash, "h").where("n > 1").select("h", "body", F.col("first_id"))
        touched = cut(mixed.join(clash, "h").select("d", "k").distinct()).withColumnsRenamed({"d": "d3", "k": "k3"})
        named = mixed.join(by_bytes, ["h", "body"]).groupBy(F.col("d").alias("d2"), F.col("k").alias("k2")).agg(
            F.collect_list(F.struct("body", (F.coalesce("d", last) == F.col("first_id")).alias("first"))).alias("named")
        )
        gone = flags.select("_d", "_k", *[F.explode_outer(F.concat("_drop", "_first")).alias("h"), F.col("_drop")]).join(clash, "h", "left_anti")
        sound = gone.groupBy("_d", "_k").agg(
            F.collect_set(F.when(F.array_contains("_drop", F.col("h")), F.col("h"))).alias("_drop"),
            F.collect_set(F.when(~F.array_contains("_drop", F.col("h")), F.col("h"))).alias("_first"),
        )
        again = (
            packed(docs, doc_id, text).join(touched, same_row("d3", "k3"), "left_semi")
            .join(sound, same_row("_d", "_k"), "left").join(named, same_row(), "left").withColumn("words", F.col("row")[text])
        )
        redone = again.select(bare, strip("words", "_drop", "_first", "named").alias("new")).select("row", F.struct("new.text", "new.n_removed").alias("new"))
        stripped = done.join(touched, same_row("d3", "k3"), "left_anti").select("row", F.struct("new.text", "new.n_removed").alias("new")).union(redone)
    kept = [c for c in docs.columns if not counts or c != "n_removed"]
    columns = [F.col("new.text").alias(c) if c == text else F.col("row")[c].alias(c) for c in kept]
    return clean.union(stripped).select(*columns, *(["new.n_removed"] if counts else []))
