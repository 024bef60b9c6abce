"""Fill-in-the-middle: texts cut at line ends into prefix, middle and suffix and put together in another order.

Method: secondary-sort assembly. A text becomes pieces of bounded size, each with its place in the output. The pieces
are shuffled by document and sorted by place, so that a task reads the pieces of one output one after the other, in
constant memory however long the output is. On the way through, the markers found in the output give each piece its
place in the original; a second sort inside the same partitions, without a shuffle, streams the text back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seed, documents that are transformed and of those the ones with the suffix first, in percent.
SEED, RATE, SUFFIX_FIRST = 7, 100, 50
#: Code points that a piece has at most.
PIECE = 1 << 13
# What stands before each part.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PARTS = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}  # the order in the original

_PIECES = "doc_id string, key binary, place bigint, piece string, times bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint"
_INFO = ["times", "n", "form", "prefix_chars", "middle_chars"]


def line_count(text: str) -> int:
    """Matches of ``[^\\n]*\\n|[^\\n]+``."""
    return text.count("\n") + (text != "" and not text.endswith("\n"))


def after_lines(text: str, *counts: int) -> list[int]:
    """Where each of the ascending numbers of lines ends."""
    out, at, done = [], 0, 0
    for count in counts:
        while done < count:
            at = text.find("\n", at) + 1 or len(text)
            done += 1
        out.append(at)
    return out


def plan(doc_id: str, text: str, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None]:
    """Number of lines, form, and the ends of prefix and middle (None in the form ``plain``)."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = line_count(text)
    if text == "" or h3 % 100 >= rate or any(mark in text for mark in PARTS):
        return n, "plain", None, None
    ends = after_lines(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    return n, "spm" if h4 % 100 < suffix_first else "psm", *ends


def output_pieces(text: str, form: str, first: int | None, second: int | None, size: int = PIECE) -> Iterator[str]:
    """The output in pieces of at most ``size`` code points; markers are pieces of their own."""
    if form == "plain":
        parts = [("", 0, len(text))]
    else:
        prefix, suffix, middle = (PREFIX, 0, first), (SUFFIX, second, len(text)), (MIDDLE, first, second)
        parts = [prefix, suffix, middle] if form == "psm" else [suffix, prefix, middle]
    for mark, start, end in parts:
        if mark:
            yield mark
        for at in range(start, end, size):
            yield text[at : min(at + size, end)]


def infill_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, size: int = PIECE) -> DataFrame:
    """The pieces of every output, unordered: ``doc_id, key, place, piece`` and, at place 0, the document's facts.

    ``key`` tells documents apart where ids repeat or are null; rows with the same id and text make the same pieces,
    which are emitted once a batch with their number, ``times``. A null id is decided by as an empty one.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "key", "place", "piece", *_INFO]
        for batch in batches:
            times: dict[tuple[str | None, str], int] = {}
            for doc, words in zip(batch["d"], batch["t"]):
                row = (None if pd.isna(doc) else doc, "" if pd.isna(words) else words)
                times[row] = times.get(row, 0) + 1
            rows: list[tuple] = []
            held = 0
            for (doc, words), count in times.items():
                key = xxhash.xxh128_digest(words.encode("utf-8", "surrogatepass"), 1 if doc is None else 0)
                n, form, first, second = plan(doc or "", words, seed, rate, suffix_first)
                facts = (count, n, form, first, None if first is None else second - first)
                place = -1
                for place, piece in enumerate(output_pieces(words, form, first, second, size)):
                    rows.append((doc, key, place, piece, *(facts if place == 0 else (count, None, None, None, None))))
                    held += len(piece)
                    if held > 1 << 23:
                        yield _frame(rows, names)
                        rows, held = [], 0
                if place < 0:
                    rows.append((doc, key, 0, "", *facts))
            yield _frame(rows, names)

    return docs.select(docs[doc_id].cast("string").alias("d"), docs[text].alias("t")).mapInPandas(emit, _PIECES)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({c: "Int64" for c in ("place", "times", "n", "prefix_chars", "middle_chars") if c in names})


def sorted_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces shuffled by document and sorted by place: Spark's secondary sort, which spills where it must."""
    return pieces.repartition("doc_id", "key").sortWithinPartitions("doc_id", "key", "place")


class _Digest:
    """Takes the pieces of one text in order and keeps only their digest."""

    def __init__(self) -> None:
        self.hash = hashlib.sha256()

    def add(self, piece: str) -> None:
        self.hash.update(piece.encode("utf-8", "surrogatepass"))

    def value(self) -> str:
        return self.hash.hexdigest()


class _Text:
    """Takes the pieces of one text in order and keeps the text."""

    def __init__(self) -> None:
        self.pieces: list[str] = []

    def add(self, piece: str) -> None:
        self.pieces.append(piece)

    def value(self) -> str:
        return "".join(self.pieces)


def _outputs(sink: Callable) -> Callable:
    """First pass over sorted pieces: what ``sink`` makes of each output, and its pieces with their place in the original.

    The place is read from the output alone: the marker that was met last names the part. The document's row, with
    ``part`` -1, goes before its pieces in the sort that follows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "key", "part", "place", "piece", "output", *_INFO]
        current = out = facts = None
        times = place = part = 0

        def closed() -> list[tuple]:
            return [] if current is None else [(*current, -1, 0, "", out.value(), times, *facts)]

        for batch in batches:
            rows: list[tuple] = []
            for doc, key, at, piece, count, *info in batch[["doc_id", "key", "place", "piece", *_INFO]].itertuples(index=False, name=None):
                at, key = int(at), bytes(key)
                doc = None if pd.isna(doc) else doc
                if (doc, key) != current:
                    rows += closed()
                    current, out, times, place, part = (doc, key), sink(), 0, -1, 0
                    facts = tuple(None if pd.isna(x) else x for x in info)
                if at == 0:
                    times += int(count)
                if at == place:
                    continue  # the same document again, from another batch
                place = at
                out.add(piece)
                if facts[1] != "plain" and piece in PARTS:
                    part = PARTS[piece]
                else:
                    rows.append((doc, key, part, at, piece, None, None, None, None, None, None))
            if rows:
                yield _frame(rows, names)
        if current is not None:
            yield _frame(closed(), names)

    return run


def _restored(sink: Callable) -> Callable:
    """Second pass, over pieces sorted by their place in the original: the document's row with what ``sink`` makes of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
        facts, back = None, None

        def closed() -> list[tuple]:
            doc, out, times, *info = facts
            return [(doc, *info, out, back.value())] * times

        for batch in batches:
            rows: list[tuple] = []
            for doc, part, piece, out, times, *info in batch[["doc_id", "part", "piece", "output", *_INFO]].itertuples(index=False, name=None):
                if part >= 0:
                    back.add(piece)
                    continue
                if facts is not None:
                    rows += closed()
                info = [None if pd.isna(x) else x for x in info]
                facts, back = (None if pd.isna(doc) else doc, out, int(times), *info), sink()
            if rows:
                yield _frame(rows, names)
        if facts is not None:
            yield _frame(closed(), names)

    return run


def assembled(pieces: DataFrame, digests: bool = False) -> DataFrame:
    """Per document ``doc_id`` (text), ``n, form, prefix_chars, middle_chars, output, restored``.

    ``output`` and ``restored`` are the assembled text and the original rebuilt from it, or with ``digests`` the SHA-256
    of each, for which no text is ever held whole.
    """
    sink = _Digest if digests else _Text
    first = sorted_pieces(pieces).mapInPandas(
        _outputs(sink),
        "doc_id string, key binary, part int, place bigint, piece string, output string, times bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint",
    )
    # All pieces of a document are in one partition already: the second sort stays inside it.
    return first.sortWithinPartitions("doc_id", "key", "part", "place").mapInPandas(
        _restored(sink), "doc_id string, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, restored string"
    )


def infill_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Training texts: ``doc_id, n, form, prefix_chars, middle_chars, output, restored``, one row per row of ``docs``.

    Null texts are empty. Texts that hold a marker, and empty ones, stay as they are (form ``plain``). Repeated rows give
    repeated results; other columns are not looked at; an empty table gives none. Long texts move in pieces of ``size``
    code points.
    """
    kind = docs.schema[doc_id].dataType
    return assembled(infill_pieces(docs, doc_id, text, **options)).withColumn("doc_id", F.col("doc_id").cast(kind))


def infill_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """As ``infill_texts``, with ``output_sha256`` and ``restored_sha256`` in place of the texts, in constant memory."""
    kind = docs.schema[doc_id].dataType
    done = assembled(infill_pieces(docs, doc_id, text, **options), digests=True)
    return done.select(
        F.col("doc_id").cast(kind).alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.col("output").alias("output_sha256"), F.col("restored").alias("restored_sha256"),
    )
