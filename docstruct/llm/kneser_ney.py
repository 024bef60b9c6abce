"""Quality classifier: interpolated modified Kneser-Ney trigram model of trusted text, thresholds per language."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstruct.llm.common import bit_filter, cut, give_back, in_filter, passing_cuts, row_key, small, without

#: A symbol of the model is a code point plus one; 0 is kept for the ends of a text. Three of them make a key of 63 bits.
CODE_BITS, SYMBOLS = 21, 0x110000 + 1
#: Up to so many priced trigrams go to every task (some 20 MB); more are joined over the cluster.
BROADCAST = 1 << 19
#: Trigrams that a task holds before it sums them: a megabyte or two, and some ten while they are sorted.
HELD = 1 << 17
#: The small model, not registered: symbols are classes of characters, so that its tables have a fixed size.
CLASSES = 64
GRAMS = CLASSES**3
#: A document is kept while its perplexity lies between these quantiles of its language's trusted documents,
#: widened by the factor. Short texts vary more: so many trigrams of its language's average join each document.
LOW, HIGH, SLACK, PRIOR = 0.002, 0.99, 1.1, 100
_SPACES, _STOPS, _SIGNS = " \t\r\x0b\x0c", ".,", "#$%&*|<>@^~`{}[]\\_=+/"


def symbol_of(code: int) -> int:
    """Class of a code point: 0 is kept for the ends of a text."""
    c = chr(code)
    if c in _SPACES:
        return 1
    if c == "\n":
        return 2
    if c in _STOPS:
        return 4 + _STOPS.index(c)
    if "a" <= c <= "z":
        return 8 + ord(c) - 97
    if "A" <= c <= "Z":
        return 34 + ord(c) - 65
    if c.isdigit():
        return 3
    if code < 128:
        return 6 if c in _SIGNS else 7
    if not c.isalpha():
        return 63
    return 62 if c.isupper() else 60 + code % 2


_ASCII = np.array([symbol_of(c) for c in range(128)], np.int64)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a whole text, two ends before it and one after, and how often each stands there."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = _ASCII[np.minimum(codes, 127)]
    other = np.flatnonzero(codes > 127)
    if len(other):
        kinds, place = np.unique(codes[other], return_inverse=True)
        symbols[other] = np.array([symbol_of(int(c)) for c in kinds])[place]
    s = np.concatenate([[0, 0], symbols, [0]])
    key = (s[:-2] * CLASSES + s[1:-1]) * CLASSES + s[2:]
    if len(key) > GRAMS // 16:
        n = np.bincount(key, minlength=GRAMS)
        some = np.flatnonzero(n)
        return some, n[some]
    return np.unique(key, return_counts=True)


def code_grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of code points of a whole text, ends as in ``gram_counts``, and how often each stands there."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.zeros(len(codes) + 3, np.int64)
    s[2:-1] = codes
    s[2:-1] += 1
    return np.unique(s[:-2] << 2 * CODE_BITS | s[1:-1] << CODE_BITS | s[2:], return_counts=True)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    n = np.zeros(len(gram), np.int64)
    np.add.at(n, at, np.concatenate([k for _, k in parts]))
    return gram, n


def counted(texts: Iterable[str | None], grams=gram_counts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(gram, n)`` of all texts, in parts: a gram comes again only where more than ``HELD`` different ones passed."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for t in texts:
        parts.append(grams(t))
        held += len(parts[-1][0])
        if held > HELD:
            parts = [_summed(parts)]
            held = len(parts[0][0])
            if held > HELD // 2:
                yield parts[0]
                parts, held = [], 0
    if parts:
        yield _summed(parts)


def count_corpus(texts: DataFrame, text: str = "text", grams=gram_counts) -> DataFrame:
    """``(gram, n)`` over all rows: summed in parts of bounded size per task, then by hash of the gram over the cluster."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for gram, n in counted((t for batch in batches for t in batch["text"]), grams):
            yield pd.DataFrame({"gram": gram, "n": n})
        give_back()

    rows = texts.select(F.col(text).alias("text")).mapInPandas(count, "gram bigint, n bigint")
    return rows.groupBy("gram").agg(F.sum("n").alias("n"))


def _discounted(counts: DataFrame, context: list[str], n: str) -> DataFrame:
    """Adds ``own``, the discounted share of each count in its context, and ``rest``, what the context leaves.

    The three discounts come from how many grams were seen once to four times.
    """
    seen = counts.agg(*[F.sum(F.when(F.col(n) == k, 1).otherwise(0)).alias(f"t{k}") for k in (1, 2, 3, 4)])
    y = F.col("t1") / F.greatest(F.col("t1") + 2 * F.col("t2"), F.lit(1))

    def discount(k: int) -> Column:
        exact = k - (k + 1) * y * F.col(f"t{k + 1}") / F.greatest(F.col(f"t{k}"), F.lit(1))
        return F.greatest(F.least(exact, F.lit(k - 0.1)), F.lit(0.1))

    d = seen.select(F.array(*[discount(k) for k in (1, 2, 3)]).alias("d")).scalar()
    cut_off = F.get(d, F.least(F.col(n), F.lit(3)).cast("int") - 1)
    counts = counts.withColumn("off", cut_off)
    totals = counts.groupBy(*context).agg(F.sum(n).alias("all"), F.sum("off").alias("taken"))
    return counts.join(totals, context).select(
        *context, "w", ((F.col(n) - F.col("off")) / F.col("all")).alias("own"), (F.col("taken") / F.col("all")).alias("rest")
    )


def _symbols(bits: int) -> list[Column]:
    """``u, v, w`` of the key ``gram``."""
    last = F.lit((1 << bits) - 1)
    return [F.shiftright("gram", 2 * bits).alias("u"), F.shiftright("gram", bits).bitwiseAND(last).alias("v"), F.col("gram").bitwiseAND(last).alias("w")]


def price(counts: DataFrame, wanted: DataFrame, bits: int = CODE_BITS, symbols: int = SYMBOLS) -> DataFrame:
    """``(gram, nll)`` of the different trigrams ``wanted``: minus the natural logarithm of w's probability after u, v.

    Interpolated modified Kneser-Ney: trigrams by count, bigrams and single symbols by the number of different
    symbols before them; every order discounts with three constants and hands the rest down, at the end to
    equal shares of all ``symbols``. Count tables and what is asked of them are joined by context over the cluster.
    No counts at all give equal shares.
    """
    three = cut(counts.select(*_symbols(bits), "n"))
    two = cut(three.groupBy("v", "w").agg(F.count("*").alias("n")))
    one = cut(two.groupBy("w").agg(F.count("*").alias("n")).withColumn("c", F.lit(0)))
    asked = cut(wanted.select("gram", *_symbols(bits)))
    own = F.coalesce("own", F.lit(0.0))
    p1 = _discounted(one, ["c"], "n")
    rest = p1.agg(F.coalesce(F.max("rest"), F.lit(1.0)).alias("rest")).scalar()
    words = asked.select("w").distinct()
    p1 = cut(words.join(p1.select("w", "own"), "w", "left").select("w", (own + rest / symbols).alias("p1")))

    def lower(found: DataFrame, rows: DataFrame, context: list[str], below: DataFrame, p: str, name: str, *keep: str) -> DataFrame:
        found = cut(found)
        left = found.groupBy(*context).agg(F.max("rest").alias("rest"))
        joined = rows.join(found.drop("rest"), [*context, "w"], "left").join(left, context, "left").join(below, [c for c in below.columns if c != p])
        return joined.select(*keep, (own + F.coalesce("rest", F.lit(1.0)) * F.col(p)).alias(name))

    p2 = cut(lower(_discounted(two, ["v"], "n"), asked.select("v", "w").distinct(), ["v"], p1, "p1", "p2", "v", "w"))
    p3 = lower(_discounted(three, ["u", "v"], "n"), asked, ["u", "v"], p2, "p2", "p3", "gram")
    return cut(p3.select("gram", (-F.log("p3")).alias("nll")))


def train(counts: DataFrame) -> DataFrame:
    """``price`` of all ``GRAMS`` trigrams of the small model."""
    return price(counts, counts.sparkSession.range(GRAMS).select(F.col("id").alias("gram")), 6, CLASSES)


def score(docs: DataFrame, model: DataFrame, *keep: str, text: str = "text", most: int = BROADCAST) -> DataFrame:
    """Adds ``nll`` (summed) and ``n_grams`` to the columns ``keep``: one row per different value of them.

    Each document's distinct trigrams and their counts are joined with the model, which has a row for each of them.
    A model of at most ``most`` rows, counted here, goes to every task and the documents' trigrams stay where they
    are; a larger one is joined by trigram over the cluster. Sums are partial before the narrow shuffle.
    """
    model = F.broadcast(model) if model.count() <= most else model.hint("merge")
    fields = docs.select(*keep).schema

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.iloc[a : a + 256]
                made = [code_grams(t) for t in part["_text"]]
                yield part.drop(columns="_text").assign(g=[g for g, _ in made], n=[n for _, n in made])
            give_back()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    each = docs.select(*keep, F.col(text).alias("_text")).mapInPandas(grams, f"{kinds}, g array<bigint>, n array<bigint>")
    rows = each.select(*keep, F.inline(F.arrays_zip("g", "n")).alias("gram", "n"))
    return (
        rows.join(model, "gram")
        .groupBy(*keep)
        .agg(F.sum(F.col("nll") * F.col("n")).alias("nll"), F.sum("n").alias("n_grams"))
    )


def trusted_ids(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Ids that are labelled good and never bad or toxic."""
    rows = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("trusted_id"))
    return rows.agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q > 0 AND coalesce(t, 0) <= 0").select("trusted_id")


def classify(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", low: float = LOW, high: float = HIGH, slack: float = SLACK, most: int = BROADCAST
) -> DataFrame:
    """``doc_id, row_key, lang, perplexity, n_grams, low, high, kept``: a row per different id, text and language.

    The model and the quantiles come from all trusted documents. A language without trusted documents (a NULL
    one too) uses the quantiles of all of them; without any trusted document all are kept. NULL and empty texts
    are one trigram of ends, and rejected. Repeated rows are one row here: they are judged alike.
    """
    trusted = cut(trusted_ids(labels))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), row_key(doc_id, text).alias("row_key"))
    # A fixed-size filter first: only texts that may be trusted are shuffled for the exact join.
    bits = bit_filter(trusted.select(F.xxhash64("trusted_id").alias("h")), "h")
    learned = rows.select("doc_id", "text").where("text IS NOT NULL AND text <> ''").where(in_filter(bits, F.xxhash64("doc_id")))
    learned = learned.join(trusted.hint("merge"), F.col("doc_id") == F.col("trusted_id"), "left_semi")
    # Counts of the trusted texts, asked for the trigrams of all texts: both grow with the corpus, and meet by hash.
    model = price(count_corpus(learned, grams=code_grams), count_corpus(rows, grams=code_grams))
    scored = cut(score(rows, model, "doc_id", "row_key", "lang", most=most))
    known = scored.join(trusted, F.col("doc_id") == F.col("trusted_id"), "left_semi").where("n_grams > 1")
    mean = (F.sum("nll") / F.sum("n_grams")).alias("mean")
    by_lang = small(cut(known.where("lang IS NOT NULL").groupBy(F.col("lang").alias("l")).agg(mean)))
    every = known.agg(mean).scalar()
    smooth = F.exp((F.col("nll") + PRIOR * F.coalesce("mean", "every", F.lit(0.0))) / (F.col("n_grams") + PRIOR))

    def perplexities(rows: DataFrame) -> DataFrame:
        return rows.join(by_lang, F.col("lang") == F.col("l"), "left").withColumn("every", every).withColumn("perplexity", smooth).drop("l", "mean", "every")

    bounds = [F.percentile_approx("perplexity", q, 10000) for q in (low, high)]
    known = perplexities(known)
    limits = small(cut(known.where("lang IS NOT NULL").groupBy(F.col("lang").alias("l")).agg(bounds[0].alias("a"), bounds[1].alias("b"))))
    overall = known.agg(F.struct(bounds[0].alias("a"), bounds[1].alias("b")).alias("all")).scalar()
    joined = perplexities(scored).join(limits, F.col("lang") == F.col("l"), "left").withColumn("all", overall)
    joined = joined.select(
        "doc_id", "row_key", "lang", "perplexity", "n_grams", (F.coalesce("a", "all.a") / slack).alias("low"), (F.coalesce("b", "all.b") * slack).alias("high")
    )
    within = F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return joined.withColumn("kept", within & (F.col("n_grams") > 1))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns; repeated rows stay repeated.

    Rows with one id and text but different languages go if any of them is rejected.
    """
    with passing_cuts() as keep:
        bad = classify(docs, labels, doc_id, text, lang, **options).where("NOT kept")
        bad = keep(cut(bad.select(F.col("doc_id").alias("d2"), F.col("row_key").alias("k2")).distinct()))
    return without(docs, bad, doc_id, text)
