"""Benchmark decontamination: which words of a document lie in a window that a benchmark item also has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstruct.llm.common import any_of, ascii_lower, bit_filter, cut, in_filter, passing_cuts, row_key, without

WINDOW = 10
#: Words of a shingle, the token of the join; windows of fewer words are their own token.
SHINGLE = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _shingle(words: list[Column]) -> Column:
    """Hash of the words that stand here, as many as are given."""
    return F.xxhash64(F.lit(len(words)), *words)


def _positions(words: str, n: int, *keep: str) -> list:
    """Select list that puts each position of the array ``words`` beside the next ``n - 1`` words."""
    shifted = [F.col(words)] + [F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0))) for k in range(1, n)]
    zipped = F.arrays_zip(*[c.alias(f"w{k}") for k, c in enumerate(shifted)])
    return [*keep, F.posexplode(zipped).alias("pos", "z")]


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """``(window_id, len, words)`` of the distinct windows and ``(window_id, item_id)`` of the items that have them."""
    words = items.select(F.col(item_id).cast("string").alias("item_id"), words_of(F.col(text)).alias("words")).where(
        F.col("item_id").isNotNull() & (F.size("words") > 0)
    )
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    each = words.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, window))).alias("words"))
    each = cut(each.select("item_id", F.array_join("words", " ").alias("window_id"), "words").distinct())
    windows = each.select("window_id", F.size("words").alias("len"), "words").distinct()
    return windows, each.select("window_id", "item_id")


def find_windows(docs: DataFrame, windows: DataFrame, doc_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """``(doc_id, row_key, start, len, window_id)`` of every occurrence of every window in every document."""
    k = min(SHINGLE, window)
    # Tokens of a window: all its shingles with their place; short windows have one, of their own length.
    size = F.least(F.col("len"), F.lit(k))
    places = F.sequence(F.lit(0), F.col("len") - size)
    tokens = windows.select("window_id", "len", F.explode(places).alias("offset"), "words", size.alias("k")).select(
        "window_id", "len", "offset", F.array_join(F.slice("words", F.col("offset") + 1, F.col("k")), " ").alias("token"), "k", "words"
    )
    parts = [F.get("words", F.col("offset") + i) for i in range(k)]
    hashed = F.lit(None).cast("long")
    for n in range(1, k + 1):
        hashed = F.when(F.col("k") == n, _shingle(parts[:n])).otherwise(hashed)
    tokens = cut(tokens.withColumn("h", hashed).drop("words"))
    known = tokens.groupBy("token").agg(F.first("h").alias("h"))
    bits = bit_filter(known, "h")

    # Occurrences of the benchmark's shingles, the only rows of documents that are shuffled.
    read = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), words_of(F.col(text)).alias("ws"))
    read = read.select("doc_id", "row_key", "ws", F.size("ws").alias("n_words")).where("n_words > 0")
    here = read.select(*_positions("ws", k, "doc_id", "row_key", "n_words"))
    names = [F.col(f"z.w{i}") for i in range(k)]
    hs = [_shingle(names[: n + 1]) for n in range(k)]
    hit = [in_filter(bits, h) & names[n].isNotNull() for n, h in enumerate(hs)]
    kept = here.where(any_of(hit)).select(
        "doc_id",
        "row_key",
        "n_words",
        "pos",
        F.explode(
            F.array_compact(
                F.array(
                    *[
                        F.when(hit[n], F.struct(hs[n].alias("h"), F.concat_ws(" ", *names[: n + 1]).alias("token")))
                        for n in range(k)
                    ]
                )
            )
        ).alias("t"),
    )
    seen = kept.select("doc_id", "row_key", "n_words", "pos", "t.token")
    seen = cut(seen.join(known.select("token"), "token"))

    # Rarest first: the prefix of a window is its least frequent shingle; one that never occurs rules it out.
    often = seen.groupBy("token").agg(F.count("*").alias("df"))
    ranked = tokens.join(often, "token", "left")
    prefix = (
        ranked.groupBy("window_id", "len")
        .agg(
            F.min(F.coalesce("df", F.lit(0))).alias("least"),
            F.min_by(F.struct("token", "offset"), F.struct(F.coalesce("df", F.lit(0)), "offset")).alias("p"),
            F.count("*").alias("need"),
        )
        .where("least > 0")
        .select("window_id", "len", "need", "p.token", "p.offset")
    )
    # Position and length bounds before anything is verified.
    candidates = (
        seen.join(prefix, "token")
        .withColumn("start", F.col("pos") - F.col("offset"))
        .where("start >= 0 AND start + len <= n_words")
        .select("doc_id", "row_key", "start", "len", "need", "window_id")
        .distinct()
    )
    # Exact containment: every shingle of the window stands at its place, compared as text.
    wanted = candidates.join(tokens.select("window_id", "offset", "token"), "window_id").select(
        "doc_id", "row_key", "start", "len", "need", "window_id", (F.col("start") + F.col("offset")).alias("pos"), "token"
    )
    there = seen.select(F.col("doc_id").alias("d"), F.col("row_key").alias("r"), F.col("pos").alias("q"), F.col("token").alias("t")).distinct()
    met = wanted.join(
        there,
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("r")) & (F.col("pos") == F.col("q")) & (F.col("token") == F.col("t")),
    )
    return (
        met.groupBy("doc_id", "row_key", "start", "len", "window_id", "need")
        .agg(F.count("*").alias("n"))
        .where("n = need")
        .select("doc_id", "row_key", "start", "len", "window_id")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that no item's window occurs in, with all their columns; the verdict is on whole texts."""
    with passing_cuts() as keep:
        found = contamination(docs, items, doc_id, text, **options).where("contaminated")
        bad = keep(cut(found.select(F.col("doc_id").alias("d2"), F.col("row_key").alias("k2")).distinct()))
    return without(docs, bad, doc_id, text)


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and ``row_key``.

    A prefix-filtered join on shingles of three words. A fixed-size bit filter drops the documents' shingles
    that no item has before any shuffle; the join on the shingle's text follows. Windows that occur in
    many items are searched once. NULL and wordless texts have no words and are clean; items without words
    or with a NULL id match nothing; an empty benchmark leaves all clean. Repeated rows are judged alike;
    rows with one id and different texts are judged each by its own text. A window may overlap others.
    """
    windows, owners = item_windows(items, item_id, item_text, window)
    found = cut(find_windows(docs, windows, doc_id, text, window))
    hit_words = (
        found.select("doc_id", "row_key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos"))
        .distinct()
        .groupBy("doc_id", "row_key")
        .agg(F.count("*").alias("n_hit"))
    )
    hit_items = (
        found.select("doc_id", "row_key", "window_id")
        .distinct()
        .join(owners, "window_id")
        .select("doc_id", "row_key", "item_id")
        .distinct()
        .groupBy("doc_id", "row_key")
        .agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    )
    hits = hit_words.join(hit_items.withColumnRenamed("row_key", "r").withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("r")))
    hits = hits.select(F.col("d"), F.col("r"), "n_hit", "ids")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        row_key(doc_id, text).alias("row_key"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(_ANY_CASE)), F.lit(0)).cast("long").alias("n_words"),
    )
    return rows.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("r")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "row_key",
    )
