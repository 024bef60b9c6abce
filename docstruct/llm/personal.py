"""Personal data: fixed patterns give the seeds, their contexts find more of the same kind. DataFrame operations only.

Method: bootstrapped contextual extraction. The spans that the fixed patterns find are seeds. Words around them are lexical
patterns; tokens with several digits that no seed covers are candidates and have patterns too. In the graph of patterns and
instances (texts of spans), a pattern's confidence in a kind is the share of its distinct instances that are known to be of
that kind, weighted by their scores; an instance's score is the confidence of its best pattern. Instances that reach a
threshold are known in the next round, and so their other contexts can become patterns. Scores are whole thousandths, so
that results do not depend on the order of additions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstruct.llm.common import cut, packed, same_row

# Kinds of spans in the order of reports.
KINDS = ("email", "ip", "card", "phone")
_OTHER = 4
#: Least share (thousandths) of a pattern's instances that are known, least number of those, rounds of scoring.
CONFIDENCE, SUPPORT, ROUNDS = 700, 3, 4
#: Digits that a candidate has at least; characters around a span that are read for its context.
DIGITS, REACH = 4, 48

# The four patterns as the contract states them, written so that no step is tried twice on long runs of characters: what
# can start only where a run starts looks behind itself, and repeated groups are read as runs up to the place where the
# group could not go on. ``\G`` is the end of the last match, where a new one may start inside a run.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@(?={_LABEL}++\.{_LABEL})[A-Za-z0-9.-]+?(?=\.(?!{_LABEL})|(?![A-Za-z0-9.-]))"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]+?(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_TOKEN = "[0-9A-Za-z@._%+/#-]"
_CANDIDATE = rf"(?<!{_TOKEN})(?=(?:[A-Za-z@._%+/#-]*+[0-9]){{{DIGITS}}}){_TOKEN}++"
_PATTERNS = (_EMAIL, _IP, _CARD, _PHONE, _CANDIDATE)


def luhn(digits: Column) -> Column:
    """Whether a string of up to 19 digits passes the Luhn test."""
    reverse = F.reverse(digits)
    at = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def worth(k: Column) -> Column:
        digit = F.substring(reverse, k, F.lit(1)).cast("int")
        return F.when(k % 2 == 1, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))

    return F.aggregate(F.transform(at, worth), F.lit(0), lambda total, x: total + x) % 10 == 0


def holds(kind: Column, hit: Column) -> Column:
    """Whether a match counts: parts of an address, number of digits, Luhn."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    size = F.length(digits)
    part = F.forall(F.split(hit, r"\."), lambda x: x.rlike("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    card = F.when(size.between(16, 19), luhn(F.substring(digits, 1, 19))).otherwise(F.lit(False))
    return (
        F.when(kind == KINDS.index("ip"), part)
        .when(kind == KINDS.index("card"), card)
        .when(kind == KINDS.index("phone"), size.between(8, 15))
        .otherwise(F.lit(True))
    )


def _plain(context: Column) -> Column:
    """A context in the form that is compared: lower case, digits as 0, each white space as one blank."""
    return F.regexp_replace(F.regexp_replace(F.lower(context), "[0-9]+", "0"), r"\s+", " ")


def matches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``d, k, kind, nth, gap, hit, before, after`` of every match of the patterns in texts that can have one.

    ``gap`` is the number of code points since the last match of the kind; ``before`` and ``after`` are what stands around.
    """
    rows = packed(docs, doc_id, text).select("d", "k", F.col("row").getField(text).alias("text"))
    rows = rows.where(F.col("text").rlike("[0-9]") | F.col("text").contains("@"))

    def found(kind: int) -> Column:
        pattern = F.lit(_PATTERNS[kind])
        hits = F.regexp_extract_all(F.col("text"), pattern, F.lit(0))
        pieces = F.split(F.col("text"), _PATTERNS[kind], -1)
        both = F.arrays_zip(pieces.alias("piece"), hits.alias("hit"), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("next"))
        row = F.transform(
            both,
            lambda x, i: F.struct(
                F.lit(kind).alias("kind"),
                i.alias("nth"),
                F.char_length(x["piece"]).alias("gap"),
                x["hit"].alias("hit"),
                F.substring(x["piece"], -REACH, REACH).alias("before"),
                F.substring(x["next"], 1, REACH).alias("after"),
            ),
        )
        # The rest after the last match is no match.
        return F.filter(row, lambda x: x["hit"].isNotNull())

    wide = rows.select("d", "k", F.explode(F.concat(*[found(k) for k in range(len(_PATTERNS))])).alias("m"))
    return wide.select("d", "k", "m.*")


def placed(found: DataFrame) -> DataFrame:
    """``d, k, kind, start, end, hit, before, after`` of the matches that count; candidates only where no seed is.

    Rows with the same id and text have the same matches and give them once. Positions are running sums over the few matches
    of a document, on the cluster, whatever their number.
    """
    once = found.dropDuplicates(["d", "k", "kind", "nth"]).repartition("d", "k")
    so_far = Window.partitionBy("d", "k", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("hit")
    rows = once.withColumn("end", F.sum(F.col("gap") + size).over(so_far)).withColumn("start", F.col("end") - size)
    rows = rows.where(holds(F.col("kind"), F.col("hit")))
    # A candidate loses the punctuation at its ends.
    other = F.col("kind") == _OTHER
    head = F.when(other, F.length(F.regexp_extract("hit", "^[^0-9A-Za-z]*", 0))).otherwise(F.lit(0))
    tail = F.when(other, F.length(F.regexp_extract("hit", "[^0-9A-Za-z]*+$", 0))).otherwise(F.lit(0))
    rows = rows.withColumns({"head": head, "tail": tail}).select(
        "d", "k", "kind",
        (F.col("start") + F.col("head")).alias("start"), (F.col("end") - F.col("tail")).alias("end"),
        F.expr("substring(hit, head + 1, char_length(hit) - head - tail)").alias("hit"),
        F.concat("before", F.expr("substring(hit, 1, head)")).alias("before"),
        F.concat(F.expr("right(hit, tail)"), F.col("after")).alias("after"),
    )
    # Seeds that start at or before a candidate's end and end after its start overlap it.
    doc = Window.partitionBy("d", "k").orderBy("start")
    seed = F.col("kind") != _OTHER
    rows = rows.withColumns(
        {
            "reached": F.max(F.when(seed, F.col("end"))).over(doc.rangeBetween(Window.unboundedPreceding, 0)),
            "next_seed": F.min(F.when(seed, F.col("start"))).over(doc.rangeBetween(0, Window.unboundedFollowing)),
        }
    )
    free = ~(F.coalesce(F.col("reached") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next_seed") < F.col("end"), F.lit(False)))
    return rows.where(seed | free).drop("reached", "next_seed")


def with_patterns(spans: DataFrame) -> DataFrame:
    """``kind, hit, pattern``: the words before a span (one and two of them, with what stands between), and one with the next word."""
    near = spans.select(
        "kind", "hit",
        F.nullif(F.regexp_extract(_plain(F.col("before")), r"\p{L}{1,24}[^\p{L}]{0,8}$", 0), F.lit("")).alias("one"),
        F.nullif(F.regexp_extract(_plain(F.col("before")), r"\p{L}{1,24}[^\p{L}]{1,8}\p{L}{1,24}[^\p{L}]{0,8}$", 0), F.lit("")).alias("two"),
        F.nullif(F.regexp_extract(_plain(F.col("after")), r"^[^\p{L}]{0,8}\p{L}{1,24}", 0), F.lit("")).alias("right"),
    )
    patterns = F.array(
        F.concat(F.lit("1:"), F.col("one")), F.concat(F.lit("2:"), F.col("two")), F.concat(F.lit("3:"), F.col("one"), F.lit("_"), F.col("right"))
    )
    return near.select("kind", "hit", F.explode(F.array_compact(patterns)).alias("pattern"))


def graph(spans: DataFrame, support: int = SUPPORT) -> DataFrame:
    """Distinct ``pattern, hit`` and the pattern's number of instances, without patterns that have too few to count ever.

    The pairs are made distinct before they move; a pattern that a third of all spans share is a count with partial results.
    """
    pairs = cut(with_patterns(spans).select("pattern", "hit").distinct())
    sizes = pairs.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    return cut(pairs.join(sizes, "pattern"))


def bootstrap(spans: DataFrame, confidence: int = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Accepted patterns ``pattern, kind, confidence`` and known instances ``hit, kind, score``, seeds (score 1000) included.

    Ends when a round finds nothing new, after ``rounds`` rounds at the latest.
    """
    edges = graph(spans, support)
    seeds = cut(spans.where(F.col("kind") != _OTHER).select("hit", "kind", F.lit(1000).cast("long").alias("score")).distinct())
    known, before, accepted = seeds, seeds.count(), None
    for _ in range(rounds):
        rated = edges.join(known, "hit").groupBy("pattern", "kind").agg(
            F.sum("score").alias("weight"), F.count("*").alias("known"), F.max("n").alias("n")
        )
        rated = rated.withColumn("confidence", F.floor(F.col("weight") / F.col("n")).cast("long"))
        accepted = cut(rated.where((F.col("known") >= support) & (F.col("confidence") >= confidence)).select("pattern", "kind", "confidence"))
        met = edges.join(accepted, "pattern").groupBy("hit", "kind").agg(F.max("confidence").alias("score"))
        known = cut(seeds.unionByName(met).groupBy("hit", "kind").agg(F.max("score").alias("score")))
        now = known.count()
        if now == before:
            break
        before = now
    return accepted, known


def personal_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``d2, k2, kind, start, end, base``: seeds (``base``) and the occurrences of the instances found by context.

    ``kind`` numbers ``KINDS``; positions are code points, ``end`` exclusive. ``(d2, k2)`` names the rows of ``docs`` with an
    id and a text (``common.row_key``). An instance of two kinds goes to the one with the higher score, the earlier if equal.
    """
    spans = cut(placed(matches(docs, doc_id, text)))
    _, known = bootstrap(spans, **options)
    best = known.groupBy("hit").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("found"))
    others = spans.where(F.col("kind") == _OTHER).join(best, "hit").select("d", "k", F.col("found").alias("kind"), "start", "end", F.lit(False).alias("base"))
    base = spans.where(F.col("kind") != _OTHER).select("d", "k", "kind", "start", "end", F.lit(True).alias("base"))
    return base.unionByName(others).withColumnsRenamed({"d": "d2", "k": "k2"})


def _listed(wanted: Column) -> Column:
    """``kind:start:end`` of the wanted spans by kind, then start, comma-joined."""
    rows = F.array_sort(F.collect_list(F.when(wanted, F.struct("kind", "start", "end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def personal_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the number of base spans of each kind, ``base_sha256`` and ``spans``.

    Null and empty texts have no spans; repeated rows repeat their result; other columns are not looked at.
    """
    spans = personal_spans(docs, doc_id, text, **options)
    counts = [F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    listed = spans.groupBy("d2", "k2").agg(*counts, _listed(F.col("base")).alias("base_spans"), _listed(F.lit(True)).alias("spans"))
    rows = packed(docs, doc_id, text).select("d", "k").join(listed, same_row(), "left")
    return rows.select(
        F.col("d").alias("doc_id"),
        *[F.coalesce(f"n_{name}", F.lit(0).cast("long")).alias(f"n_{name}") for name in KINDS],
        F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def masked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans are one, under the first's kind.

    Only texts with spans move.
    """
    spans = personal_spans(docs, doc_id, text, **options)
    doc = Window.partitionBy("d2", "k2").orderBy("start", F.desc("end"), "kind")
    earlier = F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    heads = spans.withColumn("opens", (F.col("start") >= F.coalesce(earlier, F.lit(0))).cast("int"))
    runs = heads.withColumn("run", F.sum("opens").over(doc.rowsBetween(Window.unboundedPreceding, 0))).groupBy("d2", "k2", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"), "kind")).alias("kind")
    )
    before = F.coalesce(F.lag("end").over(Window.partitionBy("d2", "k2").orderBy("start")), F.lit(0))
    cuts = runs.withColumn("from", before).groupBy("d2", "k2").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "kind", "from"))).alias("cuts")
    )
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    words = F.col("row").getField(text)
    joined = F.concat(
        F.array_join(
            F.transform("cuts", lambda x: F.concat(F.substring(words, x["from"].cast("int") + 1, (x["start"] - x["from"]).cast("int")), F.get(names, x["kind"]))), ""
        ),
        F.substring(words, F.element_at("cuts", -1)["end"].cast("int") + 1, F.char_length(words)),
    )
    rows = packed(docs, doc_id, text).join(cuts, same_row(), "left")
    new = F.when(F.col("cuts").isNull(), words).otherwise(joined)
    return rows.select(*[new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
