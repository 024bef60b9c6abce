"""SimHash near-duplicates: fingerprints of word shingles, pigeonring filtering, components."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstruct.llm.common import bit_filter, components, cut, give_back, in_filter, packed, passing_cuts, row_key, same_row

SEED = 42
#: ``op9``: words of a shingle, bits that may differ, segments of the ring.
WORDS, DISTANCE, SEGMENTS = 3, 2, 16
#: Near copies: words of a shingle, Jaccard similarity, min-wise samples, and those that similar texts share at least.
NEAR_WORDS, SIMILARITY, SKETCHES, SHARED = 5, 0.8, 24, 6
#: Members up to which a group needs no pivot, and those of a part of a larger group.
SMALL, PART = 8, 1024


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of the ASCII-lower-cased text, repeats included; of the whole sequence if it is shorter."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    k = min(words, len(parts))
    starts = [0, *ends[: len(parts) - k].tolist()]
    stops = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """Signed 64-bit number whose bits are those set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), block):
        part = np.ascontiguousarray(hashes[a : a + block]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(text: Column, words: int = WORDS) -> Column:
    def make(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(shingle_hashes(t, words)) for t in texts], dtype="int64")

    return F.pandas_udf(make, "bigint")(text)


def hamming(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def on_ring(x: Column, y: Column, distance: int, segments: int = SEGMENTS) -> Column:
    """Pigeonring condition: from some segment on, every chain of l segments differs in at most l/segments of ``distance``."""
    width = 64 // segments
    diff = x.bitwiseXOR(y)
    parts = F.array(*[F.bit_count(F.shiftrightunsigned(diff, width * k).bitwiseAND(F.lit((1 << width) - 1))) for k in range(segments)])
    twice = F.concat(parts, parts)

    def chain(start: Column) -> Column:
        sums = F.aggregate(
            F.slice(twice, start, segments),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("l"), F.lit(True).alias("ok")),
            lambda a, d: F.struct(
                (a["n"] + d).alias("n"), (a["l"] + 1).alias("l"), (a["ok"] & ((a["n"] + d) * segments <= (a["l"] + 1) * distance)).alias("ok")
            ),
        )
        return sums["ok"]

    return F.exists(F.sequence(F.lit(1), F.lit(segments)), chain)


def _turned(x: Column, bits: int) -> Column:
    return x if bits == 0 else F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def fingerprint_links(prints: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """``(a, b)``, b < a, that join all fingerprints within two bits into the right components.

    Pigeonring: fingerprints that close agree, from some segment on, in all segments whose budget is below one
    bit; each fingerprint gets a key for that chain at every turn of the ring. Those that share a key with
    another one survive. Survivors do not meet in pairs: two of them are close just if flipping one bit of
    each at most makes them equal, so each is linked to the least one at every such meeting point, with
    its flips limited to the segments outside the chain. The chain budgets and the full distance are checked last.
    """
    width, distance = 64 // segments, DISTANCE
    prefix = (-(-segments // distance) - 1) * width
    turns = F.array(
        *[
            F.struct(F.lit(k).alias("r"), F.shiftrightunsigned(_turned(F.col("fp"), width * k), 64 - prefix).alias("key"))
            for k in range(segments)
        ]
    )
    keys = prints.select("fp", F.inline(turns))
    shared = keys.groupBy("r", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("r", "key")
    # Bits outside the chain of turn r: of the number turned left by r segments, the low ones.
    masks = [((1 << 64 - prefix) - 1) for _ in range(segments)]
    masks = [((m >> width * k) | (m << (64 - width * k))) & ((1 << 64) - 1) for k, m in enumerate(masks)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    outside = F.get(F.array(*[F.lit(m).cast("long") for m in masks]), F.col("r"))
    survivors = cut(keys.join(shared, ["r", "key"]).groupBy("fp").agg(F.bit_or(outside).alias("free")))
    flips = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftright", F.col("free"), k).bitwiseAND(F.lit(1).cast("long")) == 1)
    points = F.concat(F.array("fp"), F.transform(flips, lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    met = survivors.select("fp", F.explode(points).alias("point"))
    hub = met.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("point", "b")
    # Both sides are many times what Spark expects after the explode: never a broadcast.
    pairs = met.join(hub.hint("merge"), "point").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.where(on_ring(F.col("a"), F.col("b"), distance, segments)).where(hamming(F.col("a"), F.col("b")) <= distance)


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    NULL, empty and wordless texts have fingerprint zero and link like any other. component_id is the least
    doc_id reachable over links of at most two bits; NULL ids count only if there is no other. Equal
    fingerprints are one node, so groups of copies never meet pair by pair. Repeated rows stay.
    """
    made = cut(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), words).alias("fp")))
    prints = cut(made.groupBy("fp").agg(F.min("doc_id").alias("first")))
    member = components(fingerprint_links(prints.select("fp")))
    least = prints.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = least.groupBy("component").agg(F.min("first").alias("component_id"))
    known = least.select("fp", "component").join(ids, "component").select("fp", "component_id")
    return made.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _sketch(texts: pd.Series, words: int, sketches: int) -> pd.DataFrame:
    rows = []
    factors = np.random.default_rng(SEED).integers(1, 1 << 63, sketches, dtype=np.uint64) | np.uint64(1)
    for t in texts:
        hashes = shingle_hashes(t, words)
        kinds = np.unique(hashes)
        same = xxhash.xxh3_128_hexdigest(b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split()))
        bits = fingerprint(shingle_hashes(t, WORDS))
        sample: list[int] = []
        at_once = max(1, (1 << 16) // max(1, len(kinds)))
        for k in range(0, sketches if len(kinds) else 0, at_once):
            mixed = kinds[None, :] * factors[k : k + at_once, None]
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            sample += kinds[mixed.argmin(1)].view(np.int64).tolist()
        rows.append((len(kinds), same, bits, sample))
    return pd.DataFrame(rows, columns=["kinds", "same", "fp", "sketch"])


def jaccard(a: str, b: str, words: int = NEAR_WORDS) -> float:
    x, y = np.unique(shingle_hashes(a, words)), np.unique(shingle_hashes(b, words))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _lone(each: DataFrame, value: str) -> DataFrame:
    """``id, lone``: how many of its values (``id`` and the column ``value``, a row for each) no other id has."""
    alone = each.groupBy(value).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    return alone.groupBy("id").agg(F.count("*").alias("lone"))


def _close(sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``sets`` (``id, kinds, hs`` and more) that others share enough shingles with.

    A text that is similar to another one shares with it ``similarity`` of its own shingles at least. So the others are
    similar to none, whatever the size of the groups they are in.
    """
    lone = _lone(sets.select("id", F.explode("hs").alias("h")), "h")
    enough = F.col("kinds") - F.coalesce("lone", F.lit(0)) >= similarity * F.col("kinds") - 1e-6
    return sets.join(sets.select("id", "kinds").join(lone, "id", "left").where(enough).select("id"), "id", "left_semi")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, alike`` of pairs ``a, b``: the Jaccard similarity of their shingle sets."""
    sides = [sets.select(F.col("id").alias(side), F.col("hs").alias(f"h{side}")) for side in ("a", "b")]
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", (both / (F.size("ha") + F.size("hb") - both)).alias("alike"))


def near_links(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(a, b)``: links that join the similar texts of ``sets`` (``id, kinds, hs, sketch``) into the right components.

    Texts meet in groups that share a sample. In groups of more than ``SMALL`` all members are compared with a pivot.
    Those that are similar to it are linked, and leave if no similar text can stay behind: 1 less the similarity is a
    metric, so a text that is a step nearer to the pivot than all that are not similar to it is similar to none of
    these. Where half of a group and more has left, the rest goes on with another pivot. Otherwise, and in small groups,
    members are compared with each other, but for those that links join already: a pair in the first group that it
    shares, if it shares ``SHARED`` samples. Each group loses no link by itself. A pair's group may be left by one
    of them only where they are not similar.
    """
    live, step = sets.select("id", F.posexplode("sketch").alias("j", "s")), 1 - similarity
    links, rest = [], []
    while True:
        order = F.struct(F.xxhash64("id", "j"), "id")
        sizes = live.groupBy("j", "s").agg(F.count("*").alias("n"), F.min_by("id", order).alias("pivot")).where("n > 1")
        shared = cut(live.join(sizes.hint("merge"), ["j", "s"]))
        rest.append(shared.where(F.col("n") <= SMALL).select("j", "s", "n", "id"))
        large = shared.where((F.col("n") > SMALL) & (F.col("id") != F.col("pivot"))).withColumnsRenamed({"id": "a", "pivot": "b"})
        if not large.limit(1).count():
            break
        found = cut(_alike(large.select("a", "b").distinct(), sets))
        links.append(found.where(F.col("alike") >= similarity).select("a", "b"))
        met = cut(large.join(found, ["a", "b"]))
        other = met.where(F.col("alike") < similarity).groupBy("j", "s").agg(F.max("alike").alias("other"))
        stays = met.join(other, ["j", "s"]).where((F.col("alike") < similarity) | (F.col("alike") <= F.col("other") + step + 1e-9))
        stays = stays.select("j", "s", "n", F.col("a").alias("id"))
        stays = cut(stays.join(stays.groupBy("j", "s").agg(F.count("*").alias("left")), ["j", "s"]))
        slow = F.col("left") * 2 > F.col("n")
        rest.append(stays.where(slow).select("j", "s", F.col("left").alias("n"), "id"))
        live = stays.where(~slow).select("id", "j", "s")
    known = reduce(DataFrame.union, links) if links else None
    texts = sets.select("id", "kinds", "sketch")
    if known is None:
        texts = texts.withColumn("of", F.col("id"))
    else:
        texts = texts.join(components(known).withColumnRenamed("node", "id"), "id", "left").withColumn("of", F.coalesce("component", "id"))
    members = cut(reduce(DataFrame.union, rest).join(texts.select("id", "kinds", "sketch", "of"), "id"))
    # The rows of a large group lie in several parts, which each meet all of it.
    parts = F.ceil(F.col("n") / PART).cast("int")
    x = members.select("j", "s", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), *[F.col(c).alias(f"{c}_a") for c in ("id", "kinds", "sketch", "of")])
    y = members.select("j", "s", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *[F.col(c).alias(f"{c}_b") for c in ("id", "kinds", "sketch", "of")])
    equal = F.zip_with("sketch_a", "sketch_b", lambda p, q: p == q)
    # No two sets are more similar than their sizes.
    sized = F.least("kinds_a", "kinds_b") >= similarity * F.greatest("kinds_a", "kinds_b") - 1e-6
    first = (F.array_position(equal, F.lit(True)) == F.col("j") + 1) & (F.size(F.filter(equal, lambda e: e)) >= SHARED)
    pairs = x.join(y, ["j", "s", "part"]).where((F.col("id_b") < F.col("id_a")) & (F.col("of_a") != F.col("of_b")) & sized & first)
    pairs = cut(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    more = cut(_alike(pairs, sets).where(F.col("alike") >= similarity).select("a", "b"))
    return more if known is None else known.union(more)


def _print_links(classes: DataFrame) -> DataFrame:
    """``(a, b)``: ids of ``classes`` (``id, fp``) that join all whose fingerprints are linked (``fingerprint_links``)."""
    prints = cut(classes.groupBy("fp").agg(F.min("id").alias("first")))
    equal = classes.join(prints, "fp").where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    links = fingerprint_links(prints.select("fp"))
    for side in ("a", "b"):
        links = links.join(prints.select(F.col("fp").alias(side), F.col("first").alias(f"id_{side}")), side)
    return cut(equal.union(links.select("id_a", "id_b")))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = NEAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, row_key, component_id`` of every different (id, text): groups of near copies.

    Texts are linked if their fingerprints differ in at most two bits, found by the pigeonring as in ``near_groups``.
    A similarity of 0.8 can leave two fingerprints some ten bits apart, at times over twenty: too far for keys on
    the ring. So texts with a similarity of 0.8 or more are linked as well. Candidates share ``SHARED`` of
    ``SKETCHES`` min-wise samples of the shingles with other texts (at 0.8 fewer are shared once in 10⁹ pairs), and 0.8
    of the shingles themselves (``_close``); the shingle sets of the whole texts decide (``near_links``). Texts with the
    same words are one node. Wordless texts are one group. Rows with a NULL id are no copies.
    """
    def sketch(texts: pd.Series) -> pd.DataFrame:
        made = _sketch(texts, words, SKETCHES)
        give_back()
        return made

    def kinds(texts: pd.Series) -> pd.Series:
        made = pd.Series([np.unique(shingle_hashes(t, words)).view(np.int64) for t in texts], dtype=object)
        give_back()
        return made

    sketched = F.pandas_udf(sketch, "kinds bigint, same string, fp bigint, sketch array<bigint>")(F.col(text))
    made = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), sketched.alias("s"))
    made = cut(made.select("doc_id", "row_key", "s.*"))
    classes = cut(made.groupBy("same", "kinds", "fp", "sketch").agg(F.min("doc_id").alias("id"), F.min_by("row_key", "doc_id").alias("key")).where("id IS NOT NULL"))

    # Texts by their row key: one id may have several texts.
    texts = classes.where("kinds > 0").select(F.col("key").alias("id"), "kinds", "sketch")
    each = texts.select("id", F.explode(F.transform("sketch", lambda s, j: F.xxhash64(j, s))).alias("g"))
    few = _lone(each, "g").where(F.col("lone") > SKETCHES - SHARED)
    wanted = cut(texts.join(few, "id", "left_anti"))
    # Only texts whose bit is set move to the exact join.
    bits = bit_filter(wanted.select("id"), "id")
    rows = docs.select(row_key(doc_id, text).alias("id"), F.col(text).alias("text")).where(in_filter(bits, F.col("id")))
    rows = rows.join(wanted.hint("merge"), "id").dropDuplicates(["id"])
    sets = cut(rows.select("id", "kinds", "sketch", F.pandas_udf(kinds, "array<bigint>")("text").alias("hs")))
    for _ in range(2):
        sets = cut(_close(sets, similarity))
    links = near_links(sets, similarity)
    for side in ("a", "b"):
        links = links.join(classes.select(F.col("key").alias(side), F.col("id").alias(f"id_{side}")), side)
    links = cut(links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    member = components(links.union(_print_links(classes))).withColumnRenamed("node", "id")
    known = classes.join(member, "id", "left").select("same", F.coalesce("component", "id").alias("component_id"))
    return made.join(known, "same", "left").select("doc_id", "row_key", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group of ``near_copies``: that with the least doc_id. Rows with a NULL id are no copies and stay.

    Repeated rows count as copies; of several texts with the least id one stays. Only texts that go or are repeated
    move, and those that share their bit in a filter of fixed size.
    """
    with passing_cuts() as keep:
        rows = near_copies(docs, doc_id, text, **options).groupBy("doc_id", "row_key").agg(F.count("*").alias("n"), F.min("component_id").alias("component_id"))
        rows = rows.withColumn("first", F.expr("doc_id IS NULL OR component_id IS NULL OR doc_id = component_id"))
        # Of several texts with one id the first by key stays; for NULL ids each text.
        own = rows.where("first AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("row_key").alias("own"))
        rows = rows.join(own, "doc_id", "left").withColumn("stays", F.expr("first AND (doc_id IS NULL OR row_key = own)"))
        marked = rows.where("NOT stays OR n > 1").select(F.col("doc_id").alias("d2"), F.col("row_key").alias("k2"), "stays")
        marked = keep(cut(marked))
    bits = bit_filter(marked.select(F.xxhash64("d2", "k2").alias("h")), "h")
    each = packed(docs, doc_id, text).withColumn("maybe", in_filter(bits, F.xxhash64("d", "k")))
    once = each.where("maybe").join(marked, same_row(), "left").where("coalesce(stays, true)").dropDuplicates(["d", "k"])
    return each.where("NOT maybe").select("row").union(once.select("row")).select("row.*")
