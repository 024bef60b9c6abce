"""Best-fit packing: token sequences of fixed length, certified by lower bounds and repacked where there are gaps."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstruct.llm.common import cut

CAPACITY = 2048
#: Pieces that one task packs at a time, and the most rounds of exchange.
GROUP, ROUNDS = 8192, 12
SEPARATOR = 0


@lru_cache(maxsize=4)
def added_tokens(vocabulary: str) -> tuple[tuple[str, int], ...]:
    """The few added tokens of a vocabulary, from the definition beside its ranks; read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary.rsplit(".", 1)[0] + ".json"), encoding="utf-8") as f:
        return tuple((token["content"], token["id"]) for token in json.load(f)["added_tokens"])


@lru_cache(maxsize=4)
def _encoder(vocabulary: str, added: tuple[tuple[str, int], ...]):
    """The vocabulary's ranks, read in each Python worker, with its added tokens."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("docstruct", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(added))


def tokenize(text: str | None, vocabulary: str, added: tuple[tuple[str, int], ...] | None = None) -> np.ndarray:
    """Ids of a text and the separator. An added token that stands in the text is that token, as in ``tokenizers``."""
    added = added_tokens(vocabulary) if added is None else added
    ids = _encoder(vocabulary, added).encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids, np.uint32(SEPARATOR)).astype("<u4")


def cut_pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: whole if it fits, else full ones after a shorter first one."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document; NULL texts are empty: one token, the separator."""
    added = added_tokens(vocabulary)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, words in zip(batch["doc_id"], batch["text"]):
                ids = tokenize(words, vocabulary, added)
                for k, (start, length) in enumerate(cut_pieces(len(ids), capacity)):
                    rows.append((doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64", "piece": "int32", "start": "int64", "length": "int64", "ids_crc32": "int64"})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(encode, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the best of the total and of two families of dual-feasible functions.

    The step functions u_k(x) = floor((k + 1) x) / k (x itself where (k + 1) x is whole) for k up to 20, and the
    functions that count what is over capacity - t as a bin, what is under t as nothing.
    """
    if not len(lengths):
        return 0
    x = np.sort(lengths.astype(np.int64))
    best = -(-int(x.sum()) // capacity)
    for k in range(1, 21):
        whole = (k + 1) * x
        # Everything times k * capacity, so that the sums stay whole numbers.
        u = np.where(whole % capacity == 0, k * x, whole // capacity * capacity)
        best = max(best, -(-int(u.sum()) // (k * capacity)))
    sums = np.concatenate([[0], np.cumsum(x)])
    for t in np.unique(np.minimum(x, capacity - x)):
        if 0 < t <= capacity // 2:
            big = len(x) - np.searchsorted(x, capacity - t, "right")
            lo, hi = np.searchsorted(x, t, "left"), np.searchsorted(x, capacity - t, "right")
            best = max(best, int(big) + -(-int(sums[hi] - sums[lo]) // capacity))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing: the bin of each length, in the order given."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r is set if a bin with r free tokens is open
    bins, out = 0, np.zeros(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable"):
        n = int(lengths[k])
        fits = some >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                some &= ~(1 << free)
        else:
            b, free = bins, capacity
            bins += 1
        out[k] = b
        left = free - n
        if left:
            room[left].append(b)
            some |= 1 << left
    return out


def _pack(pieces: DataFrame, groups: int, seed: int, capacity: int) -> DataFrame:
    """Packs each of ``groups`` parts by best-fit decreasing: adds ``part, bin, offset, fill, bins, bound``."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "u"], ascending=[False, True], kind="stable")
        lengths = frame["length"].to_numpy()
        bins = best_fit(lengths, capacity)
        frame = frame.assign(bin=bins)
        by = frame.groupby("bin")["length"]
        return frame.assign(
            offset=by.cumsum() - lengths, fill=by.transform("sum"), bins=int(bins.max()) + 1, bound=lower_bound(lengths, capacity)
        )[["u", "length", "part", "bin", "offset", "fill", "bins", "bound"]]

    dealt = pieces.select("u", "length", F.pmod(F.xxhash64("u", F.lit(seed)), F.lit(groups)).alias("part"))
    kind = "u bigint, length bigint, part bigint, bin bigint, offset bigint, fill bigint, bins bigint, bound bigint"
    return dealt.groupBy("part").applyInPandas(pack, kind)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """``u, sequence_id, offset`` of pieces ``(u, length)``, ``u`` a different number for each.

    Pieces are dealt to parts of about ``group`` at random and each is packed by best-fit decreasing. A part whose
    bins meet its lower bound is certified: no packing of it has fewer. The bins with gaps of the others, and
    the emptiest bin of the certified ones, give their pieces to the next round, which deals them anew. Rounds
    end when one part holds all that is left, when a round saves nothing, or after ``rounds``. Full bins are final.
    """
    spark = pieces.sparkSession
    full = pieces.where(F.col("length") == capacity)
    done = [full.select("u", F.lit(0).alias("round"), F.lit(0).cast("long").alias("part"), F.col("u").alias("bin"), F.lit(0).cast("long").alias("offset"))]
    left, before = pieces.where(F.col("length") < capacity), None
    for k in range(1, rounds + 1):
        n = left.count()
        if not n:
            break
        groups = -(-n // group)
        packed = cut(_pack(left, groups, k, capacity))
        bins = packed.select("part", "bin", "fill", (F.col("bins") > F.col("bound")).alias("open")).distinct()
        worst = bins.groupBy("part").agg(F.min_by("bin", F.struct("fill", "bin")).alias("worst"))
        bins = bins.join(worst, "part")
        again = (F.col("fill") < capacity) & (F.col("open") | (F.col("bin") == F.col("worst")))
        last = groups == 1 or k == rounds
        bins = cut(bins.select("part", "bin", (again & F.lit(not last)).alias("again"), "fill"))
        used = bins.where("again").agg(F.count("*"), F.sum("fill")).first()
        # Even a perfect repacking saves no bin if the gaps do not add up to one.
        if used[0] and used[0] <= -(-used[1] // capacity):
            last = True
        # As Parquet these tables are much smaller than in memory: they are not to be broadcast for that.
        rows = packed.join(bins.select("part", "bin", "again").hint("merge"), ["part", "bin"])
        keep = rows if last else rows.where("NOT again")
        done.append(keep.select("u", F.lit(k).alias("round"), "part", "bin", "offset"))
        if last:
            break
        left = cut(rows.where("again").select("u", "length"))
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    # Full pieces have their own number, packed bins a negative one of round, part and bin.
    packed = -(F.col("round") * F.lit(1 << 56) + F.col("part") * F.lit(1 << 20) + F.col("bin") + 1)
    return placed.select("u", F.when(F.col("round") == 0, F.col("u")).otherwise(packed).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every row.

    Repeated rows are packed each for itself; NULL texts are empty documents of one token; an empty table
    gives no pieces. Only the lengths of pieces move between tasks.
    """
    pieces = cut(pieces_of(docs, doc_id, text, vocabulary, capacity).withColumn("u", F.monotonically_increasing_id()))
    placed = place_pieces(pieces.select("u", "length"), capacity)
    return pieces.join(placed.hint("merge"), "u").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
