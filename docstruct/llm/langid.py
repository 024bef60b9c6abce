"""Language identification with hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of the vectors and letters of an n-gram; documents that are compared at once.
DIMENSIONS, ORDER, BLOCK, SEED = 1024, 3, 128, 20240
#: N-grams that are counted at once, and distinct ones whose vectors are held at once; sums over slices are those of the whole.
PLACES, GRAMS = 1 << 19, 4096
#: Language values the model may have; more would be a sign that the column holds no languages.
MOST_LANGUAGES = 4096
UNKNOWN = "und"
_SPACE = 32


@lru_cache(maxsize=100_000)
def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Random vector of +1 and -1 of a letter, the same in every process."""
    return np.random.default_rng((SEED, code)).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Vectors of n-grams: the letters' vectors, each turned by its place, multiplied."""
    letters, place = np.unique(grams, return_inverse=True)
    table = np.stack([letter_vector(int(c), dimensions) for c in letters])
    place = place.reshape(grams.shape)
    out = None
    for k in range(grams.shape[1]):
        turned = np.roll(table, grams.shape[1] - 1 - k, axis=1)[place[:, k]]
        out = turned if out is None else out * turned
    return out


@lru_cache(maxsize=200_000)
def _is_letter(code: int) -> bool:
    return chr(code).isalpha()


def letters_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, each run of other characters one space, and the row of each."""
    parts, rows = [], []
    for k, text in enumerate(texts):
        codes = np.frombuffer(("\n" + (text or "").lower() + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        parts.append(codes)
        rows.append(np.full(len(codes), k, np.int32))
    codes, row = np.concatenate(parts), np.concatenate(rows)
    known = np.zeros(0x110000, bool)
    known[codes] = True
    kinds = np.flatnonzero(known)
    known[kinds] = [_is_letter(int(c)) for c in kinds]
    letter = known[codes]
    keep = letter | np.concatenate([[True], letter[:-1] | (row[1:] != row[:-1])])
    codes = np.where(letter, codes, _SPACE)
    return codes[keep], row[keep]


def gram_counts(texts: list[str | None], order: int = ORDER, places: int = PLACES, most: int = GRAMS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams of the texts (code points) and a matrix of their counts, a row per text, in slices.

    A slice has at most ``most`` distinct n-grams of ``places`` places in the texts, so that memory beside the texts
    does not grow with the alphabet; an n-gram may be in several slices.
    """
    codes, row = letters_of(texts)
    for at in range(0, max(0, len(codes) - order + 1), places):
        c, r = codes[at : at + places + order - 1], row[at : at + places + order - 1]
        alphabet, small = np.unique(c, return_inverse=True)
        size, n = len(alphabet), len(c) - order + 1
        key, bare = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(order):
            key = key * size + small[k : k + n]
            bare &= c[k : k + n] == _SPACE
        within = (r[:n] == r[order - 1 :]) & ~bare
        key, r = key[within], r[:n][within]
        if size**order <= 1 << 22:
            seen = np.flatnonzero(np.bincount(key, minlength=1) > 0)
            number = np.zeros(size**order, np.int64)
            number[seen] = np.arange(len(seen))
            number = number[key]
        else:
            seen, number = np.unique(key, return_inverse=True)
        if len(seen) > most:
            by_number = np.argsort(number, kind="stable")
            number, r = number[by_number], r[by_number]
        for low in range(0, len(seen), most):
            part = seen[low : low + most]
            grams = np.stack([alphabet[part // size ** (order - 1 - k) % size] for k in range(order)], 1)
            mine = slice(*np.searchsorted(number, [low, low + most])) if len(seen) > most else slice(None)
            counts = np.bincount(r[mine].astype(np.int64) * len(part) + number[mine] - low, minlength=len(texts) * len(part))
            yield grams, counts.reshape(len(texts), -1).astype(np.float32)


def _blocks(texts: pd.Series, size: int = BLOCK, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` texts and about ``most`` characters; a longer text stands alone."""
    start = chars = 0
    for k, text in enumerate(texts):
        n = len(text) if text else 0
        if k > start and (k - start >= size or chars + n > most):
            yield start, k
            start, chars = k, 0
        chars += n
    if start < len(texts):
        yield start, len(texts)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototype of each language: the bundle of the n-gram vectors of all its documents.

    N-grams are counted per language on all rows with partial sums, then bundled per task; a vector per language
    is what reaches the driver. Rows with a NULL text or language teach nothing.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, int] = {}
        for batch in batches:
            for name, group in batch.groupby("lang"):
                for a, b in _blocks(group["text"]):
                    for grams, counts in gram_counts(group["text"].iloc[a:b].tolist()):
                        for gram, n in zip(map(tuple, grams.tolist()), counts.sum(0, dtype=np.float64).astype(np.int64).tolist()):
                            total[name, gram] = total.get((name, gram), 0) + n
                        if len(total) > 400_000:
                            yield _counted(total)
                            total = {}
        if total:
            yield _counted(total)

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, group in batch.groupby("lang"):
                for a in range(0, len(group), 2048):
                    part = group.iloc[a : a + 2048]
                    v = gram_vectors(np.array(part["gram"].tolist(), np.int64), dimensions)
                    sums[name] = sums.get(name, 0) + part["n"].to_numpy(np.float64) @ v.astype(np.float64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [v.tolist() for v in sums.values()]})

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counted = rows.mapInPandas(count, "lang string, gram array<int>, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = counted.mapInPandas(bundle, "lang string, v array<double>")
    each = sums.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    made = each.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("v"))
    found = made.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of {lang}")
    return {r["lang"]: np.array(r["v"]) for r in sorted(found, key=lambda r: r["lang"])}


def _counted(total: dict) -> pd.DataFrame:
    return pd.DataFrame({"lang": [k[0] for k in total], "gram": [list(k[1]) for k in total], "n": list(total.values())})


def predictor(prototypes: dict[str, np.ndarray]):
    """Pandas UDF: text to ``(lang, score)``: the language of the nearest prototype by cosine, the first by name at a tie."""
    names = sorted(prototypes)
    dims = len(prototypes[names[0]]) if names else DIMENSIONS
    matrix = np.stack([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-9) for n in names]).astype(np.float32) if names else None

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        for a, b in _blocks(texts):
            if matrix is None:
                continue
            vectors, some = np.zeros((b - a, dims)), np.zeros(b - a, bool)
            for grams, counts in gram_counts(texts.iloc[a:b].tolist()):
                vectors += counts @ gram_vectors(grams, dims).astype(np.float32)
                some |= counts.any(1)
            if not some.any():
                continue
            length = np.linalg.norm(vectors, axis=1)
            cosine = vectors @ matrix.T / np.maximum(length, 1e-9)[:, None]
            langs[a:b][some] = np.array(names, object)[cosine.argmax(1)][some]
            scores[a:b][some] = np.clip(cosine.max(1), 0, 1)[some]
        return pd.DataFrame({"lang": langs, "score": scores})

    return predict


def held_out(doc_id: Column) -> Column:
    """The quarter of the ids that is never learned from; NULL ids are not held out (and not learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> Column:
    """Struct ``(lang, score)``. NULL, empty and letterless texts are ``und`` with score 0; so is all without a model."""
    return predictor(prototypes)(F.col(text))


def language_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, learned from the rows that are not held out.

    At a tie of cosines the first language by name is taken. Repeated rows stay, and teach as often as they stand there.
    Texts of any length and script are counted in slices of fixed size. NULL, empty and letterless texts are ``und`` with
    score 0, and so are all where nothing could be learned. More than ``MOST_LANGUAGES`` values of ``lang`` raise.
    """
    known = docs.where((F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4) != 2)
    made = train(known, text, lang)
    found = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), identify(docs, made, text).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
