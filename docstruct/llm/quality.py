"""Quality rules: counts of whole texts, and a calibrated logistic regression on hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed features of words and of characters; rows of each class that the model learns from at most.
WORD_SIZE, CHAR_SIZE, SAMPLE = 2048, 2048, 1500
#: A text is kept if its calibrated probability of good quality is at least this.
THRESHOLD = 0.2
STEPS, RIDGE = 300, 1e-4
_SYMBOLS = "#*$%&|<>"
_COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def _rank(*columns: np.ndarray) -> np.ndarray:
    """Numbers equal pairs alike, exactly."""
    a, b = columns
    return np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)[1]


def repeated_words(ids: np.ndarray, window: int = 5) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key = ids[:n]
    for k in range(1, window):
        key = _rank(key, ids[k : k + n])
    often = np.bincount(key)[key] > 1
    if not often.any():
        return 0
    mark = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + window, -1)
    return int((np.cumsum(mark) > 0).sum())


def count_text(text: str | None) -> tuple[int, int, int, int, int]:
    """Words ``[^\\x20\\x09-\\x0D]+``, their code points, symbols, repeated lines, words in repeated windows of five."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    blanks = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = repeated_words(ids) if len(words) >= 6 else 0
    return len(words), len(text) - blanks, sum(text.count(c) for c in _SYMBOLS), len(lines) - len(set(lines)), repeats


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text: places and values, each of the two blocks of unit length.

    Word unigrams and bigrams and character trigrams of the text as it stands, case and marks included.
    """
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    one = np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.uint64, len(words))
    two = (one[:-1] * np.uint64(0x9E3779B1) + one[1:]) if len(one) > 1 else one[:0]
    word = np.concatenate([one % np.uint64(WORD_SIZE), (two >> np.uint64(7)) % np.uint64(WORD_SIZE)]).astype(np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) > 2:
        mixed = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ codes[2:] * np.uint64(0x165667B19E3779F9)
        char = (mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(50)).astype(np.int64) % CHAR_SIZE
    else:
        char = np.zeros(0, np.int64)
    at, value = [], []
    for places, size, first in ((word, WORD_SIZE, 0), (char, CHAR_SIZE, WORD_SIZE)):
        n = np.bincount(places, minlength=size)
        some = np.flatnonzero(n)
        x = np.sqrt(n[some])
        at.append(some + first)
        value.append(x / max(np.linalg.norm(x), 1e-9))
    return np.concatenate(at).astype(np.int32), np.concatenate(value).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray) -> dict:
    """Weights by gradient descent on two thirds of the rows, then Platt scaling on the rest."""
    size = WORD_SIZE + CHAR_SIZE
    if not len(rows) or good.min() == good.max():
        return {"w": np.zeros(size), "a": 0.0, "b": 4.0 if not len(rows) or good.max() else -4.0}
    x = np.zeros((len(rows), size), np.float32)
    for k, (at, value) in enumerate(rows):
        x[k, at] = value
    y = good.astype(np.float32)
    held = np.arange(len(rows)) % 3 == 2
    learn = ~held if len(set(y[held])) == 2 and len(set(y[~held])) == 2 else np.ones(len(rows), bool)
    check = held if learn is not held and not learn.all() else learn
    weight = np.where(y[learn] > 0, 0.5 / max(1, (y[learn] > 0).sum()), 0.5 / max(1, (y[learn] == 0).sum())).astype(np.float32)
    w, b, speed, speed_b, xl = np.zeros(size, np.float32), 0.0, np.zeros(size, np.float32), 0.0, x[learn]
    for _ in range(STEPS):
        error = (1 / (1 + np.exp(-(xl @ w + b))) - y[learn]) * weight
        speed = 0.9 * speed - 8.0 * (xl.T @ error + RIDGE * w)
        speed_b = 0.9 * speed_b - 8.0 * float(error.sum())
        w, b = w + speed, b + speed_b
    score, target = x[check] @ w + b, y[check]
    n1, n0 = target.sum(), len(target) - target.sum()
    soft = np.where(target > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, shift = 1.0, 0.0
    for _ in range(100):  # Newton's method on the two parameters
        p = 1 / (1 + np.exp(-np.clip(slope * score + shift, -40, 40)))
        g = np.array([((p - soft) * score).sum(), (p - soft).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * score * score).sum() + 1e-6, (v * score).sum()], [(v * score).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return {"w": w.astype(np.float64), "a": float(slope), "b": float(slope * b + shift)}


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", sample: int = SAMPLE) -> dict:
    """Fits the model on at most ``sample`` labelled rows of each class, those with the least hash of their id.

    Bounds what reaches the one task that fits: ``2 * sample`` rows of hashed features. Rows with a NULL id,
    text or label teach nothing; an id with several labels counts as its lowest one.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(quality).alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    by_hash = F.xxhash64("doc_id")
    chosen = [known.where(c).orderBy(by_hash, "doc_id").limit(sample) for c in (F.col("quality") > 0, F.col("quality") <= 0)]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    picked = rows.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").select("doc_id", "quality", "text")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [text_features(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "at": [a for a, _ in made], "value": [v for _, v in made]})

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "quality"])
        made = fit(list(zip(group["at"], group["value"])), group["quality"].to_numpy() > 0)
        return pd.DataFrame({"w": [made["w"].tolist()], "a": [made["a"]], "b": [made["b"]]})

    kept = picked.mapInPandas(features, "doc_id bigint, quality int, at array<int>, value array<float>")
    found = kept.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(learn, "w array<double>, a double, b double").first()
    if found is None:
        return fit([], np.zeros(0))
    return {"w": np.array(found["w"]), "a": found["a"], "b": found["b"]}


def scorer(model: dict):
    """Pandas UDF: text to its counts and its calibrated probability of good quality."""
    w, a, b = np.asarray(model["w"]), model["a"], model["b"]

    @F.pandas_udf(f"{_COUNTS}, p double")
    def score(texts: pd.Series) -> pd.DataFrame:
        counts, p = [], []
        for text in texts:
            counts.append(count_text(text))
            at, value = text_features(text)
            p.append(1 / (1 + np.exp(-np.clip(a * float(value @ w[at]) + b, -40, 40))))
        frame = pd.DataFrame(counts, columns=[c.split()[0] for c in _COUNTS.split(", ")], dtype="int64")
        return frame.assign(p=np.array(p, float))

    return score


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])


def quality_rules(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``p`` and ``kept`` of every row.

    NULL and empty texts have no words and fail the base rule. Repeated rows are judged alike; other columns
    are left out. Without labels of both classes the model agrees with what it has seen (all good without any).
    """
    found = docs.select(F.col(doc_id).alias("doc_id"), scorer(model)(F.col(text)).alias("c"))
    failed = base_failed(F.col("c"))
    return found.select("doc_id", "c.*", failed.alias("base_failed"), (~failed & (F.col("c.p") >= threshold)).alias("kept"))
