"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (proximal, elastic-net) on a bounded sample, with
document frequencies over every training document, then calibrated by one temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_fraction, map_texts, stored, unstore, with_struct

BUCKETS = 1 << 16
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Weights already hold the inverse document frequencies' classes: one row per bucket."""

    labels: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets of the lower-cased text's 1- to 3-grams of characters, with counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return np.empty(0, dtype=np.int64), np.empty(0)
    h, found = codes * np.uint32(2654435761), []
    found.append(h >> np.uint32(16))
    for k in (1, 2):
        if len(codes) > k:
            h = (h[:-1] ^ np.uint32(k * 0x5BD1E995)) * np.uint32(0x01000193) + codes[k:] * np.uint32(2246822519)
            found.append((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16))
    counts = np.bincount(np.concatenate(found), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(np.float64)


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and L2-normalised (1 + ln tf) * idf values."""
    at, tf = ngram_counts(text)
    x = (1.0 + np.log(tf)) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


def document_frequencies(train: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and of texts per n-gram bucket, over all rows: each task sends one
    fixed-size table of counts at most."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for frame in frames:
            for text in frame["text"]:
                total[ngram_counts(text)[0]] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(total[at], n)})

    rows = map_texts(train.select("text"), "text", count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS)
    seen = rows[rows["bucket"] >= 0]
    df[seen["bucket"].to_numpy(dtype=np.int64)] = seen["n"]
    return int(rows.loc[rows["bucket"] < 0, "n"].sum()), df


def _ftrl(frame: pd.DataFrame, labels: tuple[str, ...], idf: np.ndarray, epochs: int, alpha: float, beta: float, l1: float, l2: float):
    """Per-coordinate FTRL-proximal over the examples; the last state's weights and bias."""
    k, place = len(labels), {x: i for i, x in enumerate(labels)}
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(at):
        shrunk = np.sign(z[at]) * l1 - z[at]
        return np.where(np.abs(z[at]) <= l1, 0.0, shrunk / ((beta + np.sqrt(n[at])) / alpha + l2))

    examples = [(*features(t, idf), place[y]) for t, y in zip(frame["text"], frame["lang"], strict=True)]
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(examples)):
            at, x, y = examples[i]
            at, x = np.append(at, BUCKETS), np.append(x, 0.1)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], w[-1] * 0.1


def _logits(text: str, model: LanguageModel) -> np.ndarray:
    at, x = features(text, model.idf)
    return x @ model.weights[at] + model.bias


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least cross entropy, by golden-section search on its logarithm."""

    def loss(log_t):
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean())

    low, high, g = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train_language_model(train: DataFrame, max_docs: int = 6000, max_chars: int = 40_000_000, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> LanguageModel | None:
    """Fit on train (doc_id, text, lang). Document frequencies cover every row with a letter.

    The classifier itself is fitted on a hash sample of about max_docs rows and max_chars
    characters (whole texts; never over twice as many rows, those of least hash), four fifths for
    FTRL and one fifth for the temperature; it knows every language of that sample. None if no row
    has a text with a letter and a language.
    """
    usable = train.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    total, df = document_frequencies(usable)
    if not total:
        return None
    idf = np.where(df > 0, np.log((1.0 + total) / (1.0 + df)) + 1.0, 0.0)
    sizes = usable.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).first()
    some = hash_fraction(usable, ["doc_id", "text"], min(1.0, max_docs / sizes["n"], max_chars / max(1, sizes["c"])), "langid")
    sample = stored(some.orderBy(F.xxhash64(F.lit("langid"), "doc_id", "text"), "lang").limit(2 * max_docs).select("text", "lang"))
    labels = tuple(sorted(r["lang"] for r in sample.select("lang").distinct().collect()))

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"text": [], "lang": []}, dtype=object), *frames]).sort_values(["text", "lang"], ignore_index=True)
        if not len(rows):
            return
        order = np.random.default_rng(7).permutation(len(rows))
        cut = order[: max(1, len(rows) // 5)]
        keep = order[len(cut) :] if len(rows) >= 10 else order
        w, b = _ftrl(rows.iloc[keep], labels, idf, epochs, alpha, beta, l1, l2)
        model = LanguageModel(labels, idf, w, b)
        held = rows.iloc[cut]
        logits = np.array([_logits(t, model) for t in held["text"]])
        t = _temperature(logits, np.array([labels.index(y) for y in held["lang"]]))
        at = np.flatnonzero(np.any(w != 0, axis=1))
        yield pd.DataFrame({"at": [at.astype(np.int32).tobytes()], "w": [w[at].astype(np.float32).tobytes()], "b": [b.tobytes()], "t": [t]})

    fitted = sample.repartition(1).mapInPandas(fit, "at binary, w binary, b binary, t double").collect()
    unstore(sample)
    if not fitted:
        return None
    w = np.zeros((BUCKETS, len(labels)), dtype=np.float32)
    w[np.frombuffer(fitted[0]["at"], dtype=np.int32)] = np.frombuffer(fitted[0]["w"], dtype=np.float32).reshape(-1, len(labels))
    return LanguageModel(labels, idf.astype(np.float32), w, np.frombuffer(fitted[0]["b"]), fitted[0]["t"])


def identify_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Add lang_pred and score (calibrated probability of lang_pred) to docs (text, ...).

    A null text, one without a letter, or a missing model gives `und` with score 0. Every
    other column is carried; columns named lang_pred or score are replaced.
    """

    def predict(texts: list) -> list[tuple[str, float]]:
        out = []
        for text in texts:
            if model is None or text is None or not LETTER.search(text):
                out.append((UNKNOWN, 0.0))
                continue
            s = _logits(text, model) / model.temperature
            p = np.exp(s - s.max())
            out.append((model.labels[int(s.argmax())], float(1.0 / p.sum())))
        return out

    return with_struct(docs, "text", lambda: predict, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
