"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

Sentence scores are logistic in the sentence's words; noisy-or combines them, so document
labels alone train them, and the sentences that carry a document's score can be located.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, hash_fraction, with_struct, word_bytes

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"[^\W_]+")


PREFIXES = (4, 5, 6, 7)


class ToxicityModel:
    """Weight per feature (a word, or a word's start of 4 to 7 letters followed by *), and the
    log-odds of a sentence that has none of them."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self._cache: dict[str, float] = {}
        self._bytes = 0

    def word(self, w: str) -> float:
        """Sum of a word's feature weights; sums are kept within WORD_BYTES and only in a task."""
        found = self._cache.get(w)
        if found is None:
            self._bytes += word_bytes(w, b"")
            if self._bytes > WORD_BYTES:
                self._cache.clear()
                self._bytes = word_bytes(w, b"")
            found = self._cache[w] = sum(self.weights.get(f, 0.0) for f in word_features(w))
        return found

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_cache": {}, "_bytes": 0}


def word_features(w: str) -> list[str]:
    return [w, *(w[:k] + "*" for k in PREFIXES if len(w) >= k)]


def sentences(text: str) -> list[re.Match]:
    return list(SENTENCE.finditer(text))


def sentence_score(sentence: str, model: ToxicityModel) -> float:
    """Log-odds of one sentence; each distinct word counts once."""
    return model.bias + sum(map(model.word, set(WORD.findall(sentence.lower()))))


def document_score(text: str | None, model: ToxicityModel) -> float:
    """Noisy-or of the sentences: 1 - prod(1 - sigmoid(s)); no sentence gives 0."""
    if not text:
        return 0.0
    clean, total = 0, 0.0
    for sentence in SENTENCE.findall(text.lower()):
        found = sum(map(model.word, set(WORD.findall(sentence))))
        if found:
            total += np.logaddexp(0.0, model.bias + found)
        else:
            clean += 1
    return float(-np.expm1(-(total + clean * np.logaddexp(0.0, model.bias))))


def _numbered(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts, and as numbers: the distinct words of each sentence, one sentence after
    the other, the sentence that each of these is in, and the text of each sentence. A word is held
    once, its occurrences take eight bytes."""
    number: dict[str, int] = {}
    flat, sentence_of, text_of = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for s in SENTENCE.findall(text.lower()):
            found = sorted({number.setdefault(w, len(number)) for w in WORD.findall(s)})
            flat.extend(found)
            sentence_of.extend([len(text_of)] * len(found))
            text_of.append(d)
    return list(number), *(np.frombuffer(x, dtype=np.int32) if x else np.zeros(0, dtype=np.int32) for x in (flat, sentence_of, text_of))


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorts keys in place; the distinct ones."""
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _screen(words: list[str], word: np.ndarray, text: np.ndarray, y: np.ndarray, min_docs: int, lift: float) -> list[str]:
    """Features in at least min_docs texts whose odds of a toxic label are lift times the overall
    ones; unlike a share, odds can reach that at every base rate. flat and text: numbers of words
    and the texts that they are in."""
    toxic, clean, names = int(y.sum()), len(y) - int(y.sum()), []
    for k in (None, *PREFIXES):
        place: dict[str, int] = {}
        of = np.array([-1 if k and len(w) < k else place.setdefault(w[:k] + "*" if k else w, len(place)) for w in words], dtype=np.int64)
        long_enough = of[word] >= 0
        pairs = _distinct(of[word[long_enough]] * len(y) + text[long_enough])
        n = np.bincount(pairs // len(y), minlength=len(place))
        hit = np.bincount(pairs // len(y), y[pairs % len(y)], len(place)).astype(np.int64)
        chosen = (n >= min_docs) & (hit * clean >= lift * (n - hit) * toxic)
        names += [f for f, good in zip(place, chosen, strict=True) if good]
    return sorted(names)


def _fit(texts: list[str], y: np.ndarray, min_docs: int, lift: float, steps: int, rate: float, l1: float) -> tuple[dict[str, float], float]:
    """Maximum likelihood of the noisy-or by AdaGrad over all documents, with weights of at
    least 0 (no word makes a sentence less toxic) and an L1 penalty."""
    words, flat, sentence_of, text_of = _numbered(texts)
    pairs = text_of[sentence_of].astype(np.int64)
    pairs *= max(1, len(words))
    pairs += flat
    pairs = _distinct(pairs)
    names = _screen(words, pairs % max(1, len(words)), pairs // max(1, len(words)), y, min_docs, lift)
    del pairs
    place = {f: i for i, f in enumerate(names)}
    known = [[place[f] for f in word_features(w) if f in place] for w in words]
    n_known = np.array([len(at) for at in known], dtype=np.int64)
    start = np.cumsum(n_known) - n_known
    listed = np.array([i for at in known for i in at], dtype=np.int64)
    kept = n_known[flat] > 0 if len(flat) else np.zeros(0, dtype=bool)
    times = n_known[flat[kept]]
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    col = listed[np.repeat(start[flat[kept]], times) + step]
    marked, row = np.unique(np.repeat(sentence_of[kept], times), return_inverse=True)
    doc_of = text_of[marked].astype(np.int64)
    clean = (np.bincount(text_of, minlength=len(texts)) - np.bincount(doc_of, minlength=len(texts))).astype(np.float64)
    # Sentences without a known feature are alike: their number per document is enough.
    w, b, gw, gb = np.zeros(len(names)), -5.0, np.full(len(names), 1e-8), 1e-8
    for _ in range(steps):
        s = b + np.bincount(row, w[col], len(doc_of))
        lost = np.bincount(doc_of, np.logaddexp(0.0, s), len(texts)) + clean * np.logaddexp(0.0, b)
        p = -np.expm1(-lost)
        pull = np.where(y > 0, np.exp(-lost) / np.maximum(p, 1e-9), -1.0)
        g = -pull[doc_of] / (1.0 + np.exp(-s)) / len(texts)
        dw, db = np.bincount(col, g[row], len(names)), g.sum() - (pull * clean).sum() / (1.0 + np.exp(-b)) / len(texts)
        gw += dw * dw
        gb += db * db
        w = np.maximum(w - rate * (dw + l1) / np.sqrt(gw), 0.0)
        b -= rate * db / np.sqrt(gb)
    return {n: float(x) for n, x in zip(names, w, strict=True) if x}, float(b)


def train_toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = 8000, max_chars: int = 30_000_000, min_docs: int = 5, lift: float = 3.0, steps: int = 500, rate: float = 0.3, l1: float = 1e-5) -> ToxicityModel:
    """Fit on docs (doc_id, text) with labels (doc_id, toxic 0/1): whole texts of a hash sample of
    about max_docs labels and max_chars characters. The sampled labels, bounded by max_docs, are
    broadcast, so that no text moves but theirs. Rows with a null or empty text or a null label
    take no part. Without a row of each label no sentence scores above the prior."""
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic is not null")
    n, size = marked.count(), docs.agg(F.avg(F.length("text"))).first()[0]
    if not n or not size:
        return ToxicityModel({}, -20.0)
    # Labels and texts may repeat ids; the limits bound them then too.
    some = hash_fraction(marked, "doc_id", min(1.0, max_docs / n, max_chars / (n * size)), "toxicity").limit(2 * max_docs)
    sample = docs.select("doc_id", "text").where("length(text) > 0").join(F.broadcast(some), "doc_id").select("text", "toxic").limit(4 * max_docs)

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"text": [], "toxic": []}, dtype=object), *frames]).sort_values(["text", "toxic"])
        y = rows["toxic"].to_numpy(dtype=np.int64)
        if not len(y) or y.min() == y.max():
            return
        w, b = _fit(rows["text"].tolist(), y, min_docs, lift, steps, rate, l1)
        yield pd.DataFrame({"word": ["", *w], "weight": [b, *w.values()]})

    fitted = sample.repartition(1).mapInPandas(fit, "word string, weight double").collect()
    return ToxicityModel({r["word"]: r["weight"] for r in fitted if r["word"]}, next((r["weight"] for r in fitted if not r["word"]), -20.0))


def score_toxicity(docs: DataFrame, model: ToxicityModel, locate: bool = True) -> DataFrame:
    """Add score (noisy-or, 0 to 1) and predicted (1 from 0.5) to docs (text, ...), and with
    `locate` toxic_spans: start, end (character offsets) and score of each sentence that by
    itself reaches 0.5. Null and empty texts score 0 with no span. Other columns are carried;
    columns of these names are replaced."""

    def spans(text: str | None) -> list[dict]:
        found = []
        for m in sentences(text or ""):
            s = sentence_score(m[0], model)
            if s >= 0.0:
                found.append({"start": m.start(), "end": m.end(), "score": float(1.0 / (1.0 + np.exp(-s)))})
        return found

    def judge(texts: list) -> list[tuple]:
        scores = [document_score(t, model) for t in texts]
        return [(s, int(s >= 0.5), *([spans(t) if s >= 0.5 else []] if locate else [])) for t, s in zip(texts, scores, strict=True)]

    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    if locate:
        fields.append(T.StructField("toxic_spans", T.ArrayType(span)))
    return with_struct(docs if locate else docs.drop("toxic_spans"), "text", lambda: judge, T.StructType(fields))
