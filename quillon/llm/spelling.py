"""Spelling variants: words one letter apart, found in bidirectional FM-indexes.

Of two words with one inserted, deleted or replaced letter between them, either the first half or
the second agrees. A search matches one half exactly, from its inner end outwards up to the
delimiter, then turns and extends across the other half with one error, by intervals of suffix
ranks over the delimited words. It looks for words as long as the one asked, or one letter longer;
shorter ones are found by asking for them.

The vocabulary is spread by halves: words that could answer a search share its exact half (nearly:
the shorter of two lengths) and so its bucket, where one index of a few thousand words is built and
asked. A half that very many words share is split over several buckets, each asked by all.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import matching, parts, stored, unstore

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKET_LETTERS = 200_000  # letters of the words of a bucket, about
SHARED_WORDS = 5_000  # words of one bucket that share a half


class WaveletMatrix:
    """A sequence of small integers: how often a symbol, and how many smaller ones, stand in an
    interval; and which symbols do. All questions are arrays."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        self.bits, self.zeros, self.total = bits, [], []
        for level in range(bits - 1, -1, -1):
            one = ((sequence >> level) & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            self.total.append(int(self.zeros[-1][-1]))
            sequence = np.concatenate([sequence[~one], sequence[one]])
        symbols = np.arange(1 << bits)
        self.base = self.count(symbols, np.zeros_like(symbols), np.zeros_like(symbols))[0]

    def count(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the symbol's interval starts and ends in the last level, and the smaller ones."""
        less = np.zeros_like(low)
        for level, (zeros, total) in enumerate(zip(self.zeros, self.total, strict=True)):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = zeros[low], zeros[high]
            less = np.where(one, less + b - a, less)
            low, high = np.where(one, total + low - a, a), np.where(one, total + high - b, b)
        return low, high, less

    def symbols(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """Every symbol of each interval: number of the interval, symbol, and its count()."""
        at, symbol, less = np.arange(len(low)), np.zeros_like(low), np.zeros_like(low)
        for zeros, total in zip(self.zeros, self.total, strict=True):
            a, b = zeros[low], zeros[high]
            at, symbol = np.concatenate([at, at]), np.concatenate([2 * symbol, 2 * symbol + 1])
            less = np.concatenate([less, less + b - a])
            low, high = np.concatenate([a, total + low - a]), np.concatenate([b, total + high - b])
            some = np.flatnonzero(high > low)
            at, symbol, less, low, high = at[some], symbol[some], less[some], low[some], high[some]
        return at, symbol, low, high, less


def rotations(text: np.ndarray) -> np.ndarray:
    """Starts of the sorted rotations of a text that no shorter one repeats, by doubling."""
    n, step = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * n + np.roll(rank, -step)
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class Intervals:
    """Patterns found so far: number of the question, first suffix rank in the text, first in the
    reversed text, and how many ranks."""

    def __init__(self, asked: np.ndarray, low: np.ndarray, back: np.ndarray, size: np.ndarray) -> None:
        self.asked, self.low, self.back, self.size = asked, low, back, size

    def __len__(self) -> int:
        return len(self.asked)

    def turned(self) -> Intervals:
        return Intervals(self.asked, self.back, self.low, self.size)

    def pick(self, at: np.ndarray) -> Intervals:
        return Intervals(self.asked[at], self.low[at], self.back[at], self.size[at])

    def __add__(self, other: Intervals) -> Intervals:
        return Intervals(*(np.concatenate([getattr(self, f), getattr(other, f)]) for f in ("asked", "low", "back", "size")))


class VocabularyIndex:
    """Bidirectional FM-index of distinct words, each followed by the delimiter (symbol 0), read
    as a ring: a word's start is the delimiter before it."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        points = np.frombuffer("".join(f"{w}\0" for w in words).encode("utf-32-le"), dtype="<u4")
        self.alphabet, text = np.unique(points, return_inverse=True)
        text = text.astype(np.int64)
        self.bits = max(1, len(self.alphabet).bit_length())
        self.before = np.searchsorted(text, np.arange((1 << self.bits) + 1), sorter=np.argsort(text, kind="stable"))
        self.order = rotations(text)
        flipped = text[::-1]
        self.left = WaveletMatrix(text[self.order - 1], self.bits)
        self.right = WaveletMatrix(flipped[rotations(flipped) - 1], self.bits)
        self.starts = np.concatenate([[0], np.flatnonzero(text == 0)[:-1] + 1])
        self.size = len(text)

    def codes(self, words: list[str]) -> np.ndarray:
        """Symbols of words of one length, a row each; a letter that no word has gets one that
        occurs nowhere."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, len(self.alphabet)).astype(np.int64)

    def everything(self, n: int) -> Intervals:
        zero = np.zeros(n, dtype=np.int64)
        return Intervals(np.arange(n), zero, zero, zero + self.size)

    def extend(self, found: Intervals, symbol: np.ndarray, to_left: bool) -> Intervals:
        """The patterns with a symbol each before (or after) them, where such occur."""
        wavelet = self.left if to_left else self.right
        own = found if to_left else found.turned()
        low, high, less = wavelet.count(symbol, own.low, own.low + own.size)
        out = Intervals(own.asked, self.before[symbol] + low - wavelet.base[symbol], own.back + less, high - low)
        out = out.pick(np.flatnonzero(out.size > 0))
        return out if to_left else out.turned()

    def branch(self, found: Intervals, but: np.ndarray | None, to_left: bool) -> Intervals:
        """The patterns with any one letter more, other than the one given for each question."""
        wavelet = self.left if to_left else self.right
        own = found if to_left else found.turned()
        at, symbol, low, high, less = wavelet.symbols(own.low, own.low + own.size)
        asked = own.asked[at]
        out = Intervals(asked, self.before[symbol] + low - wavelet.base[symbol], own.back[at] + less, high - low)
        out = out.pick(np.flatnonzero((symbol != 0) & (True if but is None else symbol != but[asked])))
        return out if to_left else out.turned()

    def search(self, words: list[str], half: int, first: bool, longer: bool) -> tuple[np.ndarray, np.ndarray]:
        """Words of one length m with one error in the half that need not match: numbers of the
        questions and of the indexed words. first: the first `half` letters match, else the
        others. longer: words of m + 1 letters (one inserted), else of m letters (one replaced)."""
        codes = self.codes(words)
        exact = range(half - 1, -1, -1) if first else range(half, codes.shape[1])
        rest = range(half, codes.shape[1]) if first else range(half - 1, -1, -1)
        delimiter = np.zeros(len(words), dtype=np.int64)
        straight = self.everything(len(words))
        for letter in [*(codes[:, j] for j in exact), delimiter]:
            straight = self.extend(straight, letter[straight.asked], first)
        onward = not first
        wrong = straight.pick(np.zeros(0, dtype=np.int64))
        for letter in (codes[:, j] for j in rest):
            strayed = self.branch(straight, letter, onward)
            if longer:
                wrong += strayed
            wrong = self.extend(wrong, letter[wrong.asked], onward)
            if not longer:
                wrong += strayed
            straight = self.extend(straight, letter[straight.asked], onward)
        if longer:
            wrong += self.branch(straight, None, onward)
        wrong = self.extend(wrong, delimiter[wrong.asked], onward)
        return wrong.asked, np.searchsorted(self.starts, (self.order[wrong.low] + 1) % self.size)


def _half(length: int) -> int:
    return (length - 1) // 2


def _near_in_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a bucket's indexed words (role 0) and askers (1: for as long words, 2: for longer
    ones). What both halves find counts for the first."""
    out = [pd.DataFrame({"word": [], "n": [], "near": [], "near_n": []}).astype({"word": object, "n": np.int64, "near": object, "near_n": np.int64})]
    indexed = rows[rows["role"] == 0].sort_values("word")
    asking = rows[rows["role"] != 0].drop_duplicates(["role", "word"])
    if len(indexed) and len(asking):
        first = bool(rows["first"].iat[0])
        index, n_of = VocabularyIndex(indexed["word"].tolist()), indexed["n"].to_numpy()
        for (role, length), some in asking.groupby(["role", asking["word"].str.len()]):
            words, n = some["word"].tolist(), some["n"].to_numpy()
            half = _half(length + role - 1)
            asked, found = index.search(words, half, first, longer=role == 2)
            if not first:
                new = np.array([words[a][:half] != index.words[b][:half] for a, b in zip(asked.tolist(), found.tolist(), strict=True)], dtype=bool)
                asked, found = asked[new], found[new]
            one = {"word": [words[a] for a in asked.tolist()], "n": n[asked]}
            other = {"near": [index.words[b] for b in found.tolist()], "near_n": n_of[found]}
            out.append(pd.DataFrame(one | other))
            if role == 2:
                out.append(pd.DataFrame({"word": other["near"], "n": other["near_n"], "near": one["word"], "near_n": one["n"]}))
    return pd.concat(out, ignore_index=True)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """All ordered pairs of words of vocabulary (word, n; distinct words of two letters or more)
    that one inserted, deleted or replaced code point parts: word, n, near, near_n. The
    vocabulary is read several times: give a stored one."""
    own = vocabulary.select("word", F.col("n").cast("long").alias("n"))
    letters = own.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0))).first()[0]
    buckets = max(parts(own), math.ceil(2 * letters / BUCKET_LETTERS))

    def half(role: int, first: bool) -> Column:
        length = F.length("word") + max(0, role - 1)
        size = F.floor((length - 1) / 2).cast("int")
        key = F.substring("word", F.lit(1), size) if first else F.right("word", length - 1 - size)
        return F.struct(F.lit(first).alias("first"), length.alias("length"), key.alias("key")).alias("half")

    def rows(role: int) -> DataFrame:
        return own.select("word", "n", F.lit(role).alias("role"), F.inline(F.array(*(F.struct(half(role, f)) for f in (True, False)))))

    shared = rows(0).groupBy("half").agg(F.ceil(F.count("*") / SHARED_WORDS).cast("int").alias("split")).where("split > 1")
    indexed = matching(rows(0), shared, "half", "left").withColumn("part", F.pmod(F.xxhash64("word"), F.coalesce("split", F.lit(1))))
    asking = matching(rows(1).unionByName(rows(2)), shared, "half", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("split", F.lit(1)).cast("long") - 1)))
    dealt = indexed.unionByName(asking).select("word", "n", "role", F.col("half.first").alias("first"), (2 * F.pmod(F.xxhash64("half", "part"), F.lit(buckets)) + F.col("half.first").cast("long")).alias("bucket"))
    return dealt.groupBy("bucket").applyInPandas(_near_in_bucket, "word string, n long, near string, near_n long")


def variant_groups(vocabulary: DataFrame, times: int = 5) -> DataFrame:
    """Group the words of vocabulary (word, n): each word's form is its near word of largest n
    (ties: the smallest in code-point order) if that is at least `times` n, else null; its root
    is what forms lead to, the word itself if it has none.

    Returns word, form, root, n, n_near (number of near words), form_n (the form's n, or null).
    Repeated words count together, null words are left out, a null or negative n counts 0 (and such
    a word is no form); further columns
    are ignored. Words of one letter have no near words here. times is 2 or more, so that forms
    never lead back and chains are short.
    """
    if times < 2:
        raise ValueError("times is 2 or more")
    words = stored(vocabulary.where("word is not null and word != ''").groupBy("word").agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(0)).cast("long").alias("n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_words(words.where(F.length("word") > 1)).groupBy("word").agg(F.count("*").alias("n_near"), best)
    strong = (-F.col("best.less") >= times * F.col("n")) & (-F.col("best.less") > F.col("n"))
    formed = stored(
        words.join(near, "word", "left").select(
            "word",
            F.when(strong, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(strong, -F.col("best.less")).alias("form_n"),
        )
    )
    # A chain's counts grow by `times` with each step, so it has few.
    most = words.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    unstore(words)
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for turn in range(math.ceil(math.log2(2 + math.log(max(1, most), times)))):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(matching(roots, onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        if turn:
            unstore(roots)
        roots = step
    return matching(formed, roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def lower_ascii(word: Column) -> Column:
    """The word with A to Z in lower case, other letters as they are."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def document_words(docs: DataFrame, shortest: int = 6, occurrences: int = 5, misspelt: int | None = None) -> DataFrame:
    """The vocabulary (word, n) of docs (doc_id, text): maximal runs of letters, A to Z in lower
    case, of at least `shortest` code points and that many occurrences. A null text has none.

    misspelt plants test errors: where it divides h, the crc32 of `<doc_id>:<word>`, the word
    loses its code point h % length; a null id counts as empty there.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run"))
    words = runs.select("doc_id", lower_ascii(F.col("run")).alias("word"))
    if misspelt:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        at = (h % F.length("word")).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.select(F.when(h % misspelt == 0, shorter).otherwise(F.col("word")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)
