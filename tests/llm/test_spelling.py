"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillon.llm import spelling
from quillon.llm.queries import QUERIES
from quillon.llm.spelling import VocabularyIndex, WaveletMatrix, document_words, near_words, rotations, variant_groups

FOLDER = "/root/testdata/sf0.001"


def patterns(word):
    return {word[:i] + "\0" + word[i + 1 :] for i in range(len(word))}


def all_pairs(words):
    """Ordered pairs one code point apart, by what is left when a letter is blanked or lost."""
    blanked, words = {}, set(words)
    for w in words:
        for x in patterns(w):
            blanked.setdefault(x, set()).add(w)
    near = {(a, b) for some in blanked.values() for a in some for b in some if a != b}
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                near |= {(w, shorter), (shorter, w)}
    return near


def grouped(counts, times=5):
    near = {}
    for a, b in all_pairs(counts):
        near.setdefault(a, []).append((-counts[b], b))
    forms = {w: min(x)[1] for w, x in near.items() if -min(x)[0] >= times * counts[w]}

    def root(w):
        while w in forms:
            w = forms[w]
        return w

    return {(w, forms.get(w), root(w), n, len(near.get(w, ())), counts[forms[w]] if w in forms else None) for w, n in counts.items()}


def test_wavelet_matrix_and_rotations():
    rng = np.random.default_rng(3)
    sequence = rng.integers(0, 11, 500)
    wavelet = WaveletMatrix(sequence, 4)
    low = rng.integers(0, 400, 50)
    high = low + rng.integers(0, 100, 50)
    symbol = rng.integers(0, 16, 50)
    a, b, less = wavelet.count(symbol, low, high)
    assert (b - a).tolist() == [(sequence[i:j] == s).sum() for i, j, s in zip(low, high, symbol)]
    assert (a - wavelet.base[symbol]).tolist() == [(sequence[:i] == s).sum() for i, s in zip(low, symbol)]
    assert less.tolist() == [(sequence[i:j] < s).sum() for i, j, s in zip(low, high, symbol)]
    at, found, a, b, less = wavelet.symbols(low, high)
    assert sorted(zip(at.tolist(), found.tolist())) == [(i, s) for i in range(50) for s in sorted(set(sequence[low[i] : high[i]].tolist()))]
    assert less.tolist() == [(sequence[low[i] : high[i]] < s).sum() for i, s in zip(at, found)]
    text = [2, 1, 2, 1, 0, 2, 1, 0]
    assert rotations(np.array(text)).tolist() == sorted(range(8), key=lambda i: text[i:] + text[:i])


@pytest.mark.parametrize("letters", ["ab", "abcdefgé"])
def test_index_finds_every_word_one_error_away(letters):
    rng = random.Random(letters)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(300)})
    index, near = VocabularyIndex(words), all_pairs(words)
    for length in range(2, 10):
        asked = [w for w in words if len(w) == length] + ["z" * length]
        for longer in (False, True):
            for half in range(length + 1):
                found = set()
                for first in (True, False):
                    a, b = index.search(asked, half, first, longer)
                    pairs = [(asked[i], words[j]) for i, j in zip(a.tolist(), b.tolist())]
                    assert len(pairs) == len(set(pairs))
                    assert all(w[:half] == v[:half] if first else w[half:] == v[len(v) - len(w) + half :] for w, v in pairs)
                    found |= set(pairs)
                assert found == {(w, v) for w, v in near if len(w) == length and len(v) == length + longer}


def test_near_words_with_shared_halves_split(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARED_WORDS", 20)
    monkeypatch.setattr(spelling, "BUCKET_LETTERS", 500)
    rng = random.Random(9)
    words = {"aaaaaa" + "".join(rng.choice("abcd") for _ in range(rng.randint(3, 5))) for _ in range(400)} | {"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))) for _ in range(300)}
    table = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n int")
    got = [(r["word"], r["near"]) for r in near_words(table).collect()]
    assert len(got) == len(set(got)) and set(got) == all_pairs(words)


def test_registered_query_against_all_pairs(spark):
    counts = Counter()
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{r['doc_id']}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    wanted = grouped({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    got = QUERIES["op11_spelling_variants"](spark, FOLDER)
    assert {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()} == wanted
    assert sum(x[1] is not None for x in wanted) > 5


def test_chains_ties_and_awkward_words(spark):
    rows = [("colour", 3000), ("color", 400), ("colr", 60), ("coll", 60), ("colo", 9), ("col", 1), ("a", 7), ("b", 90), ("", 5), (None, 5), ("naïve", 50), ("naive", 4), ("naive", 3), ("Émile", None), ("Emile", 0), ("x" * 3000, 50), ("x" * 1500 + "y" + "x" * 1500, 10)]
    table = spark.createDataFrame([(w, n, 0) for w, n in rows], "word string, n int, root int")
    counts = Counter()
    for w, n in rows:
        if w and len(w) > 1:
            counts[w] += n or 0
    wanted = {x for x in grouped({w: n for w, n in counts.items() if n}) if x[0]} | {("Émile", None, "Émile", 0, 1, None), ("Emile", None, "Emile", 0, 1, None), ("a", None, "a", 7, 0, None), ("b", None, "b", 90, 0, None)}
    got = {tuple(r) for r in variant_groups(table).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == wanted
    assert {x[0]: x[2] for x in got}["colr"] == "colour" and {x[0]: x[1] for x in got}["col"] == "coll"
    assert variant_groups(table.where("false")).collect() == []
    with pytest.raises(ValueError, match="2 or more"):
        variant_groups(table, times=1)


def test_document_words_of_awkward_texts(spark, awkward, nothing):
    got = {r["word"]: r["n"] for r in document_words(awkward, 4, 2).collect()}
    assert got["reserved"] == 4 and got["word"] == 30_000 and "ünïcödé" not in got
    assert "don" not in got and document_words(nothing).collect() == []
    one = spark.createDataFrame([(None, "ÀBCDEF " * 3)], "doc_id int, text string")
    assert [tuple(r) for r in document_words(one, 6, 3, 199).collect()] == [("Àbcdef", 3)]
    assert [tuple(r) for r in document_words(one, 5, 3, 1).collect()][0][1] == 3
