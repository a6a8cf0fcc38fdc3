"""Periodic runs against every period tried at every place."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm.periodic import SuffixTree, dense_stretches, find_runs, periodic_runs
from quillon.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_runs(word, shortest=6, exponent=4):
    n, found = len(word), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and word[j] == word[j + q]:
                j += 1
            if j - i + q >= max(shortest, exponent * q):
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(word, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(word) if i not in gone]


@pytest.mark.parametrize("word", [[1], [1, 1, 1], [1, 2, 1, 2, 1], [3, 1, 2, 3, 1, 2, 3, 1], [1, 2, 3, 4]])
def test_suffix_tree(word):
    tree = SuffixTree(word)
    ended = [*word, 0]
    order = sorted(range(len(ended)), key=lambda i: ended[i:])
    assert [tree.rank[i] for i in order] == list(range(len(ended)))
    for i in range(len(ended)):
        for j in range(len(ended)):
            if i != j:
                k = 0
                while max(i, j) + k < len(ended) and ended[i + k] == ended[j + k]:
                    k += 1
                assert tree.common(np.array([i]), np.array([j])).tolist() == [k]


pieces = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 8)), max_size=6)


@settings(max_examples=400, deadline=None)
@given(pieces, st.sampled_from([(6, 4), (4, 3), (6, 10), (9, 3)]))
def test_runs_of_random_sequences(parts, limits):
    word = np.array([w for piece, times in parts for w in piece * times], dtype=np.int64)
    wanted = plain_runs(word.tolist(), *limits)
    if len(word):
        assert list(map(tuple, find_runs(word, *limits).tolist())) == wanted
    stretches = dense_stretches(word, np.zeros(len(word), dtype=np.int64), *limits)
    assert all(any(a <= s and s + n <= b for a, b in stretches) for s, n, _ in wanted)
    assert sorted(tuple(r) for a, b in stretches for r in (find_runs(word[a:b], *limits) + np.array([a, 0, 0])).tolist()) == wanted


def test_long_texts(spark):
    rng = np.random.default_rng(5)
    texts = ["a " * 30_000, " ".join(map(str, rng.integers(0, 2, 3000))), "x y z " * 4 + "x y w " * 4 + "    q " * 5]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for r in periodic_runs(docs).collect():
        word = r["text"].encode().split()
        wanted = [(0, 30_000, 1)] if r["doc_id"] == 0 else plain_runs(word)
        assert [tuple(x) for x in r["runs"]] == wanted
        assert r["collapsed"] == b" ".join(collapsed(word, wanted)).decode()


def test_awkward_rows(spark, awkward, nothing):
    extra = awkward.selectExpr("*", "1 as runs", "2 as collapsed")
    rows = {r["doc_id"]: r for r in periodic_runs(extra).collect()}
    assert len(periodic_runs(extra).columns) == len(extra.columns) and periodic_runs(extra).count() == awkward.count()
    for i in (1, 2, 3):
        assert rows[i]["runs"] == [] and rows[i]["collapsed"] == ""
    assert [tuple(x) for x in rows[8]["runs"]] == [(0, 30_000, 1)] and rows[8]["collapsed"] == "word"
    assert rows[6]["collapsed"] == "One two three four five six seven eight"
    assert periodic_runs(nothing).count() == 0
    with pytest.raises(ValueError, match="3 periods"):
        periodic_runs(awkward, exponent=2)


def test_registered_query_against_trying_every_period(spark):
    got = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for r in docs:
        word = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        n, h = len(word), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            word = [w if i < a else word[a + (i - a) % p] for i, w in enumerate(word)]
        if n > 2500:
            continue
        runs = plain_runs(word)
        some += len(runs)
        best = min(((-length, s, q) for s, length, q in runs), default=None)
        row = got[r["doc_id"]]
        assert row["n_runs"] == len(runs)
        assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == ((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(collapsed(word, runs)).encode()).hexdigest()
    assert some > 5
