"""Periodic runs of words, by longest common extensions in suffix trees.

A run is a stretch of words with smallest period q, long enough, that no neighbouring word extends.
Every run of exponent 2 or more has a Lyndon root for one of two opposite orders of the words, and
that root is the longest Lyndon word from its start: it ends where the next smaller (or greater)
suffix begins. So each position gives two candidates; how far a candidate's period reaches to
either side are two longest common extensions, answered in constant time from the suffix trees of
the words and of their reversal.

Trees are built for the dense stretches of a text only: in a run of exponent 3 or more and at
least four words every three consecutive words occur three times and more, so a stretch in which
some do not holds no run. This loses nothing and skips most of ordinary prose.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, with_struct

SPACE = r"[\x20\x09-\x0D]+"


class SuffixTree:
    """Ukkonen's tree of a sequence of positive integers and a last 0, laid out for queries:
    rank of each suffix, and the depths at which the Euler tour turns between two leaves."""

    def __init__(self, word: list[int]) -> None:
        word = [*word, 0]
        edges, start, end, leaf = self._build(word)
        n, nodes = len(word), len(start)
        width = max(word) + 1
        keys = np.fromiter(edges.keys(), dtype=np.int64, count=len(edges))
        child = np.fromiter(edges.values(), dtype=np.int64, count=len(edges))
        order = np.argsort(keys)
        parent = np.zeros(nodes, dtype=np.int64)
        parent[child] = keys // width
        eldest = np.zeros(nodes, dtype=bool)
        eldest[child[order[np.flatnonzero(np.diff(keys[order] // width, prepend=-1))]]] = True
        child = child[order[::-1]]  # of one parent from the greatest letter to the least
        owner = parent[child][::-1]
        first = np.searchsorted(owner, np.arange(nodes + 1))
        low, high = (len(child) - first[1:]).tolist(), (len(child) - first[:-1]).tolist()
        tour, stack, child, above = [], [0], child.tolist(), parent.tolist()
        depth = [0] * nodes
        while stack:
            v = stack.pop()
            tour.append(v)
            if low[v] < high[v]:
                stack += child[low[v] : high[v]]
                depth[v] = depth[above[v]] + end[v] - start[v]
        tour, depth = np.array(tour), np.array(depth)
        suffix = np.full(nodes, -1, dtype=np.int64)
        suffix[leaf] = np.arange(n)
        suffix = suffix[tour]
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[suffix[suffix >= 0]] = np.arange(n)
        younger = tour[1:][~eldest[tour[1:]]]
        self.turns = [depth[parent[younger]].astype(np.int32)]
        while 2 << (len(self.turns) - 1) < n:
            last, step = self.turns[-1], 1 << (len(self.turns) - 1)
            self.turns.append(np.minimum(last[:-step], last[step:]))

    @staticmethod
    def _build(word: list[int]) -> tuple[dict[int, int], list[int], list[int], list[int]]:
        """Edges (node * width + first letter to child), where each node's letters start and end,
        and the leaf of each suffix. A node's letters are those of the edge into it."""
        n, width = len(word), max(word) + 1
        edges: dict[int, int] = {}
        start, end, link, leaf = [0], [0], [0], []
        node, at, length, open_suffixes = 0, 0, 0, 0
        for i, c in enumerate(word):
            open_suffixes += 1
            made = 0
            while open_suffixes:
                if not length:
                    at = i
                key = node * width + word[at]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    inner = node
                else:
                    size = end[child] - start[child]
                    if length >= size:
                        at, length, node = at + size, length - size, child
                        continue
                    middle = start[child] + length
                    if word[middle] == c:
                        length += 1
                        if made:
                            link[made] = node
                        break
                    inner = len(start)
                    edges[key] = inner
                    start.append(start[child])
                    end.append(middle)
                    link.append(0)
                    start[child] = middle
                    edges[inner * width + word[middle]] = child
                    edges[inner * width + c] = len(start)
                leaf.append(len(start))
                start.append(i)
                end.append(n)
                link.append(0)
                if made:
                    link[made] = inner
                made = inner if child is not None else 0
                open_suffixes -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - open_suffixes + 1
        return edges, start, end, leaf

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many letters the suffixes from i and from j (other than i) have in common."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        for k in np.unique(level).tolist():
            own = np.flatnonzero(level == k)
            out[own] = np.minimum(self.turns[k][low[own]], self.turns[k][high[own] - (1 << k)])
        return out


def _next_less(rank: list[int]) -> list[int]:
    """For each position the next one of a smaller rank, or the end."""
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def find_runs(word: np.ndarray, shortest: int, exponent: int) -> np.ndarray:
    """Start, length and period of the runs of a sequence, in order of start and period: those of
    length at least `shortest` and `exponent` periods (2 or more)."""
    n = len(word)
    letters = np.unique(word, return_inverse=True)[1] + 1
    ahead, behind = SuffixTree(letters.tolist()), SuffixTree(letters[::-1].tolist())
    rank = ahead.rank
    # With the end as a letter: least in one order, greatest in the other, where a candidate
    # that reaches beyond it is none.
    start = np.tile(np.arange(n), 2)
    stop = np.array(_next_less(rank.tolist())[:n] + _next_less((-rank).tolist())[:n])
    period = stop - start
    fits = (stop <= n) & (period * exponent <= n)
    start, period = start[fits], period[fits]
    after = ahead.common(start, start + period)
    before = behind.common(n - start, n - start - period)
    length = before + period + after
    long = length >= np.maximum(shortest, exponent * period)
    return np.unique(np.stack([start - before, period, length], axis=1)[long], axis=0)[:, [0, 2, 1]]


def dense_stretches(codes: np.ndarray, owner: np.ndarray, shortest: int, exponent: int) -> list[tuple[int, int]]:
    """Stretches (from, to) of equal owner outside of which no run can lie. Three consecutive
    words of a run occur in it exponent - 1 times and more (with period 1: length - 2 times), each
    time in the same stretch."""
    if len(codes) < 3:
        return []
    least = min(exponent - 1, max(shortest, exponent) - 2)
    spread = mix64(codes.astype(np.uint64) + np.uint64(1))
    three = mix64(mix64(spread[:-2] + spread[1:-1] * np.uint64(3)) + spread[2:])
    at = np.flatnonzero(owner[2:] == owner[:-2])
    group = owner[at].astype(np.uint64)
    while len(at):
        before = len(at)
        _, number, count = np.unique(three[at] ^ mix64(group + np.uint64(1)), return_inverse=True, return_counts=True)
        often = count[number] >= least
        at, group = at[often], group[often]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) != 1) | (group[1:] != group[:-1])
        group = np.cumsum(new).astype(np.uint64)
        _, number, size = np.unique(group, return_inverse=True, return_counts=True)
        enough = size[number] >= shortest - 2
        at, group = at[enough], group[enough]
        if len(at) == before:
            break
    cuts = np.flatnonzero(np.diff(at) != 1) + 1
    cuts = np.union1d(cuts, np.flatnonzero(np.diff(group.astype(np.int64))) + 1) if len(at) else cuts
    return [(int(p[0]), int(p[-1]) + 3) for p in np.split(at, cuts) if len(p)]


def _of_texts(texts: list[str | None], shortest: int, exponent: int) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
    words = [(t or "").encode().split() for t in texts]  # bytes part at U+0020 and U+0009 to U+000D only
    sizes = np.array([len(w) for w in words])
    codes = pa.array(itertools.chain.from_iterable(words), pa.binary()).dictionary_encode().indices.to_numpy()
    owner, first = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes
    found: dict[int, list[np.ndarray]] = {}
    for a, b in dense_stretches(codes, owner, shortest, exponent):
        runs = find_runs(codes[a:b], shortest, exponent)
        if len(runs):
            found.setdefault(int(owner[a]), []).append(runs + np.array([a - first[owner[a]], 0, 0]))
    for i, own in enumerate(words):
        runs = np.concatenate(found[i]) if i in found else np.zeros((0, 3), dtype=np.int64)
        runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        if len(runs):
            step = np.zeros(len(own) + 1, dtype=np.int64)
            np.add.at(step, runs[:, 0] + runs[:, 2], 1)
            np.add.at(step, runs[:, 0] + runs[:, 1], -1)
            own = list(itertools.compress(own, (np.cumsum(step)[:-1] == 0).tolist()))
        yield [tuple(r) for r in runs.tolist()], b" ".join(own).decode()


def periodic_runs(docs: DataFrame, shortest: int = 6, exponent: int = 4) -> DataFrame:
    """Add to docs (text, ...) runs, array<struct<start, length, period>> in order of start and
    period (word numbers from 0), and collapsed: the words, joined by one space, but those that a
    run holds after its first period. Words are what white space (U+0020, U+0009 to U+000D) parts.

    Runs have at least `shortest` words (4 or more) and `exponent` periods (3 or more). A null,
    empty or blank text has no run and collapses to the empty text. Other columns are carried;
    columns of the new names are replaced. A text is handled whole in one task, with memory in
    proportion to its longest dense stretch.
    """
    if shortest < 4 or exponent < 3:
        raise ValueError("runs have at least 4 words and 3 periods")
    run = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
    fields = T.StructType([T.StructField("runs", T.ArrayType(run, False)), T.StructField("collapsed", T.StringType())])

    def make():
        def function(texts: list) -> list[tuple]:
            return [([{"start": s, "length": n, "period": q} for s, n, q in runs], text) for runs, text in _of_texts(texts, shortest, exponent)]

        return function

    return with_struct(docs, "text", make, fields)


def planted(text: Column, doc_id: Column) -> Column:
    """The test texts of the registered query: where crc32 of the decimal id is divisible by 10,
    the words from some place on repeat a few of them. A null id plants nothing."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        rest = F.flatten(F.array_repeat(F.slice(words, a + 1, p), times))
        return F.when(n > 0, F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), rest), F.lit(1), n), " "))

    # The words are bound by a lambda, so that they are split once for each text.
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    found = F.get(F.transform(F.array(words), repeated), F.lit(0))
    return F.when(h % 10 == 0, F.coalesce(found, text)).otherwise(text)
