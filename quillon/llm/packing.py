"""Packing token sequences by non-negative least squares over length combinations.

Documents become token ids; whole windows are cut off first, so that each leaves one remainder
shorter than the window. Combinations of up to three remainder lengths that fill the window
exactly are enumerated; how often each is used solves a non-negative least squares problem
against the histogram of remainder lengths (a table as long as the window). The counts are
rounded down; what remains is packed greedily, one piece after the other, cut at windows' ends.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordMemory, emptied_id, filled_id, map_texts, parts, stored, unstore

END_ID = 1
#: Bytes of token ids of words that a Python worker remembers.
TOKEN_BYTES = 96_000_000
# Characters for which lower-casing and word classes are the same in every library.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*")
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 for itself,
    the other bytes from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0x100)} - {0xAD}
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


@functools.lru_cache(maxsize=1)
def token_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """An encoder of texts to ids (little-endian unsigned 32-bit) with the word-level tokenizer
    file at path, one per Python worker. Plain texts are split here, and each distinct word is
    merged by the file's model once while it is remembered; other texts go to the tokenizer whole."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    merged, letters = tokenizer.model.tokenize, _byte_letters()
    packed = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    def raw(text: str) -> bytes:
        return b"".join(packed[i] for i in tokenizer.encode(text, add_special_tokens=False).ids)

    def learn(word: str) -> bytes:
        written = word if word.isascii() else word.encode().decode("latin-1").translate(letters)
        return b"".join([packed[piece.id] for piece in merged(written)])

    ids = WordMemory(learn, TOKEN_BYTES).__getitem__

    def encode(texts: list[str]) -> list[bytes]:
        plain = [PLAIN.fullmatch(t) and not any(s in t for s in special) for t in texts]
        return [b"".join(map(ids, PRETOKEN.findall(t.lower()))) if p else raw(t) for t, p in zip(texts, plain, strict=True)]

    return encode


def _encoded(frame: pd.DataFrame, encode) -> Iterator[tuple]:
    end = np.array([END_ID], dtype="<u4").tobytes()
    for doc, ids in zip(frame["doc_id"], encode([t or "" for t in frame["text"]]), strict=True):
        yield doc, ids + end


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, window: int):
    """Whole windows and the remainder of each document, with checksums; the ids of remainders,
    which may be cut, two bytes each where they allow."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = token_encoder(path)
        for frame in frames:
            rows = []
            for doc, ids in _encoded(frame, encode):
                n = len(ids) // 4
                for at in range(0, n, window):
                    own = ids[4 * at : 4 * (at + window)]
                    rows.append((doc, at, len(own) // 4, zlib.crc32(own), n, None if len(own) == 4 * window else _narrow(own)))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return run


def _narrow(ids: bytes) -> bytes:
    wide = np.frombuffer(ids, dtype="<u4")
    return wide.astype("<u2").tobytes() if wide.max() < 1 << 16 else ids


def _wide(ids: bytes, n: int) -> bytes:
    return ids if len(ids) == 4 * n else np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()


def combinations(histogram: np.ndarray, common: int = 96) -> list[tuple[int, ...]]:
    """Length tuples that fill the window exactly: the window itself, pairs, and triples with
    two of the most common lengths. Index of histogram: length; its last entry is the window."""
    window = len(histogram) - 1
    found = {(window,)} if histogram[window] else set()
    found |= {(a, window - a) for a in range(1, window // 2 + 1) if histogram[a] and histogram[window - a]}
    often = [int(a) for a in np.argsort(-histogram[:window], kind="stable")[:common] if histogram[a]]
    for i, a in enumerate(often):
        for b in often[i:]:
            c = window - a - b
            if c > 0 and histogram[c]:
                found.add(tuple(sorted((a, b, c))))
    return sorted(found)


def repeat_counts(histogram: np.ndarray, combos: list[tuple[int, ...]], sweeps: int = 40) -> np.ndarray:
    """Non-negative least squares by cyclic coordinate descent, rounded down to whole counts
    that use no length more often than it occurs."""
    left = histogram.astype(np.float64).copy()
    columns = [(np.unique(c), np.array([c.count(v) for v in np.unique(c)], dtype=np.float64)) for c in combos]
    x = np.zeros(len(combos))
    for _ in range(sweeps):
        moved = 0.0
        for j, (at, m) in enumerate(columns):
            step = max(-x[j], float(left[at] @ m) / float(m @ m))
            if step:
                x[j] += step
                left[at] -= step * m
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    free, counts = histogram.astype(np.int64).copy(), np.zeros(len(combos), dtype=np.int64)
    for j in np.argsort(-x, kind="stable"):
        at, m = columns[j]
        counts[j] = max(0, min(int(x[j] + 1e-6), int((free[at] // m.astype(np.int64)).min())))
        free[at] -= counts[j] * m.astype(np.int64)
    return counts


class Plan:
    """Where the r-th piece of each length goes: intervals of ranks for the combinations' slots,
    then a running offset over all pieces left. Its size depends on the window only."""

    def __init__(self, histogram: np.ndarray) -> None:
        window = len(histogram) - 1
        combos = combinations(histogram)
        used, sequence, rows = np.zeros(window + 1, dtype=np.int64), 0, []
        for combo, n in zip(combos, repeat_counts(histogram, combos), strict=True):
            offset = 0
            for length in combo if n else ():
                rows.append((length, used[length], sequence, offset))
                used[length] += n
                offset += length
            sequence += int(n)
        rest = histogram - used
        rest_at = np.concatenate([[0], np.cumsum(rest * np.arange(window + 1))[:-1]])
        rows.sort()
        table = np.array(rows, dtype=np.int64).reshape(-1, 4)
        self.window, self.used, self.first_rest, self.rest_at = window, used, sequence, rest_at
        self.key, self.sequence, self.offset, self.start = (table[:, 0] << 40) | table[:, 1], table[:, 2], table[:, 3], table[:, 1]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset; an offset and length beyond the window mean a cut."""
        rest = rank >= self.used[length]
        at = self.rest_at[length] + (rank - self.used[length]) * length
        sequence, offset = self.first_rest + at // self.window, at % self.window
        if len(self.key):
            i = np.maximum(0, np.searchsorted(self.key, (length << 40) | rank, side="right") - 1)
            sequence = np.where(rest, sequence, self.sequence[i] + rank - self.start[i])
            offset = np.where(rest, offset, self.offset[i])
        return sequence, offset


def _ranked(pieces: DataFrame) -> DataFrame:
    """Number the pieces of each length from 0: within salted groups first, then shifted by the
    counts of the groups before, so that a length shared by many pieces has no single task."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts(pieces))))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy("length").orderBy("salt")) - F.col("k")
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    return salted.withColumn("own", own).join(counts.select("length", "salt", before.alias("before")), ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "salt")


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048) -> DataFrame:
    """Pack docs (doc_id, text) into sequences of at most `window` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null
    or empty text has the end token only; every row of docs is packed, repeated ones too. Only
    the last sequence may be shorter than the window. Further columns are ignored; an empty
    table gives no piece. Each text is encoded once: remainders keep their ids until they are
    placed, and the few that cross a window's end are cut there.
    """
    pieces = stored(map_texts(docs.select(filled_id("doc_id"), "text"), "text", _pieces(tokenizer_path, window), f"{PIECE}, ids binary"))
    histogram = np.zeros(window + 1, dtype=np.int64)
    for row in pieces.groupBy("length").agg(F.count("*").alias("k")).collect():
        histogram[row["length"]] = row["k"]
    plan = Plan(histogram)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = plan.place(frame["length"].to_numpy(), frame["rank"].to_numpy())
            placed = frame.drop(columns="rank").assign(sequence_id=sequence, offset=offset)
            over = offset + frame["length"].to_numpy() > window
            yield placed[~over].drop(columns="ids")
            yield _cut(placed[over], window)

    ranked = _ranked(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "rank")
    placed = stored(ranked.mapInPandas(place, f"{PIECE}, sequence_id long, offset long"))
    unstore(pieces)
    return placed.withColumn("doc_id", emptied_id("doc_id"))


def _cut(over: pd.DataFrame, window: int) -> pd.DataFrame:
    """Both parts of pieces that reach beyond the window's end, each with its checksum."""
    rows = []
    for piece in over.itertuples():
        ids, first = _wide(piece.ids, piece.length), window - piece.offset
        rows.append((piece.doc_id, piece.start, first, zlib.crc32(ids[: 4 * first]), piece.doc_tokens, piece.sequence_id, piece.offset))
        rows.append((piece.doc_id, piece.start + first, piece.length - first, zlib.crc32(ids[4 * first :]), piece.doc_tokens, piece.sequence_id + 1, 0))
    return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
