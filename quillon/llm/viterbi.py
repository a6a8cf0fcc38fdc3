"""Encoding to and decoding from a SentencePiece vocabulary by shared-prefix Viterbi.

A text is marked (each space, U+0020, becomes the mark, and one mark is put before it; other
white space stays) and split into marked words. The distinct words of a batch are sorted, which is a depth-first walk of their
trie: forward scores are kept per letter of the current word, and the next word reuses those of
the common prefix. The segmentation of highest total piece score wins.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import RecentWords, with_struct, word_bytes

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
BYTE_PENALTY = 10.0


class PieceTable:
    """What decoding needs of a model file: its pieces and the byte pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}


class PieceVocabulary(PieceTable):
    """What encoding needs besides: scores, and the pieces' letters backwards as a trie (found
    by their last letter first)."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        model, n = self.model, len(self.pieces)
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.scores = {i: float(model.get_score(i)) for i in plain}
        self.byte_score = min(self.scores.values()) - BYTE_PENALTY
        self.ends: dict = {}
        for i in plain:
            node = self.ends
            for c in reversed(self.pieces[i]):
                node = node.setdefault(c, {})
            node[0] = (self.scores[i], i)


class ViterbiEncoder:
    def __init__(self, path: str) -> None:
        self.vocabulary = PieceVocabulary(path)
        self.words = RecentWords(self.add, word_bytes)

    def add(self, words: list[str]) -> list[bytes]:
        """Encode sorted distinct words; each reuses the scores of the prefix that it shares
        with the one before."""
        ends, missing = self.vocabulary.ends, self.vocabulary.byte_score
        before, score, back, out = "", [0.0], [(0, 0)], []
        for word in words:
            k, most = 0, min(len(word), len(before))
            while k < most and word[k] == before[k]:
                k += 1
            del score[k + 1 :], back[k + 1 :]
            for e in range(k, len(word)):
                node, s = ends.get(word[e]), e
                best, link = score[e] + missing * len(word[e].encode("utf-8", "surrogatepass")), (e, -1)
                while node is not None:
                    piece = node.get(0)
                    if piece is not None and score[s] + piece[0] > best:
                        best, link = score[s] + piece[0], (s, piece[1])
                    s -= 1
                    if s < 0:
                        break
                    node = node.get(word[s])
                score.append(best)
                back.append(link)
            before = word
            ids, at = [], len(word)
            while at:
                start, piece = back[at]
                ids += [piece] if piece >= 0 else [self.vocabulary.bytes[b] for b in reversed(word[start].encode("utf-8", "surrogatepass"))]
                at = start
            out.append(np.array(ids[::-1], dtype="<u4").tobytes())
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        split = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        found = self.words({w for words in split for w in words})
        return [b"".join(map(found.__getitem__, words)) for words in split]


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> ViterbiEncoder:
    """One encoder per Python worker: later tasks find the words of earlier ones."""
    return ViterbiEncoder(path)


@functools.lru_cache(maxsize=1)
def _pieces(path: str) -> PieceTable:
    return PieceTable(path)


def decode_ids(ids, vocabulary: PieceTable) -> str:
    """The text of ids: pieces joined, byte pieces as UTF-8, marks as spaces, the first dropped.
    A text's own marks come back as spaces."""
    out: list[str] = []
    run = bytearray()
    byte_of, pieces = vocabulary.byte_of, vocabulary.pieces
    for i in ids:
        b = byte_of.get(i)
        if b is not None:
            run.append(b)
            continue
        if run:
            out.append(run.decode("utf-8", "replace"))
            run = bytearray()
        out.append(pieces[i])
    if run:
        out.append(run.decode("utf-8", "replace"))
    text = "".join(out).replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def encode_texts(docs: DataFrame, model_path: str, decoded: bool = False) -> DataFrame:
    """Add piece_ids array<int> to docs (text, ...), and with `decoded` the text that the ids
    give back (decode_texts, in the same pass). A null text gives null, an empty one an empty
    array. Other columns are carried; columns of those names are replaced. The vocabulary is a
    BPE model's: its piece scores decide, so pieces may differ from those of its merges."""

    def make():
        encoder = _encoder(model_path)

        def encode(texts: list) -> list[tuple]:
            coded = encoder.encode([t or "" for t in texts])
            ids = [None if t is None else np.frombuffer(x, dtype="<u4").astype(np.int32) for t, x in zip(texts, coded, strict=True)]
            return [(x, None if x is None else decode_ids(x.tolist(), encoder.vocabulary))[: 1 + decoded] for x in ids]

        return encode

    fields = [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return with_struct(docs, "text", make, T.StructType(fields[: 1 + decoded]))


def decode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """Add decoded (the text) to docs (piece_ids, ...); null ids give null, no ids the empty
    text. Other columns are carried; a column of that name is replaced."""

    def make():
        vocabulary = _pieces(model_path)
        return lambda rows: [(None if ids is None else decode_ids(ids, vocabulary),) for ids in rows]

    return with_struct(docs, "piece_ids", make, T.StructType([T.StructField("decoded", T.StringType())]))
