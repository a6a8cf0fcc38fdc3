"""Shared helpers: tables in the cluster's shared folder, batch slicing, text features."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillon.sources.stored import fresh_path, stored, unstore

__all__ = ["fresh_path", "stored", "unstore"]


def remainder(col: str, modulus: int) -> Column:
    """crc32 of a column's text form, modulo: the contract's fold number (null stays null)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(modulus)


def hash_fraction(df: DataFrame, key: str | list[str], fraction: float, salt: str) -> DataFrame:
    """The rows whose salted key hash falls below the fraction: a repeatable sample."""
    if fraction >= 1:
        return df
    limit = int(fraction * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.lit(salt), *([key] if isinstance(key, str) else key)), F.lit(1 << 30)) < F.lit(limit))


#: Stands for a null id inside Python batches, where a null would turn ids into floats.
NO_ID = -(1 << 63)


def filled_id(col: str) -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID)).alias(col)


def emptied_id(col: str) -> Column:
    return F.nullif(F.col(col), F.lit(NO_ID)).alias(col)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as set it apart from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes that a broadcast may take in each executor.
BROADCAST_BYTES = 16_000_000


def fits_broadcast(df: DataFrame) -> bool:
    """Whether df's rows, counted and measured, take at most BROADCAST_BYTES as a hash table."""
    wide = [f"size(`{c}`) * 8" if t.startswith("array") else f"length(cast(`{c}` as binary))" for c, t in df.dtypes if t in ("string", "binary") or t.startswith("array")]
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.expr(" + ".join(f"coalesce({w}, 0)" for w in wide) or "0")), F.lit(0)).alias("size")).first()
    return row["n"] * (40 + 16 * len(df.columns)) + row["size"] <= BROADCAST_BYTES


def matching(df: DataFrame, ids: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """Join the wide rows of df with narrow rows by key. Up to BROADCAST_BYTES, measured, the
    narrow rows are broadcast, so that df need not be shuffled; beyond, Spark shuffles both. The
    result is the same either way."""
    return df.join(F.broadcast(ids) if fits_broadcast(ids) else ids, key, how)


def parts(df: DataFrame) -> int:
    """Partitions for a shuffle by key, as the session sets them."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Texts that one step of a Python task holds as Python objects: so many rows and bytes at most
#: (one text, if longer).
SLICE_ROWS, SLICE_BYTES = 256, 2_000_000
#: Bytes of results for words that a Python worker remembers.
WORD_BYTES = 24_000_000


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """An Arrow batch in slices, which share its memory, with a bounded size of one column
    (strings or arrays of integers)."""
    values = batch.column(column)
    lengths = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
    sizes = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        end = int(np.searchsorted(ends, ends[at] - sizes[at] + SLICE_BYTES, side="right"))
        end = min(max(end, at + 1), at + SLICE_ROWS, len(ends))
        yield batch.slice(at, end - at)
        at = end


def with_struct(df: DataFrame, column: str, make: Callable[[], Callable], fields: T.StructType) -> DataFrame:
    """df with the fields that a Python function gives for one column (a list of values to a list
    of tuples), replacing columns of those names. make() is called once in each task and returns
    the function. Other columns pass through as Arrow data and keep their types and nulls; a few
    hundred rows at a time become Python objects."""
    kept = df.drop(*fields.names)
    names, types = [*kept.columns, *fields.names], to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for part in text_slices(batch, column):
                rows = function(part.column(column).to_pylist())
                made = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=names)

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields.fields]))


def map_texts(df: DataFrame, column: str, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """mapInPandas over small slices of the rows, bounded by the size of one column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (part.to_pandas() for batch in batches for part in text_slices(batch, column))
        for out in function(frames):
            yield pa.RecordBatch.from_pandas(out, schema=types, preserve_index=False)

    fields = T.StructType.fromDDL(schema)
    types = to_arrow_schema(fields)
    return df.mapInArrow(run, fields)


class RecentWords:
    """What learn (sorted words to values) gives for words, remembered within about `limit` bytes.

    Two generations: words asked for lately are in the young one; when that has half of the
    bytes it becomes the old one, and what was old and unused is forgotten.
    """

    def __init__(self, learn: Callable[[list[str]], list], size: Callable[[str, object], int], limit: int = WORD_BYTES) -> None:
        self.learn, self.size, self.limit = learn, size, limit
        self.young, self.old, self.bytes = {}, {}, 0

    def __call__(self, words: set[str]) -> dict:
        """The values of these words."""
        found = {w: self.young[w] for w in words & self.young.keys()}
        added = {w: self.old[w] for w in words & self.old.keys() if w not in found}
        new = sorted(words - found.keys() - added.keys())
        added.update(zip(new, self.learn(new), strict=True))
        self.bytes += sum(self.size(w, v) for w, v in added.items())
        if self.bytes > self.limit // 2:
            self.old, self.young, self.bytes = self.young, {}, 0
        else:
            self.young.update(added)
        return found | added


def word_bytes(word: str, value: bytes) -> int:
    """Memory of a remembered word and its bytes."""
    return 220 + len(word) * (1 if word.isascii() else 4) + len(value)


class WordMemory(dict):
    """What learn gives for a word, remembered within about `limit` bytes: two generations, as in
    RecentWords, filled word by word."""

    def __init__(self, learn: Callable[[str], bytes], limit: int) -> None:
        super().__init__()
        self.learn, self.limit, self.old, self.bytes = learn, limit, {}, 0

    def __missing__(self, word: str) -> bytes:
        value = self.old.get(word)
        if value is None:
            value = self.learn(word)
        self.bytes += word_bytes(word, value)
        if self.bytes > self.limit // 2:
            self.old, self.bytes = self.copy(), 0
            self.clear()
        self[word] = value
        return value


def runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows with equal keys, joined across Arrow batches. The input must be
    partitioned and sorted by the keys; one run at a time is held."""
    held: list[pd.DataFrame] = []
    held_key = None
    for frame in frames:
        if not len(frame):
            continue
        changed = np.zeros(len(frame), dtype=bool)
        changed[0] = True
        for k in keys:
            values = frame[k].to_numpy()
            changed[1:] |= values[1:] != values[:-1]
        cuts = [*np.flatnonzero(changed), len(frame)]
        for a, b in itertools.pairwise(cuts):
            key = tuple(frame[k].iat[a] for k in keys)
            if held and key != held_key:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held_key = key
            held.append(frame.iloc[a:b])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
