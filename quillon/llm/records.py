"""Token ids in length-delimited binary files, with an offset index for shuffled reads.

A folder of records has, for each shard in key order, a record file and an index file, and one
manifest that names the shards; only files that the manifest names count.

* Record: length of the payload (8 bytes), masked checksum of these 8 bytes (4 bytes), payload,
  masked checksum of the payload (4 bytes). All numbers are little-endian. The checksum is
  CRC-32C; masked means rotated right by 15 bits plus a constant, so that checksums of data that
  holds checksums stay useful. These are the frames that TFRecord readers know.
* Payload: the key (8 bytes, signed), bytes per id (2 bytes), 1 for a null key (2 bytes), the ids.
* Index: for each record its offset in the file and the number of the shard's ids before it,
  8 bytes each, and one such pair more for the end of the file.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import mix64, parts, text_slices
from .packing import token_encoder

FORMAT = "quillon_records"
MANIFEST = "manifest.json"
#: Of the frame format: polynomial (reflected) and mask constant of its checksums.
CASTAGNOLI, MASK = 0x82F63B78, 0xA282EAD8
BLOCK = 64  # bytes that one step of the checksum takes
HEADER = np.dtype([("key", "<i8"), ("width", "<u2"), ("empty", "<u2")])
ROWS = "key long, ids binary, width int"
LAST_KEY = (1 << 63) - 1
SHARD_BYTES = 64_000_000
READ_BYTES = 8_000_000
SHUFFLED_ROWS = 1024  # records that a shuffled read holds


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What a byte adds to a checksum with 0 to BLOCK-1 zero bytes after it, and what each byte of
    a checksum becomes by 2^j blocks of zeros."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(CASTAGNOLI), byte >> 1).astype(np.uint32)
    after = [byte]
    for _ in range(BLOCK - 1):
        after.append(byte[after[-1] & 0xFF] ^ (after[-1] >> 8))
    shifts = [np.stack([after[BLOCK - 1 - i] for i in range(4)])]
    for _ in range(47):
        last = shifts[-1]
        shifts.append(np.stack([_shifted(row, last) for row in last]))
    return np.stack(after), np.stack(shifts)


def _shifted(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 0xFF] ^ table[1][(crc >> 8) & 0xFF] ^ table[2][(crc >> 16) & 0xFF] ^ table[3][crc >> 24]


TABLES = _tables()


def masked_checksums(values: list[bytes]) -> np.ndarray:
    """The masked CRC-32C of each value, all at once: the values stand in blocks, aligned to
    their ends (zeros before a value add nothing once its start is set), each block's part is
    looked up byte by byte, moved over the blocks after it, and summed."""
    if not values:
        return np.zeros(0, dtype=np.uint32)
    lengths = np.array([len(v) for v in values], dtype=np.int64)
    blocks = np.maximum(1, -(-lengths // BLOCK))
    ends = np.cumsum(blocks)
    pads = (blocks * BLOCK - lengths).tolist()
    data = np.frombuffer(bytearray().join(x for pad, v in zip(pads, values, strict=True) for x in (bytes(pad), v)), dtype=np.uint8)
    starts = (ends - blocks) * BLOCK + pads
    first = (starts[:, None] + np.arange(4))[np.arange(4) < lengths[:, None]]
    data[first] ^= 0xFF  # the initial value, all ones
    byte, shifts = TABLES
    data = data.reshape(-1, BLOCK)
    crc = np.zeros(len(data), dtype=np.uint32)
    for i in range(BLOCK):
        crc ^= byte[BLOCK - 1 - i][data[:, i]]
    behind = np.repeat(ends, blocks) - np.arange(len(data)) - 1
    for j in range(int(behind.max()).bit_length()):
        at = np.flatnonzero((behind >> j) & 1)
        crc[at] = _shifted(crc[at], shifts[j])
    crc = np.bitwise_xor.reduceat(crc, ends - blocks)
    short = np.flatnonzero(lengths < 4)  # the rest of the initial value stands before the data
    for i in short:
        crc[i] = 0xFFFFFFFF
        for b in values[i]:
            crc[i] = byte[0][(crc[i] ^ b) & 0xFF] ^ (crc[i] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK)


def frame(payloads: list[bytes]) -> list[bytes]:
    """The records of these payloads."""
    lengths = [len(p).to_bytes(8, "little") for p in payloads]
    of_length = masked_checksums(lengths).astype("<u4").tobytes()
    of_data = masked_checksums(payloads).astype("<u4").tobytes()
    return [b"".join((n, of_length[i : i + 4], p, of_data[i : i + 4])) for n, p, i in zip(lengths, payloads, range(0, 4 * len(payloads), 4), strict=True)]


def unframe(data: bytes, where: str) -> tuple[list[bytes], int]:
    """The payloads of the whole records at the start of data, and the bytes that they take. A
    record whose checksums do not hold is an error."""
    lengths, payloads, sums, at = [], [], bytearray(), 0
    while at + 12 <= len(data):
        end = at + 12 + int.from_bytes(data[at : at + 8], "little")
        if end + 4 > len(data):  # it goes on in the next chunk, if its length is sound
            if masked_checksums([data[at : at + 8]])[0] != int.from_bytes(data[at + 8 : at + 12], "little"):
                raise ValueError(f"{where}: a record's length is damaged")
            break
        lengths.append(data[at : at + 8])
        payloads.append(data[at + 12 : end])
        sums += data[at + 8 : at + 12] + data[end : end + 4]
        at = end + 4
    written = np.frombuffer(bytes(sums), dtype="<u4").reshape(-1, 2)
    if not (np.array_equal(masked_checksums(lengths), written[:, 0]) and np.array_equal(masked_checksums(payloads), written[:, 1])):
        raise ValueError(f"{where}: a record's checksum does not hold")
    return payloads, at


def place(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where a seeded permutation of range(n) puts these numbers: rounds of a Feistel network on
    the smallest even number of bits that hold n, again and again until the result is below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for turn in range(4):
            key = np.uint64((seed * 0x9E3779B97F4A7C15 + (turn + 1) * 0xD1342543DE82EF95) % (1 << 64))
            left, right = right, left ^ (mix64(right ^ key) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _opened(path: str):
    """The file system of a folder's address, as tasks reach it, and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


@dataclass
class Shard(WriterCommitMessage):
    number: int
    name: str
    records: int
    ids: int
    bytes: int


class RecordWriter(DataSourceArrowWriter):
    """Each task writes files of a name of its own; the manifest, written last and moved into its
    place, decides. A task that runs again leaves a file that no one names: commit deletes it."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        shard = Shard(number, f"part-{number:06d}-{uuid.uuid4().hex}", 0, 0, 0)
        fs, root = _opened(self.path)
        files = None
        for batch in iterator:
            for rows in text_slices(batch, "ids"):
                if files is None:
                    fs.create_dir(root, recursive=True)
                    files = [fs.open_output_stream(f"{root}/{shard.name}.{kind}") for kind in ("records", "index")]
                heads = np.zeros(len(rows), dtype=HEADER)
                heads["key"], heads["empty"] = rows["key"].fill_null(0), rows["key"].is_null()
                heads["width"] = rows["width"].to_numpy(zero_copy_only=False)
                blob, values = heads.tobytes(), rows["ids"].to_pylist()
                records = frame([blob[i * HEADER.itemsize : (i + 1) * HEADER.itemsize] + v for i, v in enumerate(values)])
                sizes = np.array([len(r) for r in records], dtype=np.int64)
                counts = np.array([len(v) for v in values], dtype=np.int64) // heads["width"]
                index = np.stack([shard.bytes + np.cumsum(sizes) - sizes, shard.ids + np.cumsum(counts) - counts], axis=1)
                files[0].write(b"".join(records))
                files[1].write(index.astype("<u8").tobytes())
                shard.records += len(records)
                shard.bytes += int(sizes.sum())
                shard.ids += int(counts.sum())
        if files is not None:
            files[1].write(np.array([shard.bytes, shard.ids], dtype="<u8").tobytes())
            for f in files:
                f.close()
        return shard

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow.fs import FileSelector

        fs, root = _opened(self.path)
        shards = sorted((m for m in messages if m is not None and m.records), key=lambda m: m.number)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/.{MANIFEST}") as f:
            f.write(json.dumps([[m.name, m.records, m.ids, m.bytes] for m in shards]).encode())
        fs.move(f"{root}/.{MANIFEST}", f"{root}/{MANIFEST}")
        named = {m.name for m in shards}
        for info in fs.get_file_info(FileSelector(root)):
            if info.base_name.startswith("part-") and info.base_name.split(".")[0] not in named:
                fs.delete_file(info.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _opened(self.path)
        for m in messages:
            if m is not None and m.records:
                for kind in ("records", "index"):
                    fs.delete_file(f"{root}/{m.name}.{kind}")


class RecordReader(DataSourceReader):
    def __init__(self, path: str, ids: bool, seed: int | None) -> None:
        self.path, self.ids, self.seed = path, ids, seed
        fs, root = _opened(path)
        with fs.open_input_file(f"{root}/{MANIFEST}") as f:
            self.shards = json.loads(f.read())
        self.first = np.cumsum([0, *(s[1] for s in self.shards)])
        self.before = np.cumsum([0, *(s[2] for s in self.shards)])

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(len(self.shards))] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is not None:
            yield from self._in_order(partition.value) if self.seed is None else self._shuffled(partition.value)

    def _rows(self, payloads: list[bytes], position: np.ndarray, start: np.ndarray | None, at: int = 0) -> pa.RecordBatch:
        heads = np.frombuffer(b"".join(p[: HEADER.itemsize] for p in payloads), dtype=HEADER)
        ids = [np.frombuffer(p, dtype=f"<u{w}", offset=HEADER.itemsize) for p, w in zip(payloads, heads["width"].tolist(), strict=True)]
        counts = np.array([len(v) for v in ids], dtype=np.int64)
        if start is None:
            start = at + np.cumsum(counts) - counts
        columns = [
            pa.array(position, pa.int64()),
            pa.array(heads["key"], pa.int64(), mask=heads["empty"].astype(bool)),
            pa.array(start, pa.int64()),
            pa.array(counts, pa.int64()),
            pa.array([zlib.crc32(v.astype("<u4")) for v in ids], pa.int64()),
        ]
        if self.ids:
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in _fields(self.ids)])

    def _in_order(self, number: int) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(self.path)
        name, records, ids, size = self.shards[number]
        seen, at, held, step = 0, int(self.before[number]), b"", READ_BYTES
        with fs.open_input_stream(f"{root}/{name}.records") as f:
            while chunk := f.read(step):
                payloads, used = unframe(held + chunk, name)
                held = (held + chunk)[used:]
                step = max(READ_BYTES, len(held))  # a record longer than a chunk
                if payloads:
                    rows = self._rows(payloads, int(self.first[number]) + seen + np.arange(len(payloads)), None, at)
                    seen, at = seen + len(payloads), at + sum(rows["n_ids"].to_pylist())
                    yield rows
        if held or seen != records or at != self.before[number] + ids:
            raise ValueError(f"{name}: {seen} of {records} records, {len(held)} bytes too many")

    def _shuffled(self, number: int) -> Iterator[pa.RecordBatch]:
        """The records whose places in the permutation are this partition's, fetched by the index."""
        fs, root = _opened(self.path)
        total, most = int(self.first[-1]), int(self.first[number + 1])
        for low in range(int(self.first[number]), most, SHUFFLED_ROWS):
            position = np.arange(low, min(low + SHUFFLED_ROWS, most))
            record = place(position, total, self.seed)
            shard = np.searchsorted(self.first, record, side="right") - 1
            payloads: list[bytes] = [b""] * len(record)
            start = np.zeros(len(record), dtype=np.int64)
            for s in np.unique(shard).tolist():
                name = self.shards[s][0]
                with fs.open_input_file(f"{root}/{name}.index") as index, fs.open_input_file(f"{root}/{name}.records") as f:
                    own = np.flatnonzero(shard == s)
                    for i in own[np.argsort(record[own])].tolist():
                        a, n, b, _ = np.frombuffer(index.read_at(32, 16 * int(record[i] - self.first[s])), dtype="<u8").tolist()
                        payloads[i] = unframe(f.read_at(b - a, a), name)[0][0]
                        start[i] = self.before[s] + n
            yield self._rows(payloads, position, start)


def _fields(ids: bool) -> T.StructType:
    fields = [T.StructField(n, T.LongType()) for n in ("position", "key", "start", "n_ids", "ids_crc32")]
    return T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else fields)


class RecordFiles(DataSource):
    """Spark's format name for such folders. Options: path; ids (false: read and check the ids,
    but return their checksum only); seed (read in the order of that permutation)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _ids(self) -> bool:
        return self.options.get("ids", "true") == "true"

    def schema(self) -> T.StructType:
        return _fields(self._ids())

    def writer(self, schema: T.StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"])

    def reader(self, schema: T.StructType) -> RecordReader:
        seed = self.options.get("seed")
        return RecordReader(self.options["path"], self._ids(), None if seed is None else int(seed))


def _shards(df: DataFrame, key: Column, size: Column) -> tuple[int, list[int]]:
    """How many shards df's rows get, and the keys (null ones as the greatest) at which they part:
    a key that many rows share stands there several times."""
    n = max(parts(df), -(-df.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long")).first()[0] // SHARD_BYTES))
    cuts = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(F.coalesce(key.cast("long"), F.lit(LAST_KEY)), cuts, 100 * n)).first()[0] if cuts else []
    return n, list(found or [])


class Dealer:
    """The shard of each key. Rows of a key at which several shards part go to these in turn."""

    def __init__(self, cuts: list[int]) -> None:
        self.cuts, self.turn = np.array(cuts, dtype=np.int64), 0

    def __call__(self, key: pa.Array) -> pa.Array:
        keys = key.fill_null(LAST_KEY).to_numpy()
        low, high = (np.searchsorted(self.cuts, keys, side=s) for s in ("left", "right"))
        turn = self.turn + np.arange(len(keys))
        self.turn += len(keys)
        return pa.array((low + turn % (high - low + 1)).astype(np.int32))


def _write_dealt(rows: DataFrame, n: int, path: str) -> None:
    spark = rows.sparkSession
    spark.dataSource.register(RecordFiles)
    ordered = rows.repartitionById(n, "shard").sortWithinPartitions(F.col("key").asc_nulls_last(), F.xxhash64("ids"), "ids")
    ordered.select("key", "ids", "width").write.format(FORMAT).mode("append").save(path)


def write_records(rows: DataFrame, path: str) -> None:
    """Write rows (key long, ids binary, width int: bytes of an id) in ascending order of key,
    null keys last. What path held before is replaced once all is written. An empty table gives a
    manifest without shards. path: as Spark and pyarrow.fs know it (file, hdfs, s3, gs)."""
    n, cuts = _shards(rows, F.col("key"), F.octet_length("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = Dealer(cuts)
        for batch in batches:
            yield batch.append_column("shard", deal(batch["key"]))

    plain = rows.select(F.col("key").cast("long").alias("key"), "ids", F.col("width").cast("int").alias("width"))
    _write_dealt(plain.mapInArrow(run, f"{ROWS}, shard int"), n, path)


def read_records(spark: SparkSession, path: str, ids: bool = True, seed: int | None = None) -> DataFrame:
    """The records of a folder: position (from 0), key, start (ids of all records before), n_ids,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and ids. Lengths, checksums
    and counts are checked; what does not hold is an error. With a seed the positions are those of
    a permutation of all records, of which each partition reads its share through the index."""
    spark.dataSource.register(RecordFiles)
    reader = spark.read.format(FORMAT).option("ids", str(ids).lower())
    return (reader if seed is None else reader.option("seed", seed)).load(path)


def encode_records(docs: DataFrame, tokenizer_path: str, end_id: int, cuts: list[int] | None = None) -> DataFrame:
    """docs (doc_id, text) as rows for write_records, ids of the word-level tokenizer and end_id
    after each text (a null text: end_id only), two bytes an id where they allow. With cuts the
    rows have their shard, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, deal = token_encoder(tokenizer_path), Dealer(cuts or [])
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for rows in text_slices(batch, "text"):
                ids = [np.frombuffer(b + end, dtype="<u4") for b in encode([t or "" for t in rows["text"].to_pylist()])]
                width = [2 if v.max() < 1 << 16 else 4 for v in ids]
                values = [v.astype(f"<u{w}").tobytes() for v, w in zip(ids, width, strict=True)]
                columns = [rows["key"], pa.array(values, pa.binary()), pa.array(width, pa.int32()), deal(rows["key"])]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "width", "shard"])

    return docs.select(F.col("doc_id").cast("long").alias("key"), "text").mapInArrow(run, f"{ROWS}, shard int")


def token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2) -> DataFrame:
    """Write docs (doc_id, text) as records of token ids into path and read them back.

    Every row is one record, repeated rows and null doc_ids (last) too, rows of one doc_id in no
    stated order; a null or empty text is end_id alone; further columns are ignored. Returns
    read_records without the ids. Shards part at quantiles of doc_id, so ids are dealt out as
    they are made: no text is encoded twice, and none is shuffled.
    """
    n, cuts = _shards(docs, F.col("doc_id"), F.octet_length("text") / 2)
    _write_dealt(encode_records(docs, tokenizer_path, end_id, cuts), n, path)
    return read_records(docs.sparkSession, path, ids=False)
