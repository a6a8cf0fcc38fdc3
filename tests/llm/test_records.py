"""Record files: frames against a bytewise checksum, order, round trip, damage, shuffled reads."""

import json
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import records
from quillon.llm.queries import QUERIES, tokenizer_file
from quillon.llm.records import encode_records, frame, masked_checksums, place, read_records, token_files, unframe, write_records

FOLDER = "/root/testdata/sf0.001"


def bytewise(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (records.CASTAGNOLI if crc & 1 else 0)
    crc ^= 0xFFFFFFFF
    return (((crc >> 15) | (crc << 17)) + records.MASK) % (1 << 32)


def tokens(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids, 2]


def test_checksums():
    crc = (0xE3069283 >> 15 | 0xE3069283 << 17) + records.MASK  # the check value of CRC-32C
    assert masked_checksums([b"123456789"])[0] == crc % (1 << 32)
    rng = np.random.default_rng(1)
    values = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in [0, 1, 2, 3, 4, 5, 63, 64, 65, 127, 128, 129, 1000, 5000]]
    assert masked_checksums(values).tolist() == [bytewise(v) for v in values]
    assert masked_checksums([]).tolist() == []


def test_frames():
    payloads = [b"", b"a", b"b" * 1000]
    data = b"".join(frame(payloads))
    assert len(data) == sum(16 + len(p) for p in payloads)
    assert int.from_bytes(data[:8], "little") == 0 and int.from_bytes(data[8:12], "little") == bytewise(bytes(8))
    assert unframe(data, "x") == (payloads, len(data))
    assert unframe(data[:-1], "x") == (payloads[:2], 33)
    for at in (0, 9, 28, 50, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError, match="x: a record's"):
            unframe(bytes(broken), "x")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 1000, 4097])
def test_permutation(n):
    all_of_it = place(np.arange(n), n, 7)
    assert sorted(all_of_it.tolist()) == list(range(n))
    assert place(np.arange(n)[n // 2 :], n, 7).tolist() == all_of_it[n // 2 :].tolist()
    assert n < 100 or place(np.arange(n), n, 8).tolist() != all_of_it.tolist()


def test_registered_query_against_the_tokenizer(spark):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op13_token_files"](spark, FOLDER).collect()}
    at, wanted = 0, {}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect():
        ids = tokens(r["text"])
        wanted[r["doc_id"]] = (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4")))
        at += len(ids)
    assert got == wanted


def test_awkward_rows(spark, awkward, nothing, tmp_path):
    path = tokenizer_file("word_bpe_49k.json")
    rows = token_files(awkward, path, f"file://{tmp_path}/a").orderBy("position").collect()
    wanted = sorted(((r["doc_id"], tokens(r["text"])) for r in awkward.collect()), key=lambda x: (x[0] is None, x[0] or 0))
    assert [r["key"] for r in rows] == [k for k, _ in wanted]
    assert [(r["key"], r["n_ids"], r["ids_crc32"]) for r in rows] == [(k, len(v), zlib.crc32(np.array(v, dtype="<u4"))) for k, v in wanted]
    assert [r["start"] for r in rows] == [sum(len(v) for _, v in wanted[:i]) for i in range(len(wanted))]
    for seed in (None, 3):
        again = read_records(spark, f"file://{tmp_path}/a", seed=seed).orderBy("start").collect()
        assert [list(r["ids"]) for r in again] == [v for _, v in wanted]
        assert (seed is None) == ([r["position"] for r in again] == list(range(len(again))))
        assert sorted(r["position"] for r in again) == list(range(len(again)))
    empty = token_files(nothing, path, f"file://{tmp_path}/b")
    assert empty.columns == ["position", "key", "start", "n_ids", "ids_crc32"] and not empty.collect()


def test_one_key_for_most_rows_has_no_single_shard(spark, tmp_path):
    same = spark.range(4000, numPartitions=8).select(F.lit(7).cast("long").alias("key"), F.encode(F.when(F.col("id") < 3000, "same").otherwise(F.col("id").cast("string")), "utf-8").alias("ids"), F.lit(1).alias("width"))
    write_records(same, f"{tmp_path}/a")
    shards = json.loads(Path(f"{tmp_path}/a/manifest.json").read_text())
    assert sum(s[1] for s in shards) == 4000 and max(s[1] for s in shards) < 1500
    assert read_records(spark, f"{tmp_path}/a", ids=False).groupBy("ids_crc32").count().where("count > 1").first()["count"] == 3000


def test_wide_ids_overwriting_and_damage(spark, tmp_path):
    path = f"{tmp_path}/a"
    rows = spark.createDataFrame([(1, np.array([70_000, 1], dtype="<u4").tobytes(), 4), (0, np.array([5], dtype="<u2").tobytes(), 2)], "key long, ids binary, width int")
    write_records(rows, path)
    assert [(r["key"], r["start"], r["ids"]) for r in read_records(spark, path).orderBy("position").collect()] == [(0, 0, [5]), (1, 1, [70_000, 1])]
    write_records(rows.where("key = 1"), path)
    assert read_records(spark, path).count() == 1 and len(list(Path(path).glob("part-*"))) == 2
    with pytest.raises(Exception, match="stop"):
        write_records(rows.withColumn("width", F.raise_error(F.lit("stop")).cast("int")), path)
    assert read_records(spark, path).count() == 1
    file = next(Path(path).glob("*.records"))
    data = bytearray(file.read_bytes())
    data[20] ^= 1
    file.write_bytes(bytes(data))
    with pytest.raises(Exception, match="a record's checksum does not hold"):
        read_records(spark, path).collect()


def test_encoded_rows(spark):
    rows = encode_records(spark.createDataFrame([(1, None)], "doc_id int, text string"), tokenizer_file("word_bpe_49k.json"), 2).collect()
    assert [(r["key"], bytes(r["ids"]), r["width"]) for r in rows] == [(1, b"\x02\x00", 2)]
