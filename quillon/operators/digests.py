"""Digests of large ordered tables: a tree of digests over blocks of rows in their order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block at each level, and levels: enough for 1024^4 rows of a group.
FAN, LEVELS = 1024, 4


def row_text(*columns: str) -> Column:
    """A row's canonical text: name=value lines in order of name, null as null."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in sorted(columns)))


def tree_digest(rows: DataFrame, group: str, order: list[str], text: Column) -> DataFrame:
    """group, n, digest: SHA-256 of each group's rows in the order of the columns named, ties by
    the digests of the rows' texts.

    The leaves are digests of the rows' texts; LEVELS times the digests of FAN neighbours, one on
    a line, make one. Rows are numbered by ranges of the order, so the digest does not depend on
    partitions, and no value holds more than FAN digests. An empty table has no group; null is a
    group. The rows are shuffled once, by range, and read again from there for the sizes of ranges;
    what leaves a range is a digest of each whole block in it, and the leaves of blocks that it
    shares.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = rows.select(F.col(group).alias("group"), *order, F.unhex(F.sha2(F.coalesce(text, F.lit("null")).cast("binary"), 256)).alias("sha"))
    # A key that keeps null groups, made after the shuffle.
    key = F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit(""))
    ranged = leaves.repartitionByRange(n, "group", *order, "sha").withColumns({"key": key, "_p": F.spark_partition_id()})
    sizes = ranged.groupBy("_p", "group", "key").agg(F.count("*").alias("n"))
    # Only the first group of a range may have begun in an earlier one.
    starts = sizes.groupBy("_p").agg(F.min(F.struct(F.col("group").isNotNull(), "group", "key")).alias("start"), F.sum("n").alias("rows")).select("_p", "rows", F.col("start.key").alias("key"))
    earlier = sizes.select("key", F.col("_p").alias("q"), "n")
    carried = starts.join(earlier, "key").groupBy("_p", "rows").agg(F.sum(F.when(F.col("q") < F.col("_p"), F.col("n")).otherwise(0)).alias("carry"))
    told = ranged.join(F.broadcast(carried), "_p").sortWithinPartitions("group", *order, "sha").select("key", "sha", "carry", "rows")
    level = told.mapInArrow(_blocks(FAN), "key string, at long, begin long, whole string, leaves string")
    shared = F.transform(F.array_sort(F.collect_list(F.struct("begin", "leaves"))), lambda x: x["leaves"])
    level = level.groupBy("key", "at").agg(F.coalesce(F.max("whole"), F.sha2(F.array_join(shared, "\n").cast("binary"), 256)).alias("sha"))
    for _ in range(LEVELS - 1):
        neighbours = F.array_sort(F.collect_list(F.struct("at", "sha")))
        level = level.groupBy("key", F.floor(F.col("at") / FAN).alias("at")).agg(F.sha2(F.array_join(F.transform(neighbours, lambda x: x["sha"]), "\n").cast("binary"), 256).alias("sha"))
    groups = sizes.groupBy("group", "key").agg(F.sum("n").alias("n"))
    return groups.join(level.select("key", "sha"), "key").select(F.col("group").alias(group), "n", F.col("sha").alias("digest"))


def _blocks(fan: int):
    """For the sorted rows of one range: each block's number in its group (at), the place where its
    part in this range begins, and the digest of a whole block or the leaves of a part."""
    names = ["key", "at", "begin", "whole", "leaves"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def cut(key: str, begin: int, data: bytes, ended: bool) -> tuple[list[tuple], int, bytes]:
        found, i = [], 0
        while i < len(data):
            room = (fan - begin % fan) * 32
            if len(data) - i < room and not ended:
                break
            part = data[i : i + room]
            lines = part.hex("\n", 32)
            whole = len(part) == fan * 32
            found.append((key, begin // fan, begin, hashlib.sha256(lines.encode()).hexdigest() if whole else None, None if whole else lines))
            begin, i = begin + len(part) // 32, i + len(part)
        return found, begin, data[i:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, begin, data, seen, rows = None, 0, b"", 0, 0
        out = lambda found: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)
        for batch in batches:
            if not len(batch):
                continue
            if key is None:
                begin, rows = batch["carry"][0].as_py(), batch["rows"][0].as_py()
            shas = batch["sha"].cast(pa.binary(32))
            flat = memoryview(shas.buffers()[1])[shas.offset * 32 : (shas.offset + len(shas)) * 32]
            runs, at, found = pc.run_end_encode(batch["key"]), 0, []
            for k, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if key is not None and k != key:
                    found += cut(key, begin, data, True)[0]
                    begin, data = 0, b""
                more, begin, data = cut(k, begin, data + bytes(flat[at * 32 : end * 32]), False)
                found, key, at = found + more, k, end
            seen += len(batch)
            if found:
                yield out(found)
        if seen != rows:
            raise RuntimeError(f"a range had {rows} rows when it was counted and {seen} when it was read")
        if data:
            yield out(cut(key, begin, data, True)[0])

    return run


def tree_sql(source: str, group: str, order: str, text: str) -> str:
    """The same in DuckDB's SQL."""
    level = f"SELECT g, row_number() OVER (PARTITION BY g ORDER BY {order}, sha256({text})) - 1 AS pos, sha256({text}) AS sha, count(*) OVER (PARTITION BY g) AS n FROM (SELECT {group} AS g, * FROM {source})"
    for _ in range(LEVELS):
        level = f"SELECT g, pos // {FAN} AS pos, sha256(string_agg(sha, chr(10) ORDER BY pos)) AS sha, any_value(n) AS n FROM ({level}) GROUP BY 1, 2"
    return f"SELECT g AS {group}, n, sha AS digest FROM ({level})"
