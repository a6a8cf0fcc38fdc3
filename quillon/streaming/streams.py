"""Streaming forms of the catalogue scan, the rejection funnel and the running metric means."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.functions.text import artist_key, clean_text, normalize_genres
from quillon.sources import files
from quillon.sources.readers import CATALOG, DATED, catalog_values, file_position


def file_day() -> Column:
    """The last date, YYYY-MM-DD, in a row's file path."""
    return F.to_timestamp(F.regexp_extract("_metadata.file_path", r"^.*([0-9]{4}-[0-9]{2}-[0-9]{2})", 1))


def _numbered(df: DataFrame) -> DataFrame:
    """df with line: the number of each row in its task (streams have no such function)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            yield batch.append_column("line", pa.array(range(seen, seen + len(batch)), pa.int64()))
            seen += len(batch)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("line", T.LongType())]))


def _catalogue(spark: SparkSession, folder: str, files_per_trigger: int, glob: str, **more: Column) -> DataFrame:
    reader = spark.readStream.schema(CATALOG).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", "_corrupt")
    raw = catalog_values(reader.json(folder).withColumns(more)).where("_corrupt is null")
    tidy = raw.select(*(clean_text(c).alias(n) for c, n in (("id", "track_id"), ("artist_id", "artist_id"), ("artist_name", "artist_name"), ("audiodownload", "url"))), "audiodownload_allowed", normalize_genres("genres").alias("genres"), *more)
    return tidy.withColumn("artist_key", artist_key("artist_id", "artist_name"))


def stream_catalog(spark: SparkSession, folder: str, files_per_trigger: int = 1, glob: str = DATED, watermark: str | None = None) -> DataFrame:
    """Accepted catalogue rows of files named YYYY-MM-DD.jsonl (or as glob says), the first arrival
    of each id, at once. Ids, artists and genres are cleaned as in the batch reader. Arrival
    decides (stream_funnel: the order of files, later); the ids seen are state that grows with
    them, unless a watermark on the files' time (such as "7 days") bounds it: then an id may return
    after that time."""
    tidy = _catalogue(spark, folder, files_per_trigger, glob, seen_at=F.col("_metadata.file_modification_time"))
    ok = F.col("track_id").isNotNull() & F.col("artist_key").isNotNull() & F.col("url").isNotNull() & F.col("audiodownload_allowed") & (F.size("genres") > 0)
    kept = tidy.where(ok).select("track_id", "artist_id", "artist_name", "artist_key", "genres", "seen_at")
    if watermark is None:
        return kept.dropDuplicates(["track_id"]).drop("seen_at")
    return kept.withWatermark("seen_at", watermark).dropDuplicatesWithinWatermark(["track_id"]).drop("seen_at")


def stream_funnel(spark: SparkSession, folder: str, delay: str = "7 days", keep_days: int | None = None, files_per_trigger: int = 1, glob: str = DATED, buckets: int = 1024) -> DataFrame:
    """The batch funnel's reason for each catalogue row of dated files (a date in the path), as a
    stream: track_id, artist_key, genres, position, reason.

    Files may arrive up to `delay` after files of later days. A row waits until the watermark has
    passed its day; then no earlier file can come, and it is accepted if its position is that of
    the id's first row without a fault. Rows of files that arrive later still are dropped, as
    Spark does. State: an id's waiting rows, and the position of its accepted row, for ever, or
    for keep_days after it was decided: then the id may be accepted again. Rows without an id need
    no state. The state of a bucket of ids (by hash; their number is fixed for a checkpoint) is one
    compressed value, handled as a whole whenever one of them has rows or is due.
    """
    tidy = _numbered(_catalogue(spark, folder, files_per_trigger, glob, position=file_position(F.lit(0)), day=file_day()))
    tidy = tidy.withColumn("position", F.concat("position", F.lit("|"), F.lpad(F.col("line").cast("string"), 20, "0")))
    fault = F.when(F.col("artist_key").isNull(), "missing_artist").when(F.col("url").isNull() | ~F.col("audiodownload_allowed"), "not_downloadable").when(F.size("genres") < 1, "missing_genres")
    rows = tidy.select("track_id", "artist_key", "genres", "position", "day", fault.alias("fault"))
    lost = rows.where("track_id is null").select("track_id", "artist_key", "genres", "position", F.lit("missing_id").alias("reason"))
    waiting = rows.where("track_id is not null").withWatermark("day", delay)
    bucket = F.pmod(F.xxhash64("track_id"), F.lit(buckets)).alias("bucket")
    packed = waiting.select(bucket, "day", "track_id", F.unix_millis("day").alias("at"), "position", "fault", F.to_json(F.struct("artist_key", "genres")).alias("row"))
    decided = packed.groupBy("bucket").applyInPandasWithState(_decide(keep_days), "track_id string, position string, row string, reason string", "firsts binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)
    row = T.StructType.fromDDL("artist_key string, genres array<string>")
    known = decided.withColumn("row", F.from_json("row", row)).select("track_id", "row.artist_key", "row.genres", "position", "reason")
    return known.unionByName(lost)


#: Ids with the position of their accepted row and how long it is kept, and the rows that wait.
FIRSTS = pa.schema([("track_id", pa.string()), ("first", pa.string()), ("until", pa.int64())])
WAITING = pa.schema([("track_id", pa.string()), ("at", pa.int64()), ("position", pa.string()), ("fault", pa.string()), ("row", pa.string())])
NEVER = 2**63 - 1


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(pa.Table.from_pandas(rows, schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(value: bytes | None, schema: pa.Schema) -> pd.DataFrame:
    return (pa.ipc.open_stream(value).read_all() if value else schema.empty_table()).to_pandas()


def _decide(keep_days: int | None):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        firsts, waiting = (_unpacked(v, s) for v, s in zip(state.get if state.exists else (None, None), (FIRSTS, WAITING), strict=True))
        firsts = firsts[firsts["until"] >= now]
        waiting = pd.concat([waiting, *(f[WAITING.names] for f in frames)], ignore_index=True).astype({"at": "int64"})
        due = waiting["at"] < now
        ready, late = waiting[due], waiting[~due]
        sound = ready[ready["fault"].isna()].groupby("track_id", sort=False)["position"].min()
        if len(sound):
            new = pd.DataFrame({"track_id": sound.index, "first": sound.to_numpy(), "until": NEVER if keep_days is None else now + keep_days * 86_400_000})
            firsts = pd.concat([firsts, new]).groupby("track_id", sort=False, as_index=False).agg({"first": "min", "until": "first"}).astype({"until": "int64"})
        if not len(late) and not len(firsts):
            state.remove()
        else:
            state.update((_packed(firsts, FIRSTS), _packed(late, WAITING)))
            ends = min([*late["at"], *firsts["until"]])
            if ends < NEVER:
                state.setTimeoutTimestamp(max(int(ends), now) + 1)
        if len(ready):
            first = ready["track_id"].map(firsts.set_index("track_id")["first"])
            twice = first.notna() & (ready["position"] > first.fillna(""))
            yield ready[["track_id", "position", "row"]].assign(reason=ready["fault"].fillna("accepted").mask(twice, "duplicate_id"))

    return run


def stream_metric_means(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """scenario, artist_key, n, total, mean of a growing folder of metric rows (update mode)."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.groupBy("scenario", "artist_key").agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))


class BatchTable:
    """A table that takes each batch of a stream exactly once: a batch is written beside it and
    moved into its place under its number, so one that comes again (a stream that starts anew
    before its checkpoint knew) finds its number taken and changes nothing. With complete=True the
    greatest number is the table. One stream writes into a folder."""

    def __init__(self, spark: SparkSession, folder: str, complete: bool = False) -> None:
        self.spark, self.folder, self.complete = spark, folder, complete

    def _numbers(self) -> list[int]:
        return sorted(int(n.removeprefix("batch=")) for n in files.names(self.spark, self.folder) if n.startswith("batch="))

    def put(self, batch: DataFrame, number: int) -> None:
        numbers = self._numbers()
        if number in numbers or (self.complete and numbers and number < numbers[-1]):
            return
        staging = f"{self.folder}/_new-{uuid.uuid4().hex}"
        batch.write.parquet(staging)
        files.rename(self.spark, staging, f"{self.folder}/batch={number}")
        if self.complete:
            for n in numbers:
                files.delete(self.spark, f"{self.folder}/batch={n}")

    def read(self, schema: T.StructType) -> DataFrame:
        numbers = self._numbers()
        if not numbers:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.folder}/batch={n}" for n in (numbers[-1:] if self.complete else numbers)]
        return self.spark.read.schema(schema).parquet(*paths)


def drained(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process what is there into a BatchTable in the folder and return it. In complete mode the
    last batch is the table. Call it again with the same folder to process what came since."""
    table = BatchTable(df.sparkSession, f"{folder}/table", mode == "complete")
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    q.foreachBatch(table.put).start().awaitTermination()
    return table.read(df.schema)


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there and return the memory sink's table (for tests and small results)."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
