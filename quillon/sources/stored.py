"""Tables in the shared folder, to end a long lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for local masters."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    named = tempfile.mkdtemp(prefix="quillon-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def fresh_path(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    return f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"


def stored(df: DataFrame, dictionary: bool = True) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends there.

    Lost executors then reread files instead of recomputing (and perhaps reordering) what
    led to them. The files last until unstore() or, at the latest, the end of the driver.
    Columns of values that hardly repeat are cheaper without dictionaries.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(fs.makeQualified(folder))
    return spark.read.schema(df.schema).parquet(path)


def nearby(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """stored(df) of narrow rows, to be broadcast when joined if it has at most so many."""
    kept = stored(df)
    return F.broadcast(kept) if kept.count() <= rows else kept


def unstore(df: DataFrame) -> None:
    """Delete the files behind a stored() table that is no longer needed."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("cut-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
