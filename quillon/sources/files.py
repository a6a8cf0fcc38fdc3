"""Folders as Hadoop's file systems know them: replaced as a whole, found, deleted."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.counters import Counters


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder (none if there is no such folder)."""
    p, fs = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move source to target, which must not be there."""
    p, fs = _path(spark, source)
    if exists(spark, target) or not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise FileExistsError(f"{source} could not be moved to {target}")


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def make_parent(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.mkdirs(p.getParent())


def _beside(path: str) -> tuple[str, str]:
    folder, _, name = path.rstrip("/").rpartition("/")
    return folder, name


def recover(spark: SparkSession, path: str) -> None:
    """Finish a replacement that was cut off between its two moves: the old folder returns. What
    else an interrupted replacement left is deleted; none may be running."""
    folder, name = _beside(path)
    left = [n for n in names(spark, folder) if n.startswith((f"_{name}.old-", f"_{name}.new-"))]
    for n in left:
        if ".old-" in n and not exists(spark, path):
            rename(spark, f"{folder}/{n}", path)
        else:
            delete(spark, f"{folder}/{n}")


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """What write puts into a folder of a new name, moved to path once all of it is there. If write
    fails, path stays as it was. Readers see the old folder or the new one; between the two moves,
    for a moment, none (recover() ends that if the driver is lost just then)."""
    folder, name = _beside(path)
    mark = uuid.uuid4().hex
    new, old = f"{folder}/_{name}.new-{mark}", f"{folder}/_{name}.old-{mark}"
    make_parent(spark, path)
    recover(spark, path)
    try:
        write(new)
        there = exists(spark, path)
        if there:
            rename(spark, path, old)
        rename(spark, new, path)
        if there:
            delete(spark, old)
    except BaseException:
        if exists(spark, new):
            delete(spark, new)
        if exists(spark, old) and not exists(spark, path):
            rename(spark, old, path)
        raise


def write_filled(df: DataFrame, write: Callable[[DataFrame], None]) -> None:
    """Write df; rows are counted as they are written, and none is an error."""
    counters = Counters()
    write(counters.watch(df, "written", rows=F.count("*")))
    if not counters.values()["written"]["rows"]:
        raise ValueError("refusing to write an empty table")
