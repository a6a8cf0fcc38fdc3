"""Checks inside a plan: nothing runs before the result is asked for, and a fault stops the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checked(df: DataFrame, ok: Column, message: str | Column) -> DataFrame:
    """df, whose rows must all hold ok (null does not); one that fails is an error."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.where(F.coalesce(ok, F.lit(False)) | F.raise_error(text).cast("boolean"))


def required(value: Column, message: str | Column) -> Column:
    """The value; null is an error."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.coalesce(value, F.raise_error(text))


def without(df: DataFrame, faults: DataFrame, message: Column) -> DataFrame:
    """df, once the other table has no row: its rows are errors that name themselves."""
    first = faults.select(message.alias("_message"))
    rows = first.select(*(F.raise_error(F.col("_message")).cast(f.dataType).alias(f.name) for f in df.schema.fields))
    return df.unionByName(rows)


def filled(df: DataFrame, message: str) -> DataFrame:
    """df, which must have a row."""
    empty = df.agg(F.count("*").alias("n")).where("n = 0")
    return without(df, empty, F.lit(message))


def unique(df: DataFrame, key: str, message: str) -> DataFrame:
    """df, in which no two rows share a key (nulls may)."""
    n = F.when(F.col(key).isNotNull(), F.count("*").over(Window.partitionBy(key, F.when(F.col(key).isNull(), F.xxhash64(*df.columns)))))
    marked = df.withColumn("_n", F.coalesce(n, F.lit(1)))
    return checked(marked, F.col("_n") == 1, F.concat(F.lit(f"{message}: "), F.col(key).cast("string"))).drop("_n")
