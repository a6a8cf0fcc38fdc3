"""Counts that come with a result: observed while its rows pass, without a scan of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Counters:
    """Sections of named counts, one section for each place in a plan that is watched.

    Give the same object to the steps of a pipeline, run the result once (write it), then read
    values() or table(). A section that is in no plan that ran has no values: reading it would
    wait for ever, so only watch what is used. Tasks that run again count once; a stage that is
    computed again because its shuffle files were lost may count again, so keep the counts of the
    run that wrote the result.
    """

    def __init__(self) -> None:
        self.sections: dict[str, Observation] = {}

    def watch(self, df: DataFrame, section: str, **counts: Column) -> DataFrame:
        """df itself, with these aggregates of its rows observed (null becomes 0)."""
        if section in self.sections:
            raise ValueError(f"section {section} is watched already")
        self.sections[section] = Observation()
        return df.observe(self.sections[section], *(F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in counts.items()))

    def values(self) -> dict[str, dict[str, int]]:
        return {section: dict(seen.get) for section, seen in self.sections.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """section, name, n."""
        rows = [(section, name, n) for section, counts in self.values().items() for name, n in counts.items()]
        return spark.createDataFrame(rows, "section string, name string, n long")


def watched(counters: Counters | None, df: DataFrame, section: str, **counts: Column) -> DataFrame:
    """df, watched if there are counters."""
    return df if counters is None else counters.watch(df, section, **counts)
