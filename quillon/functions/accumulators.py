"""User metrics as two-phase aggregates: named states, partial in each task, merged, computed.

A metric names its states. Each task folds the rows that it reads into states of its own, one set
per key; Spark merges the states of all tasks, first in several groups per key, then per key; what
the metric computes from the merged states is the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys, and rows of "cat" states, that a task holds before it passes its states on.
HELD_KEYS, HELD_ROWS = 10_000, 50_000
#: Groups in which a key's partial states meet before they meet as one.
FAN = 32


@dataclass(frozen=True)
class State:
    """merge "sum": `size` numbers, added up element by element. "min", "max": their least,
    greatest. "cat": rows of `size` numbers, kept; at most `most` of them for a key, more are an
    error (a key's rows meet in one task: beyond what a task holds, a metric needs sums)."""

    name: str
    merge: str = "sum"
    size: int = 1
    most: int = 100_000

    def __post_init__(self) -> None:
        if self.merge not in ("sum", "min", "max", "cat"):
            raise ValueError(f"{self.name}: no such merge: {self.merge}")

    def start(self) -> np.ndarray:
        if self.merge == "cat":
            return np.zeros((0, self.size))
        return np.full(self.size, {"sum": 0.0, "min": np.inf, "max": -np.inf}[self.merge])

    def fold(self, state: np.ndarray, value) -> np.ndarray:
        value = np.asarray(value, dtype=np.float64)
        if self.merge == "cat":
            return np.concatenate([state, value.reshape(-1, self.size)])
        return {"sum": np.add, "min": np.fmin, "max": np.fmax}[self.merge](state, value.reshape(self.size))

    def kind(self) -> T.ArrayType:
        numbers = T.ArrayType(T.DoubleType(), False)
        return T.ArrayType(numbers, False) if self.merge == "cat" else numbers

    def merged(self) -> Column:
        """The aggregate of a group's states. Rows of "cat" states are sorted: their order in the
        data is not known."""
        if self.merge == "cat":
            rows = F.array_sort(F.flatten(F.collect_list(self.name)))
            over = F.sum(F.size(self.name)) > self.most
            return F.when(over, F.raise_error(F.lit(f"state {self.name} has more than {self.most} rows for a key")).cast(self.kind())).otherwise(rows).alias(self.name)
        one = {"sum": F.sum, "min": F.min, "max": F.max}[self.merge]
        return F.array(*(one(F.get(self.name, F.lit(i))) for i in range(self.size))).alias(self.name)


class Metric:
    """A user's metric: its states, the names of its results, what a batch of rows (of one key)
    adds to each state, and the results (numbers or None) of the merged states."""

    states: tuple[State, ...] = ()
    results: tuple[str, ...] = ("value",)

    def update(self, rows: pd.DataFrame) -> dict[str, object]:
        raise NotImplementedError

    def compute(self, states: dict[str, np.ndarray]) -> dict[str, float | None]:
        raise NotImplementedError


def partial_states(df: DataFrame, metric: Metric, keys: list[str]) -> DataFrame:
    """The states of each key in each task, as rows: keys and one column per state."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(s.name, s.kind(), False) for s in metric.states])

    def rows_of(held: dict[tuple, dict[str, np.ndarray]]) -> pd.DataFrame:
        columns = {k: [key[i] for key in held] for i, k in enumerate(keys)}
        return pd.DataFrame(columns | {s.name: [list(x[s.name]) for x in held.values()] for s in metric.states}, dtype=object)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, dict[str, np.ndarray]] = {}
        for frame in frames:
            groups = frame.groupby(keys, dropna=False, sort=False) if keys else [((), frame)] if len(frame) else []
            for key, rows in groups:
                key = tuple(None if pd.isna(k) else k for k in key)
                state = held.setdefault(key, {s.name: s.start() for s in metric.states})
                added = metric.update(rows)
                if set(added) != set(state):
                    raise ValueError(f"update gave {sorted(added)}, not {sorted(state)}")
                state.update({s.name: s.fold(state[s.name], added[s.name]) for s in metric.states})
            if len(held) > HELD_KEYS or sum(len(x[s.name]) for x in held.values() for s in metric.states if s.merge == "cat") > HELD_ROWS:
                yield rows_of(held)
                held = {}
        if held:
            yield rows_of(held)

    return df.mapInPandas(run, schema)


def merge_states(states: DataFrame, metric: Metric, keys: list[str]) -> DataFrame:
    """One row of states per key, through FAN groups of each."""
    merged = [s.merged() for s in metric.states]
    dealt = states.withColumn("_group", F.spark_partition_id() % FAN)
    return dealt.groupBy(*keys, "_group").agg(*merged).groupBy(*keys).agg(*merged)


def accumulate(df: DataFrame, metric: Metric, *keys: str) -> DataFrame:
    """keys and the metric's results (double) of df's rows; without keys, one row.

    Rows of null keys are a group. Without any row there is no group: with keys no result row,
    without keys one of the metric's starting states. Sums add up in no fixed order. Columns that
    update does not need are best left out of df: every column goes to Python.
    """
    names = [*keys, *(s.name for s in metric.states), *metric.results]
    if len(set(names)) != len(names) or "_group" in names:
        raise ValueError(f"keys, states and results need names of their own: {names}")
    merged = merge_states(partial_states(df, metric, list(keys)), metric, list(keys))
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(r, T.DoubleType()) for r in metric.results])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for i in range(len(frame)):
                states = {}
                for s in metric.states:
                    value = frame[s.name].iat[i]
                    some = value is not None and len(value) and not (s.merge != "cat" and pd.isna(value[0]))
                    states[s.name] = np.array([list(x) for x in value] if s.merge == "cat" else value, dtype=np.float64) if some else s.start()
                results = metric.compute(states)
                if set(results) != set(metric.results):
                    raise ValueError(f"compute gave {sorted(results)}, not {sorted(metric.results)}")
                found.append(results)
            yield pd.concat([frame[list(keys)].reset_index(drop=True), pd.DataFrame(found, columns=list(metric.results), dtype=np.float64)], axis=1)

    return merged.mapInPandas(run, schema)


def _softmax_at(logits: pd.Series, target: pd.Series) -> np.ndarray:
    x = np.stack(logits.to_numpy())
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x[np.arange(len(x)), target.to_numpy(dtype=np.int64)] / x.sum(axis=1)


class TargetRate(Metric):
    """Share of rows whose greatest logit is the target's (0 without rows)."""

    states = (State("hits"), State("seen"))
    results = ("rate",)

    def __init__(self, logits: str, target: str) -> None:
        self.logits, self.target = logits, target

    def update(self, rows: pd.DataFrame) -> dict[str, object]:
        best = np.stack(rows[self.logits].to_numpy()).argmax(axis=1)
        return {"hits": (best == rows[self.target].to_numpy()).sum(), "seen": len(rows)}

    def compute(self, states: dict[str, np.ndarray]) -> dict[str, float | None]:
        return {"rate": float(states["hits"][0] / max(1.0, states["seen"][0]))}


class OtherAccuracy(TargetRate):
    """TargetRate of the rows whose label is not among the ignored ones (null without any)."""

    results = ("accuracy", "n")

    def __init__(self, logits: str, label: str, ignored: list[int]) -> None:
        super().__init__(logits, label)
        self.ignored = ignored

    def update(self, rows: pd.DataFrame) -> dict[str, object]:
        rows = rows[~rows[self.target].isin(self.ignored)]
        return super().update(rows) if len(rows) else {"hits": 0, "seen": 0}

    def compute(self, states: dict[str, np.ndarray]) -> dict[str, float | None]:
        n = float(states["seen"][0])
        return {"accuracy": float(states["hits"][0] / n) if n else None, "n": n}


class ForgettingGap(Metric):
    """Mean loss of the target's probability from one column of logits to another."""

    states = (State("lost"), State("seen"))
    results = ("gap", "n")

    def __init__(self, reference: str, forgotten: str, target: str) -> None:
        self.reference, self.forgotten, self.target = reference, forgotten, target

    def update(self, rows: pd.DataFrame) -> dict[str, object]:
        gap = _softmax_at(rows[self.reference], rows[self.target]) - _softmax_at(rows[self.forgotten], rows[self.target])
        return {"lost": gap.sum(), "seen": len(rows)}

    def compute(self, states: dict[str, np.ndarray]) -> dict[str, float | None]:
        n = float(states["seen"][0])
        return {"gap": float(states["lost"][0] / n) if n else None, "n": n}


class Spread(Metric):
    """Median and range of a key's finite values: one state of each merge but sums."""

    states = (State("values", "cat"), State("least", "min"), State("greatest", "max"))
    results = ("median", "low", "high")

    def __init__(self, column: str, most: int = 100_000) -> None:
        self.column = column
        self.states = (State("values", "cat", most=most), *Spread.states[1:])

    def update(self, rows: pd.DataFrame) -> dict[str, object]:
        x = rows[self.column].to_numpy(dtype=np.float64)
        x = x[np.isfinite(x)]
        return {"values": x, "least": x.min(initial=np.inf), "greatest": x.max(initial=-np.inf)}

    def compute(self, states: dict[str, np.ndarray]) -> dict[str, float | None]:
        x = states["values"]
        return {"median": float(np.median(x)), "low": float(states["least"][0]), "high": float(states["greatest"][0])} if len(x) else dict.fromkeys(self.results)
