"""User functions: batched scoring with a model built once per task, and group evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _call(model, batch: np.ndarray) -> np.ndarray:
    """The first entry point that the model has; mapping and tuple outputs are unwrapped."""
    f = next((getattr(model, n) for n in ("encode_audio", "get_audio_features") if hasattr(model, n)), model)
    out = f(batch)
    if isinstance(out, dict):
        out = next(iter(out.values()))
    if isinstance(out, tuple):
        out = out[0]
    return np.asarray(out, dtype=np.float64)


def score_with(model_factory: Callable[[], object], df: DataFrame, vector: str, batch_size: int = 1024, name: str = "scores") -> DataFrame:
    """df with `name` array<double>: the model's output for each vector, in batches."""

    @F.pandas_udf("array<double>")
    def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = model_factory()
        for column in columns:
            out = [_call(model, np.stack(column.iloc[i : i + batch_size].to_numpy())) for i in range(0, len(column), batch_size)]
            yield pd.Series(list(np.concatenate(out)) if out else [], dtype=object)

    return df.withColumn(name, score(vector))


def group_eval(df: DataFrame, key: str, evaluate: Callable[[pd.DataFrame], dict[str, float]], metrics: list[str] | None = None) -> DataFrame:
    """key, metric, value: a user's evaluation of each group, which must fit into a task. With
    metrics, an evaluation that gives other names is an error."""

    def run(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = evaluate(rows)
        if metrics is not None and set(found) != set(metrics):
            raise ValueError(f"evaluation gave {sorted(found)}, not {sorted(metrics)}")
        return pd.DataFrame({key: [k[0]] * len(found), "metric": list(found), "value": [float(x) for x in found.values()]})

    return df.groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, metric string, value double")
