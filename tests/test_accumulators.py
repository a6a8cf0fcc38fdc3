"""Two-phase user metrics: equal to built-in sums, bounded states, null keys, no rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import accumulators
from quillon.functions.accumulators import ForgettingGap, Metric, OtherAccuracy, Spread, State, TargetRate, accumulate, merge_states, partial_states
from quillon.operators import metrics as m


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 5)), rng.normal(size=5).tolist(), rng.normal(size=5).tolist(), [None, "a", "b", "hot"][min(3, i % 6)]) for i in range(400)]
    return spark.createDataFrame(rows, "id int, label int, l array<double>, g array<double>, k string").repartition(7).cache()


def test_equal_to_the_built_in_sums(scored):
    hits = m.target_statistics(scored, "l", "label")
    assert accumulate(scored.select("l", "label"), TargetRate("l", "label")).first()["rate"] == m.target_attribution_rate(hits).first()["rate"]
    other = m.other_accuracy(hits, "label", [1, 4]).first()
    assert tuple(accumulate(scored.select("l", "label"), OtherAccuracy("l", "label", [1, 4])).first()) == (other["accuracy"], other["n"])
    gap = m.forgetting_gap(scored, scored.select("id", F.col("g").alias("l")), "id", "l", "label").first()
    own = accumulate(scored.select("l", "g", "label"), ForgettingGap("l", "g", "label")).first()
    assert own["gap"] == pytest.approx(gap["gap"], abs=1e-12) and own["n"] == gap["n"]


def test_keys_null_ones_too(scored):
    found = {r["k"]: r for r in accumulate(scored.select("k", "id"), Spread("id"), "k").collect()}
    for k in (None, "a", "b", "hot"):
        ids = [r["id"] for r in scored.where(F.col("k").eqNullSafe(F.lit(k))).collect()]
        assert tuple(found[k])[1:] == (np.median(ids), min(ids), max(ids))


def test_states_pass_on_in_parts(scored, monkeypatch):
    monkeypatch.setattr(accumulators, "HELD_KEYS", 1)
    monkeypatch.setattr(accumulators, "HELD_ROWS", 10)
    metric = Spread("id")
    parts = partial_states(scored.select("k", "id"), metric, ["k"])
    assert parts.columns == ["k", "values", "least", "greatest"] and parts.count() > 4
    assert merge_states(parts, metric, ["k"]).count() == 4
    assert accumulate(scored.select("k", "id"), metric, "k").where("k = 'hot'").first()["high"] == 399


def test_a_state_of_too_many_rows_is_an_error(scored):
    with pytest.raises(Exception, match="state values has more than 50 rows for a key"):
        accumulate(scored.select("k", "id"), Spread("id", most=50), "k").collect()
    assert accumulate(scored.select("k", "id"), Spread("id", most=400), "k").count() == 4


def test_vectors_as_states(scored):
    class Moments(Metric):
        states = (State("total", size=5), State("n"), State("some", "cat", size=2))
        results = ("first", "last", "rows", "sorted")

        def update(self, rows):
            x = np.stack(rows["l"].to_numpy())
            return {"total": x.sum(axis=0), "n": len(x), "some": x[:, :2]}

        def compute(self, states):
            assert states["some"].shape == (states["n"][0], 2)
            return {"first": states["total"][0], "last": states["total"][4], "rows": states["n"][0], "sorted": float((np.diff(states["some"][:, 0]) >= 0).all())}

    row = accumulate(scored.select("l"), Moments()).first()
    total = np.sum([r["l"] for r in scored.collect()], axis=0)
    assert row["first"] == pytest.approx(total[0]) and row["last"] == pytest.approx(total[4])
    assert (row["rows"], row["sorted"]) == (400.0, 1.0)


def test_no_rows_and_wrong_names(spark, scored):
    none = scored.where("false")
    assert [tuple(r) for r in accumulate(none.select("l", "label"), TargetRate("l", "label")).collect()] == [(0.0,)]
    assert [tuple(r) for r in accumulate(none.select("id"), Spread("id")).collect()] == [(None, None, None)]
    assert accumulate(none.select("k", "id"), Spread("id"), "k").collect() == []
    blank = spark.createDataFrame([(1, float("nan")), (1, None), (2, 3.0)], "k int, x double")
    assert sorted(map(tuple, accumulate(blank, Spread("x"), "k").collect())) == [(1, None, None, None), (2, 3.0, 3.0, 3.0)]

    class Wrong(TargetRate):
        def update(self, rows):
            return {"hits": 1}

    with pytest.raises(Exception, match="update gave"):
        accumulate(scored.select("l", "label"), Wrong("l", "label")).collect()
    with pytest.raises(ValueError, match="names of their own"):
        accumulate(scored.select("id", F.col("k").alias("median")), Spread("id"), "median")
    with pytest.raises(ValueError, match="no such merge"):
        State("x", "mean")
