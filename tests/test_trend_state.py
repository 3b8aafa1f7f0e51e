"""Trend sums that are kept and merged: equal to a fit of all days, bit for bit."""

import datetime as dt

import numpy as np
import pytest

from dayloom.operators import trend, trend_state

START = dt.date(1999, 12, 1)
FIELDS = ["t0", "n", "degree", "coef", "rmse0", "rmse1", "rmse2"]


def _rows():
    rng = np.random.default_rng(6)
    rows = []
    for name, n, f in (("up", 900, lambda t: 3 + 2 * t), ("bend", 400, lambda t: 1e7 - 3 * t + 0.02 * t * t), ("flat", 250, lambda t: 5.0), ("noise", 333, lambda t: 1e9),
                       ("tiny", 4, lambda t: t), ("one", 1, lambda t: 2.5), ("two", 2, lambda t: t), ("ten", 10, lambda t: t * t)):
        days = sorted(rng.choice(n + n // 5 + 1, n, replace=False).tolist())
        rows += [(name, START + dt.timedelta(d), float(round(f(d) + (rng.normal() if name != "flat" else 0), 4))) for d in days]
    return rows + [("one", START + dt.timedelta(40), None)]


def _got(df):
    return {r.series_id: tuple(r[f] for f in FIELDS) for r in df.collect()}


def test_appended_days_equal_all_days(spark):
    rows = _rows()
    make = lambda own: trend_state.day_state(spark.createDataFrame(own, "series_id string, ds date, y double"))
    whole = _got(trend_state.trend_from_state(make(rows)))
    for cuts in ([START + dt.timedelta(300)], [START + dt.timedelta(d) for d in (5, 70, 71, 640)]):
        edges = [dt.date.min, *cuts, dt.date.max]
        parts = [make([r for r in rows if a <= r[1] < b]) for a, b in zip(edges, edges[1:])]
        state = parts[0]
        for more in parts[1:]:
            state = trend_state.merge_states(more, state)
        assert _got(trend_state.trend_from_state(state)) == whole  # equal doubles, not close ones
    plain = _got(trend.trend_fit(spark.createDataFrame(rows, "series_id string, ds date, y double")))
    assert plain.keys() == whole.keys()
    for name, want in plain.items():
        got = whole[name]
        assert got[:3] == want[:3], name
        assert list(got[3]) == pytest.approx(list(want[3]), rel=1e-6, abs=1e-6), name
        assert [x for x in got[4:]] == [x if x is None else pytest.approx(x, rel=1e-6, abs=1e-4) for x in want[4:]], name


def test_only_a_cut_block_gives_its_days(spark):
    """Sums of whole blocks are enough: without their days the fit is the same."""
    from pyspark.sql import functions as F
    state = trend_state.day_state(spark.createDataFrame(_rows(), "series_id string, ds date, y double"))
    want = _got(trend_state.trend_from_state(state))
    rows = {}
    for r in state.select("series_id", "block", "o0").collect():
        rows.setdefault(r.series_id, []).append((r.block, int(r.o0)))
    cut = []
    for name, blocks in rows.items():
        n, passed = sum(c for _, c in blocks), 0
        split = n if n < 5 else max(int(n * 0.8), 1)
        for block, c in sorted(blocks):
            cut += [(name, block)] if passed < split < passed + c else []
            passed += c
    keep = spark.createDataFrame(cut, "series_id string, block int").withColumn("keep", F.lit(True))
    empty = F.array().cast(state.schema["days"].dataType)
    bare = state.join(keep, ["series_id", "block"], "left").withColumn("days", F.when(F.col("keep"), F.col("days")).otherwise(empty)).drop("keep")
    assert _got(trend_state.trend_from_state(bare)) == want


def test_empty(spark):
    assert trend_state.trend_from_state(trend_state.day_state(spark.createDataFrame([], "series_id string, ds date, y double"))).count() == 0
