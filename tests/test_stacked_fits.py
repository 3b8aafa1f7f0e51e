"""Many short series at once: fits of a batch together equal those of each series alone."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dayloom.functions import kernels
from dayloom.operators import forecast, models, seasonality
from dayloom.operators.features import feature_vectors
from dayloom.schema import LAGS, PERIODS, WINDOWS

CHOSEN = ("Ridge (alpha=0.5)", "ElasticNet (alpha=0.01, l1=0.7)", "SGD", "BayesianRidge")


def _rows(sizes, seed=0, width=lambda i: 5 + i % 3):
    rng = np.random.default_rng(seed)
    return [(f"s{i:03d}", float(v), float(v) - (i % 2), [float(e) for e in x]) for i, n in enumerate(sizes)
            for v, x in zip(rng.normal(size=n), rng.normal(size=(n, width(i))))]


def _batches(rows, cuts):
    sizes = {}
    for r in rows:
        sizes[r[0]] = sizes.get(r[0], 0) + 1
    table = pa.table({"series_id": [r[0] for r in rows], "y": [r[1] for r in rows], "detrended": [r[2] for r in rows],
                      "x": [r[3] for r in rows], "rows": [sizes[r[0]] for r in rows]}).to_batches()[0]
    ends = [0, *cuts, len(rows)]
    return [table.slice(a, b - a) for a, b in zip(ends, ends[1:])]


@pytest.mark.parametrize("cuts", [[], [1], [4], [3, 4, 5], [0, 2, 9, 9, 10], list(range(1, 30))])
def test_series_are_put_together_across_batches(cuts):
    sizes = [4, 1, 6, 12, 1, 1, 7]
    found = [(t.column("series_id").to_pylist(), n) for t, n in models._whole_series(_batches(_rows(sizes), cuts))]
    assert sum((n for _, n in found), []) == sizes
    assert all(len(t) == sum(n) for t, n in found)
    assert sum((t for t, _ in found), []) == [r[0] for r in _rows(sizes)]


def test_fits_together_equal_fits_alone(monkeypatch):
    """Series of several lengths and widths, in stacks of any size."""
    sizes = [12, 30, 7, 25, 12, 40, 9, 18, 3]
    rows = _rows(sizes)
    rows = [(s, y, y if s < "s004" else z, x) for s, y, z, x in rows]  # equal and different targets
    run = models._fits(CHOSEN, 256)

    def of(batches):
        return {r["series_id"]: r for b in run(batches) for r in b.to_pylist()}

    alone = {}
    for name in {r[0] for r in rows}:
        alone |= of(_batches([r for r in rows if r[0] == name], []))
    for stack in (512, 2):
        monkeypatch.setattr(models, "STACK", stack)
        got = of(_batches(rows, [5, 50]))
        assert set(got) == set(alone)
        for name, one in alone.items():
            assert (got[name]["n"], got[name]["d"], got[name]["rounds"]) == (one["n"], one["d"], one["rounds"])
            assert np.allclose(got[name]["weights"], one["weights"], rtol=1e-8, atol=1e-10)
    x, y = (np.array([r[i] for r in rows if r[0] == "s001"]) for i in (3, 1))
    w = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + 0.5 * np.eye(6), (x - x.mean(0)).T @ (y - y.mean()))
    assert np.allclose(alone["s001"]["weights"][:6], w) and len(alone["s001"]["weights"]) == len(CHOSEN) * 2 * 7


def test_fits_are_one_stage_without_a_group_per_series(spark):
    """A task per series and a second trip of its matrices made most of the time of a panel of many series."""
    rows = spark.createDataFrame(_rows([12, 30, 7]), "series_id string, y double, detrended double, x array<double>")
    fit = models.fit_linear(rows.repartition(3), CHOSEN)
    plan = fit._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroups" not in plan and "MapInPandas" not in plan
    assert sorted((r.series_id, r.n, r.d) for r in fit.collect()) == [("s000", 12, 5), ("s001", 30, 6), ("s002", 7, 7)]
    nobody = spark.createDataFrame([(None, 1.0 * i, 2.0, [1.0 * i, 3.0]) for i in range(4)], rows.schema)
    assert [(r.series_id, r.n) for r in models.fit_linear(nobody, CHOSEN).collect()] == [(None, 4)]


def test_problems_may_share_a_matrix():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4, 12, 20))
    gram, cross = np.matmul(x.transpose(0, 2, 1), x) / 12, np.einsum("snd,snt->std", x, rng.normal(size=(4, 12, 2))) / 12
    each = kernels.elastic_net(np.repeat(gram, 2, axis=0), cross.reshape(8, 20), 0.05, 0.01)
    assert np.allclose(kernels.elastic_net(gram, cross.reshape(8, 20), 0.05, 0.01, of=np.repeat(np.arange(4), 2)), each)


def test_walk_sums_every_window():
    rng = np.random.default_rng(5)
    histories = [list(100 * rng.normal(size=n)) for n in (1, 5, 29, 30, 31, 90, 400)]
    weights = rng.uniform(-0.1, 0.1, size=(len(histories), len(LAGS) + len(WINDOWS)))
    got = kernels.walk(histories, 120, lambda step, z: (z * weights).sum(axis=1) + step)
    for h, w, path in zip(histories, weights, got):
        h = list(h)
        for step in range(120):
            z = [h[-n] if len(h[-365:]) >= n else h[-1] for n in LAGS] + [np.mean(h[-n:]) for n in WINDOWS]
            h.append(float(np.dot(z, w) + step))
        assert np.allclose(path, h[-120:], rtol=1e-9, atol=1e-9)


def test_linear_walk_equals_a_plain_loop():
    """Paths of series of several starts, lengths and periods, with and without a trend."""
    rng = np.random.default_rng(6)
    names, rows = ["Ridge (alpha=0.5)", "SGD"], []
    for i, (n, extra, degree) in enumerate([(12, [], 0), (40, [12], 2), (12, [12], 1), (100, [5, 90], 2), (40, [], 0)]):
        used = sum(n > lag for lag in LAGS)
        d = used + len(WINDOWS) + 8 + 6 * (len(PERIODS) + len(extra))
        rows.append({
            "series_id": f"s{i}", "n_train": n, "start_day": 18000 + i, "last_day": 18000 + i + 2 * n, "hist": list(rng.normal(size=n)),
            "offsets": [1, 3, 20 + 7 * i], "actual": [1.0, 2.0, 3.0], "exog": [], "hits": [], "default_hits": [], "periods": [*PERIODS, *extra],
            "degree": degree, "c0": 1.0, "c1": 0.5 if degree else 0.0, "c2": 0.001 if degree > 1 else 0.0, "d": d, "wanted": -1, "levels": [],
            "weights": list(rng.uniform(-0.1, 0.1, size=2 * 2 * (d + 1)))})
    batch = pa.RecordBatch.from_pylist(rows)
    got = {(r["series_id"], r["model"], r["ds"]): r["yhat"] for b in forecast._linear_walker(names, True, LAGS, WINDOWS)([batch]) for r in b.to_pylist()}
    assert len(got) == sum(3 * 2 * (2 if r["degree"] else 1) for r in rows)
    for r in rows:
        used = sum(r["n_train"] > lag for lag in LAGS)
        w = np.array(r["weights"]).reshape(2, 2, -1)
        for m, name in enumerate(names):
            for v in (0, 1) if r["degree"] else (0,):
                h = list(r["hist"])
                for day in range(r["last_day"] + 1, r["last_day"] + 1 + max(r["offsets"])):
                    t = float(day - r["start_day"])
                    z = [h[-n] if len(h) >= n else h[-1] for n in LAGS[:used]] + [np.mean(h[-n:]) for n in WINDOWS]
                    x = np.r_[z, kernels.calendar_block(np.array([t]), np.array([day]), r["periods"])[0], 1.0]
                    h.append(float(x @ w[m, v] + v * (r["c0"] + r["c1"] * t + r["c2"] * t * t)))
                    if day - r["last_day"] in r["offsets"]:
                        ds = dt.date(1970, 1, 1) + dt.timedelta(day)
                        assert got[r["series_id"], name + "+Trend" * v, ds] == pytest.approx(h[-1], rel=1e-9, abs=1e-9)


def test_autocorrelation_of_rows_together():
    values = np.random.default_rng(7).normal(size=(5, 40))
    values[3] = 2.0
    got = seasonality._autocorrelation(values, 10)
    assert got[3] is None
    for row, acf in zip(values[:3], got):
        c = row - row.mean()
        assert np.allclose(acf, [(c[k:] * c[:40 - k]).sum() / (c * c).sum() for k in range(11)])


def test_only_complete_rows_get_features(spark):
    """Rows without a target, an early value, an exogenous number or a day are left out before features are worked out."""
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(20)]
    rows = [("a", d, None if i == 9 else float(i), None if i == 15 else 1.0) for i, d in enumerate(days)] + [("b", None, 1.0, 1.0), ("b", days[0], 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "series_id string, ds date, y double, e double").withColumn("periods", F.array(*map(F.lit, PERIODS)))
    got = feature_vectors(frame, periods=F.col("periods"), exog=F.array("e")).orderBy("ds").collect()
    # the first seven days have no value a week before; 9 has no target, 10 and 16 no value before them, 15 no number
    assert [(r.series_id, r.ds) for r in got] == [("a", days[i]) for i in (7, 8, 11, 12, 13, 14, 17, 18, 19)]
    assert {len(r.x) for r in got} == {2 + len(WINDOWS) + 8 + 18 + 1} and all(e is not None for r in got for e in r.x)
