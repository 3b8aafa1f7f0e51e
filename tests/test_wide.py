"""Fits with any number of category levels, wanted models, rejected series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayloom.functions import kernels, wide
from dayloom.operators import evaluate, exog, forecast, models
from dayloom.plans import benchmark as jobs
from dayloom.plans.stage import stage_panel

START = dt.date(2001, 1, 1)
RIDGES = ("Ridge (alpha=0.5)", "Ridge (alpha=2.0)")


def _problem(n, levels, several, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    x = np.column_stack([t / 10, 20 * np.sin(t / 9) + rng.normal(size=n), rng.normal(size=n), t % 7 == 3, np.full(n, 3.0)]).astype(float)
    own = [rng.choice(levels, size=rng.integers(0, 4) if several else 1, replace=False) for _ in range(n)]
    rows, cols = np.repeat(t, [len(o) for o in own]), np.concatenate(own).astype(int)
    y = 0.3 * t + x[:, 1] + rng.normal(size=n) * 3
    np.add.at(y, rows, (rng.normal(size=levels) * 10)[cols])
    ones = np.zeros((n, levels))
    ones[rows, cols] = 1
    return x, rows, cols, y, np.hstack([x, ones])


@pytest.mark.parametrize("several", [False, True])
@pytest.mark.parametrize("n,levels", [(200, 30), (120, 60), (300, 3)])
def test_fits_on_ones_equal_fits_on_columns(several, n, levels):
    x, rows, cols, y, full = _problem(n, levels, several)
    design = wide.Design(x, rows, cols, levels)
    centre, spread = full.mean(0), full.std(0)
    scale = np.where(spread <= 1e-14 * np.maximum(np.abs(centre), 1), 1, spread)
    xc, yc = full - centre, y - y.mean()
    gram, cross = xc.T @ xc, xc.T @ yc
    scaled, side = gram / np.outer(scale, scale), cross / scale

    def same(got, w, b=None, rel=1e-8):
        weights, rounds = got
        want = full @ w + (y.mean() - centre @ w if b is None else b)
        assert rounds > 0 and np.allclose(full @ weights[:-1] + weights[-1], want, rtol=0, atol=rel * np.abs(y).max())

    for alpha in (0.5, 2.0):
        same(wide.ridge(design, y, alpha), kernels.ridge(gram[None], cross[None, :, None], np.array([alpha]))[0, :, 0])
    same(wide.scaled_ridge(design, y, 1e-4), kernels.ridge(scaled[None], side[None, :, None], np.array([1e-4 * n]))[0, :, 0] / scale)
    for l1, l2 in ((0.1, 0.0), (0.007, 0.003), (2.0, 0.0), (1e3, 0.0)):
        same(wide.elastic_net(design, y, l1, l2), kernels.elastic_net(scaled[None] / n, side[None] / n, l1, l2)[0] / scale)
    same(wide.bayesian_ridge(design, y), kernels.bayesian_ridge(gram, cross, float(yc @ yc), n), rel=1e-6)
    w, b = kernels.huber(xc / scale, y)
    same(wide.huber(design, y), w / scale, b - centre @ (w / scale), rel=1e-4)
    for epsilon, own in ((0.1, False), (0.0, True)):
        w, b = kernels.insensitive(xc / scale, y, 1.0, epsilon, own)
        same(wide.insensitive(design, y, 1.0, epsilon, own), w / scale, b - centre @ (w / scale), rel=1e-5)


def test_solvers_say_when_their_rounds_run_out():
    x, rows, cols, y, full = _problem(100, 20, True)
    design, z = wide.Design(x, rows, cols, 20), (full - full.mean(0)) / np.maximum(full.std(0), 1e-9)
    for fit in (wide.huber, wide.insensitive):
        weights, rounds = fit(design, y, rounds=2)
        assert np.isnan(weights).all() and rounds == 2
    assert wide.elastic_net(design, y, 0.1, 0.0, rounds=1)[0] is not None and np.isnan(wide.elastic_net(design, y, 0.1, 0.0, rounds=1)[0]).all()
    for fit in (kernels.huber, kernels.insensitive):
        log = []
        w, b = fit(z, y, rounds=2, log=log)
        assert np.isnan(w).all() and np.isnan(b) and log == [-2]
        log = []
        assert np.isfinite(fit(z, y, log=log)[0]).all() and log[0] > 2
    gram, cross = z.T @ z, z.T @ y
    log = []
    assert np.isfinite(kernels.bayesian_ridge(gram, cross, float(y @ y), 100, rounds=2, log=log)).all() and log == [-2]


def _rows(name, n, cell, seed=1, future=0):
    rng = np.random.default_rng(seed)
    for i in range(n):
        text, effect = cell(i, rng)
        y = 100 + 10 * np.sin(2 * np.pi * i / 7) + effect + rng.normal() * 0.1
        yield (name, START + dt.timedelta(i), None if i >= n - future else float(round(y, 4)), text)


def _many(levels):
    """Every level twice: in turn, then in turn again."""
    return lambda i, rng: (f"v{i % levels}", float((i * 7919 % levels) % 40))


SCHEMA = "series_id string, ds date, y double, code string"


def test_five_thousand_levels_go_through(spark):
    rows = [*_rows("a", 5600, _many(5000), future=20), *_rows("b", 300, lambda i, rng: (f"v{i % 12}", float(i % 12) * 5), future=5)]
    panel = stage_panel(spark.createDataFrame(rows, SCHEMA))
    chosen = RIDGES + ("SGD", "Lasso (alpha=0.1)", "BayesianRidge", models.NEIGHBOUR_MODEL)
    result = jobs.benchmark(panel, chosen, detect_periods=False)
    scores = {(r.series_id, r.model): r.rmse for r in result.scores.collect()}
    assert {m for s, m in scores if s == "a"} >= set(chosen) and all(np.isfinite(v) for v in scores.values())
    assert scores["b", RIDGES[0]] < 5
    future = jobs.forecast_future(panel, RIDGES, detect_periods=False).toPandas()
    assert len(future) == 2 * 25 and np.isfinite(future.yhat).all()
    # the level's effect is learnt from its first turn: without the column it is noise of 11.5
    known = jobs.forecast_future(panel.drop("code"), RIDGES, detect_periods=False).toPandas()
    truth = {START + dt.timedelta(i): 100 + 10 * np.sin(2 * np.pi * i / 7) + (i * 7919 % 5000) % 40 for i in range(5580, 5600)}
    error = lambda df: np.sqrt(np.mean([(r.yhat - truth[r.ds]) ** 2 for r in df.itertuples() if r.series_id == "a"]))
    assert error(future) < 0.8 * error(known)


def test_three_thousand_labels_in_lists_go_through(spark):
    def cell(i, rng):
        own = rng.choice(3000, 3, replace=False)
        return ",".join(f"t{k}" for k in own), float((own % 20).sum())

    panel = stage_panel(spark.createDataFrame(list(_rows("a", 1500, cell)), SCHEMA))
    scores = {r.model: r.rmse for r in jobs.benchmark(panel, RIDGES + ("SGD", "BayesianRidge"), detect_periods=False).scores.collect()}
    assert len(scores) >= 4 and all(np.isfinite(v) for v in scores.values())


@pytest.mark.parametrize("chosen", [models.LINEAR_MODELS, (models.NEIGHBOUR_MODEL,)])
def test_both_ways_give_the_same_forecasts(spark, monkeypatch, chosen):
    def cell(i, rng):
        return (None if i % 11 == 0 else f"v{i % 9}"), float(i % 9)

    rows = [r for r in _rows("a", 260, cell) if r[1].day != 17]
    tags = lambda d: ["x,y", "y", None, "x,z"][d.toordinal() % 4]
    df = spark.createDataFrame([(*r, float(r[1].day), tags(r[1])) for r in rows], SCHEMA + ", num double, tags string")
    panel = stage_panel(df)
    out = []
    for width in (256, 5):
        monkeypatch.setattr(models, "DENSE_COLUMNS", width)
        out.append(jobs.benchmark(panel, chosen, detect_periods=False).forecasts.toPandas())
    both = out[0].merge(out[1], on=["series_id", "model", "ds"])
    assert len(both) == len(out[0]) == len(out[1]) > 0
    apart = ((both.yhat_x - both.yhat_y).abs() / both.y_x.abs().max()).groupby(both.model).max()
    assert (apart < 1e-3).all() and (apart[[m for m in apart.index if "Huber" not in m and "SVR" not in m and "Bayes" not in m]] < 1e-6).all(), apart


def test_level_names_of_cells(spark):
    kinds = [{"original_name": "c", "kind": "categorical"}, {"original_name": "m", "kind": "multilabel"}, {"original_name": "n", "kind": "numeric"}]
    df = spark.createDataFrame([("a=b", "x, y,x", "1.5"), (None, None, None), ("", "nan", "k")], "c string, m string, n string")
    wide_ = exog.Columns(kinds)
    got = [(r[0], r[1], r[2], r[3]) for r in df.select(wide_.levels(), wide_.numbers(), wide_.numbers(True), wide_.missing_day()).collect()]
    assert got == [(["0=a=b", "1=x", "1=y"], [1.5], [1.5], ["0"]), (["0"], [None], [0.0], ["0"]), (["0="], [None], [0.0], ["0"])]
    named = df.select(F.explode(wide_.levels()).alias("level_name")).select(exog.level_column_name(kinds).alias("c"), exog.level_value().alias("v"))
    assert [tuple(r) for r in named.collect()] == [("c", "a=b"), ("m", "x"), ("m", "y"), ("c", None), ("c", "")]
    ragged = df.select(F.array("c", "m", "n").alias("cells"), F.array(*[F.lit(k["kind"]) for k in kinds]).alias("cell_kinds"))
    own = exog.Cells()
    assert [(r[0], r[1], r[2], r[3]) for r in ragged.select(own.levels(), own.numbers(), own.numbers(True), own.missing_day()).collect()] == got


def test_series_with_columns_of_their_own(spark):
    """Cells of different width and kind by series give what each series gives alone with named columns."""
    rng = np.random.default_rng(3)
    rows = {"a": [], "b": [], "c": []}
    for i in range(200):
        day, promo, kind = START + dt.timedelta(i), float(rng.integers(0, 3)), "xyz"[rng.integers(0, 3)]
        noise = rng.normal() * 0.1
        rows["a"].append(("a", day, 10 + 4 * promo + noise, [str(promo), kind]))
        rows["b"].append(("b", day, 20 + 6 * (kind == "x") + noise, [kind, f"{kind},q" if i % 2 else "q", str(promo)]))
        rows["c"].append(("c", day, 5 + i % 7 + noise, []))
    ragged = spark.createDataFrame(sum(rows.values(), []), "series_id string, ds date, y double, cells array<string>")
    chosen = RIDGES + (models.NEIGHBOUR_MODEL,)
    got = jobs.benchmark(stage_panel(ragged), chosen, detect_periods=False).forecasts.toPandas()
    for name, own in rows.items():
        flat = [(s, d, y, *c) for s, d, y, c in own]
        df = spark.createDataFrame(flat, "series_id string, ds date, y double" + "".join(f", x{i} string" for i in range(len(own[0][3]))))
        alone = jobs.benchmark(stage_panel(df), chosen, detect_periods=False).forecasts.toPandas()
        both = got.merge(alone, on=["series_id", "model", "ds"])
        assert len(both) == len(alone) and np.allclose(both.yhat_x, both.yhat_y, rtol=1e-9), name


def _plain(spark, names, n=150, future=8):
    rng = np.random.default_rng(4)
    rows = [(s, START + dt.timedelta(i), None if i >= n - future else float(30 + k * i * 0.3 + 5 * np.sin(i * 0.9) + rng.normal()))
            for k, s in enumerate(names) for i in range(n)]
    return stage_panel(spark.createDataFrame(rows, "series_id string, ds date, y double"))


def test_only_winners_are_fitted(spark):
    panel, chosen = _plain(spark, ["a", "b", "c"]), RIDGES + ("BayesianRidge", "SGD", "Huber (epsilon=1.35)", models.NEIGHBOUR_MODEL)
    scores = jobs.benchmark(panel, chosen, detect_periods=False).scores.persist()
    got = jobs.future_of_top(panel, scores, chosen, detect_periods=False).toPandas()
    both = jobs.forecast_future(panel, chosen, detect_periods=False).unionByName(
        jobs.forecast_future_trend(panel, chosen, detect_periods=False)).toPandas()
    top = evaluate.top_models(scores).select("series_id", "model").toPandas()
    want = both.merge(top, on=["series_id", "model"])
    merged = got.merge(want, on=["series_id", "model", "ds"])
    assert len(got) == len(want) == len(merged) == 3 * 3 * 8
    assert np.allclose(merged.yhat_x, merged.yhat_y)
    # masks: what a series doesn't want is neither solved nor walked
    mask = spark.createDataFrame([("a", models.wanted_mask(["SGD"])), ("b", models.wanted_mask([RIDGES[0], "Huber (epsilon=1.35)"]))],
                                 "series_id string, wanted long")
    part = jobs.forecast_future(panel, chosen, detect_periods=False, wanted=mask).select("series_id", "model").distinct()
    assert {tuple(r) for r in part.collect()} == {("a", "SGD"), ("b", RIDGES[0]), ("b", "Huber (epsilon=1.35)")}


def test_rejected_series_have_a_reason(spark):
    day = lambda i: START + dt.timedelta(i)
    rows = [("twice", day(i % 30), float(i)) for i in range(60)] + [("short", day(i), 1.0) for i in range(9)]
    rows += [("good", day(i), float(i % 7)) for i in range(60)] + [("empty", day(0), None)]
    panel = stage_panel(spark.createDataFrame(rows, "series_id string, ds date, y double"))
    result = jobs.benchmark(panel, RIDGES[:1], detect_periods=False)
    status = {(r.series_id, r.model): (r.status, r.reason) for r in result.status.collect()}
    assert status == {("twice", None): ("rejected", evaluate.SEVERAL), ("short", None): ("rejected", evaluate.SHORT),
                      ("empty", None): ("rejected", evaluate.SHORT), ("good", None): ("ok", None)}
    best = {r.series_id: (r.model, r.rmse) for r in result.scores.filter("rank = 1").collect()}
    assert best["twice"] == best["short"] == ("NoModels", float("inf")) and best["good"][0].startswith(RIDGES[0])
    report = jobs.fit_report(panel, RIDGES[:1] + ("BayesianRidge", "LinearSVR"), detect_periods=False).collect()
    assert {r.series_id: r.reason for r in report if r.model is None} == {"twice": evaluate.SEVERAL, "short": evaluate.SHORT, "empty": evaluate.SHORT}
    good = {r.model: r for r in report if r.series_id == "good"}
    assert set(good) == {RIDGES[0], "BayesianRidge", "LinearSVR"} and all(r.converged and r.rounds > 0 and r.reason is None for r in good.values())


def test_days_without_a_row_have_the_missing_level():
    class Row:
        offsets, hits, exog, default_hits = [1, 3], [["0=a", "1=z"], ["0=new"]], [2.0, 5.0], ["0"]

    day, level = forecast._level_days(Row, ["0", "0=a", "1=z"], 3)
    assert sorted(zip(day.tolist(), level.tolist())) == [(0, 1), (0, 2), (1, 0)]
    assert forecast._exog_block(Row, 3).tolist() == [[2.0], [0.0], [5.0]]
