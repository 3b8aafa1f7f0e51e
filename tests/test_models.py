"""Fits and recursion against brute force on derived series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayloom.operators import evaluate, exog, models, trend
from dayloom.operators.features import feature_vectors
from dayloom.plans import benchmark as jobs
from dayloom.plans.stage import stage_panel
from dayloom.schema import LAGS, PERIODS, WINDOWS

RIDGES = ("Ridge (alpha=0.5)", "Ridge (alpha=2.0)")


def _series(name, n, seed, gaps=(), slope=0.0, future=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    y = 50 + 8 * np.sin(2 * np.pi * t / 7) + slope * t + rng.normal(size=n)
    rows = [(name, dt.date(2020, 1, 1) + dt.timedelta(int(i)),
             None if i >= n - future else round(float(v), 4))
            for i, v in zip(t, y) if i not in gaps]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, "series_id string, ds date, y double")


def _features(hist, day, start):
    t = (day - start).days
    x = [hist[-n] if len(hist) >= n else hist[-1] for n in LAGS]
    x += [float(np.mean(hist[-w:])) for w in WINDOWS]
    x += [float(t)] + [float(day.weekday() == i) for i in range(7)]
    for p in PERIODS:
        for k in (1, 2, 3):
            x += [np.sin(2 * np.pi * k * t / p), np.cos(2 * np.pi * k * t / p)]
    return np.array(x)


def _brute(rows, alpha):
    """Ridge walk-forward of one series, written as the plain loop."""
    known = [r for r in rows if r[2] is not None]
    n_test = max(1, int(len(known) * 0.2))
    train, test = known[:-n_test], known[-n_test:]
    n, start = len(train), train[0][1]
    used = [i for i, lag in enumerate(LAGS) if n > lag] + list(range(len(LAGS), 34))
    y = [r[2] for r in train]
    first = max([lag for lag in LAGS if n > lag])
    x = np.array([_features(y[:i], train[i][1], start)[used] for i in range(first, n)])
    target = np.array(y[first:])
    xc, yc = x - x.mean(0), target - target.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    b = target.mean() - x.mean(0) @ w
    hist, out, day = list(y), {}, train[-1][1]
    wanted = {r[1] for r in test}
    while day < test[-1][1]:
        day += dt.timedelta(1)
        value = float(_features(hist, day, start)[used] @ w + b)
        hist.append(value)
        if day in wanted:
            out[day] = value
    return out


@pytest.fixture(scope="module")
def rows():
    return {
        "long": _series("long", 520, 1),
        "gappy": _series("gappy", 300, 2, gaps={50, 51, 262, 263, 264, 270}),
        "short": _series("short", 30, 3),
        "tiny": _series("tiny", 9, 4),
    }


def test_ridge_walk_forward_equals_brute_force(spark, rows):
    panel = stage_panel(_frame(spark, sum(rows.values(), [])))
    got = jobs.benchmark(panel, RIDGES, detect_periods=False).forecasts.toPandas()
    assert set(got.series_id) == {"long", "gappy", "short"}
    for name in ("long", "gappy", "short"):
        for model, alpha in zip(RIDGES, (0.5, 2.0)):
            own = got[(got.series_id == name) & (got.model == model)]
            expected = _brute(rows[name], alpha)
            assert len(own) == len(expected)
            for r in own.itertuples():
                assert r.yhat == pytest.approx(expected[r.ds], rel=1e-7), (name, model, r.ds)


def test_test_targets_do_not_reach_predictions(spark, rows):
    base = rows["long"]
    changed = base[:-50] + [(s, d, y * 3 + 7) for s, d, y in base[-50:]]
    out = []
    for r in (base, changed):
        b = jobs.benchmark(stage_panel(_frame(spark, r)), RIDGES, leak_free=True)
        out.append(b.forecasts.orderBy("model", "ds").toPandas())
    n = len(base) - int(len(base) * 0.2)
    tail = [r[1] for r in base[n:]]
    assert set(out[0].ds) == set(tail)
    merged = out[0].merge(out[1], on=["model", "ds"])
    assert np.allclose(merged.yhat_x, merged.yhat_y)


def test_trend_variant_appears_only_with_a_trend(spark):
    panel = stage_panel(_frame(spark, _series("up", 200, 5, slope=2.0) + _series("flat", 200, 6)))
    b = jobs.benchmark(panel, RIDGES, detect_periods=False)
    names = b.scores.select("series_id", "model").toPandas().groupby("series_id").model.apply(set)
    split = evaluate.time_split(panel)
    chosen = trend.trend_choice(split.filter("part = 'train'"), panel)
    degree = {r.series_id: r.degree for r in chosen.collect()}
    assert degree["up"] > 0
    for name in ("up", "flat"):
        expected = set(RIDGES) | ({n + "+Trend" for n in RIDGES} if degree[name] else set())
        assert names[name] == expected
    best = b.scores.filter("series_id = 'up' AND rank = 1").first()
    assert best.rmse < 20


def test_future_of_top_covers_every_future_day(spark):
    panel = stage_panel(_frame(spark, _series("a", 120, 7, future=10) + _series("b", 60, 8, future=5)))
    scores = jobs.benchmark(panel, RIDGES + ("BayesianRidge",)).scores
    out = jobs.future_of_top(panel, scores, RIDGES + ("BayesianRidge",)).toPandas()
    counts = out.groupby(["series_id", "model"]).size()
    assert set(counts["a"]) == {10} and set(counts["b"]) == {5}
    assert counts.groupby("series_id").size().eq(3).all()
    assert out.yhat.notna().all()


def test_all_series_models_give_finite_scores(spark, rows):
    panel = stage_panel(_frame(spark, rows["gappy"]))
    scores = jobs.benchmark(panel, jobs.SERIES_MODELS).scores.toPandas()
    assert {m.removesuffix("+Trend") for m in scores.model} == set(jobs.SERIES_MODELS)
    assert np.isfinite(scores.rmse).all() and scores.accuracy_pct.between(0, 100).all()
    assert list(scores.sort_values("rank").rmse) == sorted(scores.rmse)


def test_knn_walk_equals_brute_force(spark, rows):
    panel = stage_panel(_frame(spark, rows["short"]))
    got = jobs.benchmark(panel, (models.NEIGHBOUR_MODEL,), detect_periods=False).forecasts.toPandas()
    y = [r[2] for r in rows["short"]]
    days = [r[1] for r in rows["short"]]
    n, start = 24, days[0]
    used = [0, 1] + list(range(len(LAGS), 34))
    x = np.array([_features(y[:i], days[i], start)[used] for i in range(7, n)])
    hist = y[:n]
    for i in range(n, 30):
        d = ((x - _features(hist, days[i], start)[used]) ** 2).sum(1)
        value = np.array(y[7:n])[np.argsort(d, kind="stable")[:5]].mean()
        hist.append(value)
        assert got[got.ds == days[i]].yhat.iloc[0] == pytest.approx(value)


def test_exogenous_columns_enter_fit_and_recursion(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(450):
        promo, kind = float(rng.integers(0, 2)), ["x", "y"][int(rng.integers(0, 2))]
        y = 10 + 5 * promo + (3 if kind == "y" else 0)
        rows.append(("s", dt.date(2021, 1, 1) + dt.timedelta(i), y, promo, kind, "a,b" if kind == "y" else "b"))
    df = spark.createDataFrame(rows, "series_id string, ds date, y double, promo double, kind string, tags string")
    scores = jobs.benchmark(stage_panel(df), ("Ridge (alpha=0.5)",), detect_periods=False).scores
    assert scores.orderBy("rank").first().rmse < 0.5
    plan = exog.collect_levels(
        exog.exog_levels(df, exog.exog_kinds(df)), ["promo", "kind", "tags"])
    assert [p["column_name"] for p in plan] == [
        "x_promo", "x_kind_x", "x_kind_y", "x_kind_nan", "m_tags_a", "m_tags_b"]
    assert exog.missing_day_vector(plan) == [0.0, 0.0, 0.0, 1.0, 0.0, 0.0]


def test_elastic_net_weights_match_coordinate_descent(spark, rows):
    name = "Lasso (alpha=0.1)"
    train = evaluate.time_split(_frame(spark, rows["long"])).filter("part = 'train'")
    vec = feature_vectors(train.drop("part", "n_known").withColumn("detrended", F.col("y")),
                          extra=("detrended",)).persist()
    fit = models.coefficients(models.fit_linear(vec, (name,)), (name,)).filter(F.col("model") == name)
    w, b = np.array(fit.first().coef), fit.first().intercept
    pdf = vec.select("x", "y").toPandas()
    x, y = np.stack(pdf.x), pdf.y.to_numpy()
    sd = np.where(x.std(0) > 1e-12, x.std(0), 1.0)
    z, yc, n = (x - x.mean(0)) / sd, y - y.mean(), len(y)
    v = np.zeros(x.shape[1])
    for _ in range(20000):
        old = v.copy()
        for j in range(len(v)):
            rho = z[:, j] @ (yc - z @ v + z[:, j] * v[j]) / n
            size = (z[:, j] ** 2).mean()
            v[j] = np.sign(rho) * max(abs(rho) - 0.1, 0) / size if size > 0 else 0.0
        if np.abs(v - old).max() < 1e-10:
            break
    assert np.allclose(w * sd, v, atol=1e-5)
    assert b == pytest.approx(y.mean() - x.mean(0) @ w)


def test_metric_edge_cases(spark):
    day = dt.date(2022, 1, 1)
    rows = [("flat", "m", day, 5.0, 5.0), ("flat", "m", day + dt.timedelta(1), 5.0, 5.0),
            ("off", "m", day, 5.0, 6.0), ("zero", "m", day, 0.0, 0.0),
            ("none", "m", day, 1.0, None)]
    df = spark.createDataFrame(rows, "series_id string, model string, ds date, y double, yhat double")
    got = {r.series_id: r for r in evaluate.metrics(df).collect()}
    assert got["flat"].accuracy_pct == 100.0 and got["off"].accuracy_pct == 0.0
    assert got["zero"].mape == 0.0 and got["zero"].smape == 0.0
    assert got["none"].rmse == float("inf")
    ranks = evaluate.leaderboard(evaluate.metrics(df)).filter("series_id = 'none'").first()
    assert ranks["rank"] == 1


def test_trees_agree_with_the_library_model(spark, rows):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor
    from dayloom.operators import trees

    train = _frame(spark, rows["short"])
    vec = feature_vectors(train).select("x", F.col("y").alias("label"),
                                        array_to_vector("x").alias("features"))
    model = GBTRegressor(maxIter=5, maxDepth=3, seed=42).fit(vec)
    pdf = model.transform(vec).select("x", "prediction").toPandas()
    own = trees.predict_trees(trees._ensemble(model), np.stack(pdf.x))
    assert np.allclose(own, pdf.prediction)


def test_series_without_complete_rows_is_reported_as_failed(spark):
    rows = [("s", dt.date(2021, 1, 1) + dt.timedelta(i), float(i), "1.5" if i % 2 else None)
            for i in range(12)]
    rows = [r[:3] + (r[3] if r[1] < dt.date(2021, 1, 1) + dt.timedelta(7) else None,) for r in rows]
    rows += [("t", dt.date(2021, 1, 1) + dt.timedelta(i), float(i), "2.5") for i in range(40)]
    df = spark.createDataFrame(rows, "series_id string, ds date, y double, promo string")
    scores = jobs.benchmark(stage_panel(df), RIDGES[:1], detect_periods=False).scores
    got = {r.series_id: (r.model, r.rmse) for r in scores.filter("rank = 1").collect()}
    assert got["s"] == ("NoModels", float("inf"))
    assert got["t"][1] < float("inf")
