"""What used to be cut, rounded, dropped or merged in silence."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayloom.functions import kernels
from dayloom.operators import checks, exog, forecast, models
from dayloom.operators.panel import daily_panel, standardize
from dayloom.plans import benchmark as jobs

DAY = dt.date(2024, 1, 1)


@pytest.mark.parametrize("kind,values,total", [
    ("double", [0.004, 1.2345], 1.2385), ("decimal(10,4)", [Decimal("0.0040"), Decimal("1.2345")], 1.2385),
    ("long", [10**17, 3], 1e17), ("decimal(38,2)", [Decimal(10) ** 20, Decimal("0.25")], 1e20)])
def test_daily_panel_keeps_values(spark, kind, values, total):
    rows = spark.createDataFrame([("a", DAY, v) for v in values], f"k string, d date, v {kind}")
    assert daily_panel(rows, F.col("k"), F.col("d"), F.col("v")).first().y == pytest.approx(total, rel=1e-15)


def test_no_row_limit_unless_asked(spark):
    rows = spark.range(10_500).selectExpr("'a' AS series_id", "date_add(date'1990-01-01', cast(id as int)) AS ds", "1.0D AS y")
    summary = checks.check_summary(rows)
    assert {r.status for r in checks.checklist(summary, 2).collect()} == {"ok"}
    assert checks.check_counts(summary, 2).first().status == "ok"
    assert checks.check_counts(summary, 2, max_rows=10_000).first().status == "error"


def test_a_missing_day_is_a_missing_cell(spark):
    rows = spark.createDataFrame([("a", DAY, 1.0), ("a", None, 2.0)], "series_id string, ds date, y double")
    summary = checks.check_summary(rows)
    assert checks.check_nulls(summary).first().total_nulls == 1
    assert checks.check_feature_nulls(summary).first().status == "error"


def test_equal_tokens_get_different_columns(spark):
    rows = spark.createDataFrame([("s", DAY, 1.0, c) for c in ("a", "a!", "a 2")], "series_id string, ds date, y double, c string")
    levels = exog.exog_levels(rows, exog.exog_kinds(rows, ["c"]), ["c"])
    names = [r.column_name for r in levels.collect()]
    assert len(names) == len(set(names))


def test_a_short_series_keeps_its_row(spark):
    days = lambda s, n: [(s, DAY + dt.timedelta(i), float(i % 5)) for i in range(n)]
    panel = spark.createDataFrame(days("short", 9) + days("long", 40), "series_id string, ds date, y double")
    scores = jobs.benchmark(panel, chosen=models.LINEAR_MODELS[:1], detect_periods=False).scores.collect()
    by = {r.series_id: r for r in scores if r.series_id == "short"}
    assert by["short"].model == "NoModels" and by["short"].rmse == float("inf")
    assert any(r.series_id == "long" and r.rmse < float("inf") for r in scores)


def test_unfinished_problems_are_marked():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 6))
    gram, cross = (x.T @ x / 50)[None], (x.T @ (x @ np.arange(6.0)) / 50)[None]
    assert np.isnan(kernels.elastic_net(gram, cross, 0.01, 0.01, rounds=1)).all()
    assert np.isfinite(kernels.elastic_net(gram, cross, 0.01, 0.01)).all()


def test_a_broken_series_leaves_the_others(monkeypatch):
    def solve(names, n, *rest):
        if (n == 0).any():
            raise np.linalg.LinAlgError
        return np.ones((len(n), len(names), 2, rest[0].shape[1] + 1)), np.ones((len(n), len(names), 2), int)

    monkeypatch.setattr(models, "_solve_stack", solve)
    out, rounds = models._solve_guarded(["m"], np.array([3, 0, 5]), np.zeros((3, 2)))
    assert np.isnan(out[1]).all() and (out[[0, 2]] == 1).all() and rounds[:, 0, 0].tolist() == [1, -1, 1]


def test_lags_beyond_a_year(spark):
    history = np.arange(500.0)
    path = kernels.walk([history], 3, lambda step, recent: recent[:, 0], lags=(400,), windows=(7,))
    assert path[0].tolist() == [100.0, 101.0, 102.0]
    rows = spark.range(500).selectExpr("'a' AS series_id", "date_add(date'2020-01-01', cast(id as int)) AS ds", "cast(id as double) AS y",
                                       "if(id < 490, 'train', 'test') AS part")
    assert len(forecast.recursion_state(rows, memory=400).first().hist) == 400


def test_one_junk_cell_makes_a_series_day_first(spark):
    rows = [("a", "03/04/2023", 1.0), ("a", "13/04/2023", 2.0), ("a", "n/a", 3.0), ("b", "03/04/2023", 4.0), ("b", "4 May 2023", 5.0)]
    out = standardize(spark.createDataFrame(rows, "series_id string, d string, v double"))
    assert out.columns == ["series_id", "ds", "y"]
    got = {r.y: r.ds for r in out.collect()}
    assert got == {1.0: dt.date(2023, 4, 3), 2.0: dt.date(2023, 4, 13), 3.0: None, 4.0: dt.date(2023, 3, 4), 5.0: dt.date(2023, 5, 4)}


def test_booleans_are_numbers(spark):
    rows = [("s", DAY + dt.timedelta(i), float(i % 2 * 5 + i % 7), i % 2 == 0, "true" if i % 2 else "false") for i in range(60)]
    df = spark.createDataFrame(rows, "series_id string, ds date, y double, promo boolean, word string")
    kinds = exog.known_kinds(df)
    assert [k["kind"] for k in kinds] == ["numeric", "categorical"]
    assert df.select(exog.Columns(kinds).numbers()).first()[0] == [1.0]
    plan = exog.collect_levels(exog.exog_levels(df, kinds), ["promo", "word"])
    assert df.select(*exog.wide_columns(plan)).first().asDict()["x_promo"] == 1.0


def test_only_the_newest_values_are_gathered(spark):
    rows = spark.range(900).selectExpr("if(id % 2 = 0, 'a', 'b') AS series_id", "date_add(date'2020-01-01', cast(id as int)) AS ds", "cast(id as double) AS y",
                                       "if(id < 880, 'train', 'test') AS part")
    got = {r.series_id: r for r in forecast.recursion_state(rows, memory=30).collect()}
    assert got["a"].hist == [float(v) for v in range(820, 880, 2)] and got["a"].n_train == 440 and len(got["b"].offsets) == 10


def test_staged_tables_go_with_their_block(spark):
    from dayloom.plans.stage import stage, stage_panel
    from dayloom.session import staging
    rows = spark.createDataFrame([("a", DAY, 1.0)], "series_id string, ds date, y double")
    outside = stage_panel(rows)
    before = len(spark.catalog.listTables())
    with staging(spark):
        panel, plain = stage_panel(rows), stage(rows, "probe")
        paths = [f.rsplit("/", 1)[0] for df in (panel, plain) for f in df.inputFiles()]
        assert panel.count() == 1 and len(spark.catalog.listTables()) == before + 1
    assert len(spark.catalog.listTables()) == before and outside.count() == 1
    import os
    assert not any(os.path.exists(p.removeprefix("file://").removeprefix("file:")) for p in paths)
