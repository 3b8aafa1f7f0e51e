"""Standardisation, checks, formats, features and files on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dayloom.functions.text import multilabel_parse, sanitize_token, to_number
from dayloom.operators import checks, exog, features, panel, plotdata, seasonality, trend
from dayloom.sources import files, sinks

DAY0 = dt.date(2023, 1, 1)


def _days(n):
    return [DAY0 + dt.timedelta(i) for i in range(n)]


def _one(spark, texts, kind="string"):
    return spark.createDataFrame([(t,) for t in texts], f"v {kind}")


def test_to_number(spark):
    texts = ["1", " 2.5 ", "-.5", "1e3", "1d", "NaN", "", "abc", "0x10", "inf"]
    got = [r[0] for r in _one(spark, texts).select(to_number(F.col("v"))).collect()]
    assert got == [1.0, 2.5, -0.5, 1000.0, None, None, None, None, None, float("inf")]


def test_labels_and_tokens(spark):
    texts = ["a, b,,c ", "a;b", "x|y", "a;b,c", " solo ", "nan", "", None]
    got = [r[0] for r in _one(spark, texts).select(multilabel_parse(F.col("v"))).collect()]
    assert got == [["a", "b", "c"], ["a", "b"], ["x", "y"], ["a;b", "c"], ["solo"], [], [], []]
    tokens = ["a b", "__x--y__", "é/1", "!!", None]
    got = [r[0] for r in _one(spark, tokens).select(sanitize_token(F.col("v"))).collect()]
    assert got == ["a_b", "x_y", "é_1", "unknown", "unknown"]


@pytest.mark.parametrize("fmt,python", [
    ("d/M/yyyy", "%d/%m/%Y"), ("M-d-yyyy", "%m-%d-%Y"), ("yyyy.M.d", "%Y.%m.%d"),
    ("d M yy", "%d %m %y"), ("MMMM d yyyy", "%B %d %Y"), ("d-MMM-yyyy", "%d-%b-%Y"),
])
def test_date_format_is_found(spark, fmt, python):
    rows = [("s", d.strftime(python), i) for i, d in enumerate(_days(40))]
    raw = spark.createDataFrame(rows, "series_id string, Date string, row_idx long")
    assert checks.detect_date_format(raw, "Date").first().date_format == fmt
    assert checks.detect_date_format(raw, "Date", order_col="row_idx").first().date_format == fmt


def test_file_order_matters_when_known(spark):
    rows = [("s", d.strftime("%d/%m/%Y"), i) for i, d in enumerate(reversed(_days(40)))]
    raw = spark.createDataFrame(rows, "series_id string, Date string, row_idx long")
    assert checks.detect_date_format(raw, "Date", order_col="row_idx").first().date_format is None


def test_five_ambiguous_days(spark):
    rows = [("s", f"0{i}/01/2023", v) for i, v in zip(range(1, 6), (10, 12, 15, 18, 20))]
    raw = spark.createDataFrame(rows, "series_id string, Date string, Temperature int")
    fmt = checks.detect_date_format(raw, "Date").first().date_format
    out = panel.standardize(raw, fmt=fmt).orderBy("ds").collect()
    assert fmt == "d/M/yyyy"
    assert [r.ds for r in out] == _days(5) and [r.y for r in out] == [10, 12, 15, 18, 20]


def test_two_digit_years(spark):
    raw = spark.createDataFrame([("s", "01/02/70", "1"), ("s", "01/02/68", "2")],
                                "series_id string, d string, v string")
    got = {r.y: r.ds.year for r in panel.standardize(raw, fmt="d/M/yy").collect()}
    assert got == {1.0: 1970, 2.0: 2068}


def test_interior_gap_is_an_error(spark):
    rows = [("ok", d, None if i > 7 else 1.0) for i, d in enumerate(_days(10))]
    rows += [("bad", d, None if i == 3 else 1.0) for i, d in enumerate(_days(10))]
    rows += [("empty", d, None) for d in _days(3)]
    df = spark.createDataFrame(rows, "series_id string, ds date, y double")
    summary = checks.check_summary(df)
    got = {r.series_id: r.status for r in checks.check_trailing(summary).collect()}
    assert got == {"ok": "ok", "bad": "error", "empty": "error"}
    report = checks.checklist(summary, 2)
    assert [r.series_id for r in checks.accepted_series(report).collect()] == ["ok"]
    meta = {r.series_id: r for r in panel.series_meta(df).collect()}
    assert meta["ok"].trailing_missing == 2 and meta["ok"].last_observed == _days(8)[-1]


def test_known_season_and_trend(spark):
    import math
    rows = [("week", d, 100 + 10 * math.sin(2 * math.pi * i / 7)) for i, d in enumerate(_days(140))]
    rows += [("line", d, 3.0 + 2 * i) for i, d in enumerate(_days(50))]
    rows += [("curve", d, 3.0 + 2 * i + 0.01 * i * i) for i, d in enumerate(_days(50))]
    rows += [("const", d, 5.0) for d in _days(20)] + [("four", d, float(i)) for i, d in enumerate(_days(4))]
    df = spark.createDataFrame(rows, "series_id string, ds date, y double").cache()
    periods = {r.series_id: r.periods for r in seasonality.seasonal_periods(df).collect()}
    assert periods["week"] == [7] and periods["const"] == [] and periods["four"] == []
    fits = {r.series_id: r for r in trend.trend_fit(df).collect()}
    assert fits["line"].degree == 1 and fits["line"].coef.c1 == pytest.approx(2, abs=1e-6)
    assert fits["curve"].degree == 2 and fits["curve"].coef.c2 == pytest.approx(0.01, abs=1e-6)
    assert fits["const"].degree == 0 and fits["four"].coef.c0 == 1.5 and fits["four"].degree == 0
    labels = {r.series_id: r.label for r in trend.trend_label(trend.trend_fit(df)).collect()}
    assert labels["curve"] == "linear+parabola" and labels["const"] == "none"
    t = trend.trend_fit(df)
    back = trend.retrend(trend.detrend(df, t), t, "y")
    worst = back.withColumnRenamed("y", "z").join(df, ["series_id", "ds"]).agg(
        F.max(F.abs(F.col("z") - F.col("y")))).first()[0]
    assert worst < 1e-9


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([("s", 1.0, 0.1), ("s", 3.0, 0.1)], "series_id string, a double, b double")
    got = sorted(tuple(r) for r in features.standard_scale(df, ["a", "b"]).collect())
    assert got == [("s", -1.0, 0.0), ("s", 1.0, 0.0)]


def test_short_history_falls_back_to_last_value(spark):
    df = spark.createDataFrame([("s", d, float(i)) for i, d in enumerate(_days(3))],
                               "series_id string, ds date, y double")
    r = features.next_day_features(features.series_state(df)).first()
    assert (r.lag1, r.lag7, r.lag365, r.ma7, r.trend) == (2.0, 2.0, 2.0, 1.0, 3.0)


def test_numeric_share_threshold(spark):
    rows = [("s", d, 1.0, "7" if i < 60 else "w", "7" if i < 59 else "w", "a;b" if i == 99 else "a")
            for i, d in enumerate(_days(100))]
    df = spark.createDataFrame(rows, "series_id string, ds date, y double, at string, below string, tags string")
    got = {r.original_name: r.kind for r in exog.exog_kinds(df).collect()}
    assert got == {"at": "numeric", "below": "categorical", "tags": "multilabel"}


def test_too_many_levels_are_refused_but_long_form_works(spark):
    rows = [("s", d, 1.0, f"v{i}") for i, d in enumerate(_days(30))]
    df = spark.createDataFrame(rows, "series_id string, ds date, y double, c string")
    kinds = exog.exog_kinds(df)
    levels = exog.exog_levels(df, kinds)
    with pytest.raises(ValueError):
        exog.collect_levels(levels, ["c"], max_columns=10)
    assert exog.encode_long(df, kinds, levels).count() == 30


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin-1"])
def test_files_are_sniffed_and_read(spark, tmp_path, sep, encoding):
    folder = tmp_path / "in"
    folder.mkdir()
    body = sep.join(["Datum", "Größe"]) + "\n" + "".join(
        f"{d:%d/%m/%Y}{sep}{i}.5\n" for i, d in enumerate(_days(12)))
    (folder / "one.csv").write_bytes(body.encode(encoding))
    found = files.sniff_files(files.read_lines(spark, str(folder))).first()
    assert found.delimiter == sep and found.n_lines == 13
    assert found.encoding == ("latin-1" if encoding == "latin-1" else "utf-8-sig")
    raw = files.read_panel_files(spark, str(folder), ["d", "v"]).drop("path")
    out = panel.standardize(raw, fmt="d/M/yyyy").orderBy("ds").collect()
    assert [r.ds for r in out] == _days(12) and out[3].y == 3.5
    plain = files.read_delimited(spark, str(folder), sep, found.encoding)
    assert plain.columns[1] == "Größe"


def test_file_checks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("d,v\n")
    (tmp_path / "b.txt").write_text("x" * 50)
    expected = spark.createDataFrame([("a.csv",), ("b.txt",), ("gone.csv",)], "file string")
    got = {r.file: (r.status, r.message) for r in
           files.file_checks(spark, str(tmp_path), expected, max_bytes=40).collect()}
    assert got == {"a.csv": ("ok", "delimited file"), "b.txt": ("error", "too large"),
                   "gone.csv": ("error", "not found")}


def test_predictions_sink(spark, tmp_path):
    df = spark.createDataFrame([("s", d, None if i > 1 else 1.0) for i, d in enumerate(_days(3))],
                               "series_id string, ds date, y double")
    best = spark.createDataFrame([("s", _days(3)[2], 9.0)], "series_id string, ds date, yhat double")
    out = str(tmp_path / "out")
    sinks.write_predictions(df, best, out, "y")
    rows = sorted(tuple(r) for r in spark.read.option("header", True).csv(out).collect())
    assert rows[2] == ("s", "03/01/2023", None, "9.0") and rows[0][3] is None


def test_plot_tables(spark):
    days = _days(10)
    df = spark.createDataFrame([("s", d, float(i)) for i, d in enumerate(days)],
                               "series_id string, ds date, y double")
    split = spark.createDataFrame([("s", days[8])], "series_id string, split_ds date")
    shown = plotdata.visible(df, split)
    assert sorted(r.y for r in shown.collect()) == [7.0, 8.0, 9.0]
    assert plotdata.visible(df, split, has_future=False).count() == 2
    fc = spark.createDataFrame([("s", "m", days[9], 17.0)], "series_id string, model string, ds date, yhat double")
    b = plotdata.bounds(shown, fc).first()
    assert (b.y_min, b.y_max) == (6.5, 17.5)
    line = plotdata.connected(shown, fc).orderBy("anchor").collect()
    assert [(r.yhat, r.anchor) for r in line] == [(17.0, False), (9.0, True)]
