"""Folder of files to forecasts and export; the benchmark that refits only what changed."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayloom.plans import benchmark as jobs
from dayloom.plans import folder, incremental
from dayloom.plans.stage import stage_panel
from dayloom.schema import KEY
from dayloom.sources import files, sinks

RIDGES = ("Ridge (alpha=0.5)", "Ridge (alpha=2.0)")
START = dt.date(2022, 1, 1)


def _file(n, future, head, middle=lambda i: [], value=lambda i: 20 + i % 7, sep=",", order=lambda i: i):
    rows = [[f"{START + dt.timedelta(order(i)):%d/%m/%Y}", *middle(i), "" if i >= n - future else f"{value(i):.2f}"] for i in range(n)]
    return "\n".join(sep.join(r) for r in [head, *rows]) + "\n"


def test_files_to_forecasts_and_export(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    texts = {
        "plain.csv": _file(60, 5, ["Date", "Temperature"]),
        "promo.csv": _file(80, 4, ["Tag", "promo", "art", "Größe"], lambda i: [str(i % 3), '"a, ""b"""' if i % 5 else "c"], lambda i: 10 + 3 * (i % 3)),
        "known.csv": _file(40, 0, ["d", "v"]),
        "mixed.csv": _file(40, 3, ["d", "v"], order=lambda i: (i * 7) % 40),
        "one.csv": "d\n1\n", "empty.csv": "", "ragged.csv": "d,v\n01/01/2022,1,2\n", "hole.csv": _file(40, 3, ["d", "v"]).replace("20.00", "", 1),
        "gap.csv": _file(30, 2, ["d", "p", "v"], lambda i: ["" if i == 4 else "1"]), "few.csv": _file(8, 2, ["d", "v"]),
    }
    for name, text in texts.items():
        (source / name).write_text(text)
    names = spark.createDataFrame([(n,) for n in texts], "file string")
    result = folder.forecast_folder(spark, str(source), RIDGES, detect_periods=False, expected=names)
    base = F.element_at(F.split(KEY, "/"), -1)
    got = {r.f: r for r in result.report.withColumn("f", base).collect()}
    assert {f: (r.status, r.message) for f, r in got.items()} == {
        "plain.csv": ("ok", "forecast made"), "promo.csv": ("ok", "forecast made"), "known.csv": ("ok", "forecast made"),
        "mixed.csv": ("error", "days are not one step apart"), "one.csv": ("error", "a date and a target column are needed"),
        "empty.csv": ("error", "not found or empty"), "ragged.csv": ("error", "a row has more fields than the header"),
        "hole.csv": ("error", "missing targets must close the series"), "gap.csv": ("error", "1 feature cells missing"),
        "few.csv": ("ok", "forecast made")}
    assert {f: (r.n_rows, r.n_predicted) for f, r in got.items() if r.status == "ok"} == {
        "plain.csv": (60, 5), "promo.csv": (80, 4), "known.csv": (40, 0), "few.csv": (8, 2)}
    assert got["few.csv"].model == "NoModels" and got["plain.csv"].model.startswith("Ridge")

    folder.export_folder(result, str(out))
    back = files.read_tables(spark, str(out)).withColumn("f", F.regexp_extract("path", r"([a-z]+\.csv)/[^/]*$", 1)).collect()
    rows = {(r.f, r.row): r for r in back}
    assert {r.f for r in back} == {"plain.csv", "promo.csv", "known.csv", "few.csv"} and len(back) == 60 + 80 + 40 + 8
    assert rows["promo.csv", 1].names == ["Tag", "promo", "art", "Größe", "predicted_Größe"]
    assert rows["promo.csv", 2].cells == ["02/01/2022", "1", 'a, "b"', "13.00", None]
    last = rows["promo.csv", 78]
    assert last.cells[3] is None and float(last.cells[4]) == pytest.approx(10 + 3 * (77 % 3), abs=0.5)
    assert rows["few.csv", 8].cells[2] is not None and rows["known.csv", 40].cells[2] is None


def test_a_failed_export_leaves_the_old_one(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, ["d", "v"], ["1", "2"], None), ("a", 2, ["d", "v"], ["2", None], 5.0), ("b", 1, ["d", "v"], ["1", "7"], None)],
                                 "series_id string, file_row long, names array<string>, cells array<string>, predicted double")
    out = str(tmp_path / "out")
    read = lambda: sorted((r.series_id, r.value) for r in spark.read.text(out).select("series_id", "value").collect())
    sinks.export_tables(rows, out, "file_row")
    first = read()
    assert first == [("a", "1,2,"), ("a", "2,,5.0"), ("a", "d,v,predicted_v"), ("b", "1,7,"), ("b", "d,v,predicted_v")]
    broken = rows.withColumn("predicted", F.when(F.col("series_id") == "b", F.raise_error(F.lit("lost")).cast("double")).otherwise(9.0))
    with pytest.raises(Exception, match="lost"):
        sinks.export_tables(broken, out, "file_row")
    assert read() == first
    sinks.export_tables(rows.filter("series_id = 'a'").withColumn("predicted", F.lit(1.5)), out, "file_row")
    assert read() == [("a", "1,2,1.5"), ("a", "2,,1.5"), ("a", "d,v,predicted_v"), ("b", "1,7,"), ("b", "d,v,predicted_v")]


def _panel(spark, change=None, names=("a", "b", "c", "d"), n=60):
    rng = np.random.default_rng(8)
    rows = [(s, START + dt.timedelta(i), float(round(20 + k + i % 7 + rng.normal(), 3))) for k, s in enumerate(names) for i in range(n)]
    rows = [change(*r) if change else r for r in rows]
    return stage_panel(spark.createDataFrame(rows, "series_id string, ds date, y double"))


def test_only_changed_series_are_fitted_again(spark, tmp_path, monkeypatch):
    path, seen = str(tmp_path / "store"), []
    whole = jobs.benchmark
    monkeypatch.setattr(jobs, "benchmark", lambda panel, *a, **k: seen.append(sorted(r[0] for r in panel.select(KEY).distinct().collect())) or whole(panel, *a, **k))
    table = lambda df: sorted((r.series_id, r.model, r["rank"], round(r.rmse, 9)) for r in df.collect())

    def run(panel, chosen=RIDGES, buckets=3, compare=False):
        out = incremental.refresh(panel, path, chosen, buckets, detect_periods=False)
        if compare:
            assert table(out.scores) == table(whole(panel, chosen, detect_periods=False).scores)
        return sorted(r[0] for r in out.changed.collect())

    assert run(_panel(spark)) == ["a", "b", "c", "d"]
    assert run(_panel(spark)) == [] and len(seen) == 1  # nothing is fitted
    day = START + dt.timedelta(30)
    other = _panel(spark, lambda s, d, y: (s, d, y + 1 if (s, d) == ("b", day) else y))
    assert run(other, compare=True) == ["b"] and seen[-1] == ["b"]
    assert run(other) == []
    assert run(other.filter("series_id <> 'c'")) == [] and run(_panel(spark, names=("a",), n=61)) == ["a"]
    assert run(other.filter("series_id = 'd'"), RIDGES[:1], compare=True) == ["d"]
