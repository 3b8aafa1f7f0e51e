"""Plot-table queries: trend lines of the known rows as the models shown."""

from dayloom.operators import evaluate, plotdata, trend
from dayloom.operators.panel import known_rows
from dayloom.plans.catalog.base import MIXED_SQL, masked, masked_sql, mixed_panel, query, r, rnd
from dayloom.plans.catalog.evaluation import forecasts_sql, trend_forecasts
from dayloom.plans.catalog.trends import trend_sql
from dayloom.plans.stage import stage_panel

_KNOWN = f"SELECT * FROM ({masked_sql(MIXED_SQL)}) WHERE y IS NOT NULL"
_SHOWN = f"""raw AS ({masked_sql(MIXED_SQL)}), {forecasts_sql(_KNOWN)},
 first_test AS (SELECT series_id, MIN(ds) AS split_ds FROM split WHERE part = 'test' GROUP BY 1),
 dated AS (SELECT raw.*, split_ds FROM raw JOIN first_test USING (series_id)),
 shown AS (SELECT series_id, ds, y FROM dated WHERE ds >= split_ds
  UNION ALL SELECT series_id, MAX(ds), ARG_MAX(y, ds) FROM dated WHERE ds < split_ds GROUP BY 1)"""
_BOUNDS = f"""{_SHOWN}, vals AS (SELECT series_id, ds, y AS v FROM shown
  UNION ALL SELECT series_id, ds, yhat FROM fc),
 lim AS (SELECT series_id, MIN(v) AS lo, MAX(v) AS hi, MAX(ds) AS last_day FROM vals GROUP BY 1)"""


def _shown(spark, sf_dir):
    panel = stage_panel(masked(mixed_panel(spark, sf_dir)))
    split_days = evaluate.first_test_day(evaluate.time_split(panel))
    return panel, split_days, plotdata.visible(panel, split_days)


@query("plot_visible", f"WITH {_SHOWN} SELECT series_id, ds, y FROM shown")
def plot_visible(spark, sf_dir):
    return _shown(spark, sf_dir)[2]


@query("plot_bounds", f"""WITH {_BOUNDS} SELECT series_id, {r('lo - (hi - lo) * 0.05', 2)} AS y_min,
 {r('hi + (hi - lo) * 0.05', 2)} AS y_max, last_day FROM lim""")
def plot_bounds(spark, sf_dir):
    panel, _, shown = _shown(spark, sf_dir)
    out = plotdata.bounds(shown, trend_forecasts(known_rows(panel)))
    return out.withColumns({"y_min": rnd("y_min", 2), "y_max": rnd("y_max", 2)})


@query("plot_connected", f"""WITH {_SHOWN}, lastp AS (SELECT series_id, MAX(ds) AS ds,
  ARG_MAX(y, ds) AS y FROM shown WHERE y IS NOT NULL GROUP BY 1)
 SELECT DISTINCT fc.series_id, model, lastp.ds, {r('lastp.y', 2)} AS yhat, TRUE AS anchor
  FROM fc JOIN lastp USING (series_id)
 UNION ALL SELECT series_id, model, ds, {r('yhat', 2)}, FALSE FROM fc""")
def plot_connected(spark, sf_dir):
    panel, _, shown = _shown(spark, sf_dir)
    out = plotdata.connected(shown, trend_forecasts(known_rows(panel)))
    return out.withColumn("yhat", rnd("yhat", 2))


@query("plot_trend", f"""WITH {_BOUNDS}, {trend_sql(_KNOWN)}
 SELECT d.series_id, d.ds,
 {r('c0 + c1 * (d.ds - tr.t0) + c2 * (d.ds - tr.t0) * (d.ds - tr.t0)', 2)} AS trend
 FROM dated d JOIN tr USING (series_id) JOIN lim USING (series_id)
 WHERE d.ds >= split_ds AND d.ds <= last_day""")
def plot_trend(spark, sf_dir):
    panel, split_days, shown = _shown(spark, sf_dir)
    limits = plotdata.bounds(shown, trend_forecasts(known_rows(panel)))
    out = plotdata.trend_overlay(panel, trend.trend_fit(panel), split_days, limits)
    return out.withColumn("trend", rnd("trend", 2))
