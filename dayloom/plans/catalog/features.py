"""Feature queries."""

import math

from pyspark.sql import functions as F

from dayloom.operators import features as ops
from dayloom.operators import seasonality
from dayloom.operators.panel import known_rows
from dayloom.plans.catalog.base import (
    LINEITEM_SQL, MASKED_EXOG_SQL, MIXED_SQL, lineitem_daily, masked, masked_exog_panel, masked_sql,
    mixed_panel, query, r, rnd,
)
from dayloom.plans.stage import stage_by_series, stage_panel
from dayloom.schema import DAY, HARMONICS, KEY, LAGS, PERIODS, TARGET, WINDOWS

_W = "OVER (PARTITION BY series_id ORDER BY ds)"
_LAGS = ", ".join(f"LAG(y, {n}) {_W} AS lag{n}" for n in LAGS)
_MEANS = ", ".join(
    f"AVG(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    f" AS ma{w}" for w in WINDOWS)
_T = "CAST(ds - MIN(ds) OVER (PARTITION BY series_id) AS DOUBLE)"
_DOW = ", ".join(
    f"CAST(CASE WHEN isodow(ds) = {i + 1} THEN 1 ELSE 0 END AS DOUBLE) AS dow_{i}"
    for i in range(7))
_PANEL = f"WITH panel AS ({MIXED_SQL})"


def fourier_sql(t="trend", periods=PERIODS, rounded=False):
    terms = []
    for p in periods:
        for k in range(1, HARMONICS + 1):
            angle = f"({t} * {2 * math.pi * k!r} / {float(p)!r})"
            for f in ("sin", "cos"):
                e = f"{f}({angle})"
                terms.append(f"{r(e) if rounded else e} AS fourier_{f}_{p}_{k}")
    return ", ".join(terms)


def features_sql(source, where="TRUE"):
    """CTEs ending in ``feats``: every base feature of the rows of ``source``."""
    return f"""src AS ({source}),
 ordered AS (SELECT *, COUNT(*) OVER (PARTITION BY series_id) AS n_rows, {_LAGS}, {_MEANS},
  {_T} AS trend FROM src WHERE {where}),
 feats AS (SELECT *, {_DOW}, {fourier_sql()} FROM ordered)"""


COMPLETE = " AND ".join(
    ["y IS NOT NULL"] + [f"(n_rows <= {n} OR lag{n} IS NOT NULL)" for n in LAGS]
    + [f"ma{w} IS NOT NULL" for w in WINDOWS])


def _round_all(df, skip=(KEY, DAY, TARGET, "n_rows")):
    return df.select(*[F.col(c) if c in skip else rnd(c).alias(c) for c in df.columns])


def _rounded(names):
    return ", ".join(f"{r(n)} AS {n}" for n in names)


@query("lag_features", f"{_PANEL} SELECT series_id, ds, y, {_LAGS} FROM panel")
def lag_features(spark, sf_dir):
    return ops.lag_features(mixed_panel(spark, sf_dir))


@query("moving_avg", f"""{_PANEL}, m AS (SELECT series_id, ds, y, {_MEANS} FROM panel)
 SELECT series_id, ds, y, {_rounded([f'ma{w}' for w in WINDOWS])} FROM m""")
def moving_avg(spark, sf_dir):
    return _round_all(ops.moving_averages(mixed_panel(spark, sf_dir)))


@query("dow_onehot", f"{_PANEL} SELECT series_id, ds, {_DOW} FROM panel")
def dow_onehot(spark, sf_dir):
    return ops.dow_onehot(mixed_panel(spark, sf_dir))


@query("trend_index", f"{_PANEL} SELECT series_id, ds, {_T} AS trend FROM panel")
def trend_index(spark, sf_dir):
    return ops.trend_features(mixed_panel(spark, sf_dir))


@query("fourier_features", f"""{_PANEL}, t AS (SELECT series_id, ds, {_T} AS trend FROM panel)
 SELECT series_id, ds, {fourier_sql(rounded=True)} FROM t""")
def fourier_features(spark, sf_dir):
    return _round_all(ops.fourier_features(mixed_panel(spark, sf_dir)))


_SEASON_SQL = f"""SELECT series_id, ds, 100 + 10 * sin((ds - DATE '1990-01-01') * {2 * math.pi / 7!r})
 + y / 1e7 AS y FROM ({MIXED_SQL})"""


def seasonal_panel(spark, sf_dir):
    """A weekly wave on the days of the mixed panel, plus a little of its values."""
    t = F.datediff(F.col(DAY), F.lit("1990-01-01").cast("date"))
    y = F.lit(100.0) + 10 * F.sin(t * F.lit(2 * math.pi / 7)) + F.col(TARGET) / 1e7
    return mixed_panel(spark, sf_dir).withColumn(TARGET, y)


def _acf_sql(source):
    return f"""src AS ({source}), whole AS (SELECT series_id, COUNT(*) AS n, AVG(y) AS m,
  list(y ORDER BY ds) AS ys FROM src WHERE y IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= 16),
 c AS (SELECT series_id, n, list_transform(ys, lambda v: v - m) AS d FROM whole),
 lags AS (SELECT *, UNNEST(range(0, LEAST(400, GREATEST(1, n // 2)) + 1)) AS k FROM c),
 acf AS (SELECT series_id, n, CAST(k AS INTEGER) AS k,
  list_inner_product(d[1:n - k], d[k + 1:n]) / list_inner_product(d, d) AS acf FROM lags)"""


@query("acf", f"WITH {_acf_sql(MIXED_SQL)} SELECT series_id, n, k, {r('acf')} AS acf FROM acf")
def acf(spark, sf_dir):
    return seasonality.acf(mixed_panel(spark, sf_dir)).withColumn("acf", rnd("acf"))


_CLASH = ("(abs({a} - {b}) <= 2 OR GREATEST({a}, {b}) % LEAST({a}, {b}) = 0)")
_PERIODS_SQL = f"""{_acf_sql(_SEASON_SQL)},
 sided AS (SELECT *, LAG(acf) OVER w AS before, LEAD(acf) OVER w AS after FROM acf
  WINDOW w AS (PARTITION BY series_id ORDER BY k)),
 ranked AS (SELECT series_id, k, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY acf DESC, k) AS rk
  FROM sided WHERE k >= 2 AND acf > before AND acf > after AND acf > 0.1 AND n >= 3 * k),
 three AS (SELECT series_id, MAX(k) FILTER (rk = 1) AS p1, MAX(k) FILTER (rk = 2) AS p2,
  MAX(k) FILTER (rk = 3) AS p3 FROM ranked GROUP BY 1),
 two AS (SELECT *, p2 IS NOT NULL AND NOT {_CLASH.format(a='p2', b='p1')} AS keep2 FROM three),
 kept AS (SELECT *, p3 IS NOT NULL AND NOT {_CLASH.format(a='p3', b='p1')}
  AND NOT (keep2 AND {_CLASH.format(a='p3', b='p2')}) AS keep3 FROM two),
 counts AS (SELECT series_id, COUNT(y) AS n FROM src GROUP BY 1),
 periods AS (SELECT counts.series_id, counts.n,
  CASE WHEN p1 IS NULL THEN CAST([] AS INTEGER[]) ELSE list_concat([p1],
   CASE WHEN keep2 THEN [p2] ELSE CAST([] AS INTEGER[]) END,
   CASE WHEN keep3 THEN [p3] ELSE CAST([] AS INTEGER[]) END) END AS periods
  FROM counts LEFT JOIN kept USING (series_id))"""


@query("seasonal_periods", f"""WITH {_PERIODS_SQL}
 SELECT series_id, n, array_to_string(periods, ',') AS periods FROM periods""")
def seasonal_periods(spark, sf_dir):
    found = seasonality.seasonal_periods(seasonal_panel(spark, sf_dir))
    return found.withColumn("periods", F.array_join("periods", ","))


@query("merged_periods", f"""WITH {_PERIODS_SQL}
 SELECT series_id, array_to_string(list_concat([7, 30, 365],
  list_filter(periods, lambda p: p NOT IN (7, 30, 365))), ',') AS periods FROM periods""")
def merged_periods(spark, sf_dir):
    found = seasonality.merged_periods(seasonal_panel(spark, sf_dir))
    return found.withColumn("periods", F.array_join("periods", ","))


_BASE = ops.base_feature_names()


@query("feature_matrix", f"""WITH {features_sql(MASKED_EXOG_SQL)}
 SELECT series_id, ds, y, n_rows, {_rounded(_BASE)}, {r('disc')} AS x_disc FROM feats""")
def feature_matrix(spark, sf_dir):
    panel = masked_exog_panel(spark, sf_dir)
    return _round_all(ops.feature_matrix(panel, exog=[F.col("disc").alias("x_disc")]))


_WAVES = 2 * HARMONICS
_LONGEST = "CASE " + " ".join(f"WHEN n > {lag} THEN {lag}" for lag in sorted(LAGS, reverse=True)) + " ELSE 0 END"
_WAVE_SUM = " + ".join(f"{f}({2 * math.pi * k!r} * t / p)" for k in range(1, HARMONICS + 1) for f in ("sin", "cos"))


# The panel's own wave of seven days is a fixed period; eleven is one that has to be found.
def _eleven(sql):
    return sql.replace(repr(2 * math.pi / 7), repr(2 * math.pi / 11))


@query("feature_info_detected", f"""WITH {_eleven(_PERIODS_SQL)},
 known AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ds) AS pos, COUNT(*) OVER (PARTITION BY series_id) AS n,
  CAST(ds - MIN(ds) OVER (PARTITION BY series_id) AS DOUBLE) AS t FROM src WHERE y IS NOT NULL),
 ready AS (SELECT * FROM known WHERE pos > {_LONGEST}),
 more AS (SELECT series_id, list_filter(periods, lambda p: p NOT IN ({', '.join(map(str, PERIODS))})) AS found FROM periods),
 info AS (SELECT series_id, ANY_VALUE(n) AS n_rows, COUNT(*) AS n_complete,
  CAST({' + '.join(f"CAST(ANY_VALUE(n) > {lag} AS INTEGER)" for lag in LAGS)} AS BIGINT) AS n_lags FROM ready GROUP BY 1),
 wave AS (SELECT series_id, SUM({_WAVE_SUM}) AS wave_sum FROM (SELECT series_id, t, UNNEST(found) AS p FROM ready JOIN more USING (series_id)) GROUP BY 1)
 SELECT series_id, n_rows, n_complete, n_lags, {len(WINDOWS)}::BIGINT AS n_windows, 7::BIGINT AS n_dow,
  ({_WAVES} * ({len(PERIODS)} + len(found)))::BIGINT AS n_fourier,
  (n_lags + {len(WINDOWS)} + 8 + {_WAVES} * ({len(PERIODS)} + len(found)))::BIGINT AS n_features, TRUE AS all_named,
  {r('COALESCE(wave_sum, 0.0)', 5)} AS wave_sum FROM info JOIN more USING (series_id) LEFT JOIN wave USING (series_id)""")
def feature_info_detected(spark, sf_dir):
    """Counts of the features that series with periods of their own really have, and the sum of the waves found."""
    t = F.datediff(F.col(DAY), F.lit("1990-01-01").cast("date"))
    y = F.lit(100.0) + 10 * F.sin(t * F.lit(2 * math.pi / 11)) + F.col(TARGET) / 1e7
    panel = stage_panel(mixed_panel(spark, sf_dir).withColumn(TARGET, y))
    named = ops.named_features(panel, stage_by_series(seasonality.merged_periods(panel)))
    fixed = [n for p in PERIODS for n in ops.fourier_names(p)]
    own = F.filter(F.arrays_zip(F.col("names").alias("n"), F.col("x").alias("v")),
                   lambda z: z["n"].startswith("fourier_") & ~F.array_contains(F.array(*[F.lit(n) for n in fixed]), z["n"]))
    waves = named.groupBy(KEY).agg(F.sum(F.aggregate(own, F.lit(0.0), lambda a, z: a + z["v"])).alias("wave_sum"))
    return ops.used_features(named).join(waves, KEY).withColumn("wave_sum", rnd("wave_sum", 5))


_USED = " + ".join(f"(CASE WHEN COUNT(*) > {n} THEN 1 ELSE 0 END)" for n in LAGS)
_FIXED = len(WINDOWS) + 1 + 7 + 2 * HARMONICS * len(PERIODS)


@query("feature_info", f"""{_PANEL} SELECT series_id, COUNT(*) AS n_rows,
 CAST({_USED} AS BIGINT) AS n_lags,
 concat_ws(',', {', '.join(f"CASE WHEN COUNT(*) > {n} THEN '{n}' END" for n in LAGS)}) AS used_lags,
 CAST({len(WINDOWS)} AS BIGINT) AS n_windows, CAST(7 AS BIGINT) AS n_dow,
 CAST({2 * HARMONICS * len(PERIODS)} AS BIGINT) AS n_fourier, CAST(0 AS BIGINT) AS n_exog,
 CAST({_USED} + {_FIXED} AS BIGINT) AS n_features FROM panel GROUP BY 1""")
def feature_info(spark, sf_dir):
    return ops.feature_info(mixed_panel(spark, sf_dir))


def _tail(w):
    return f"list_avg(list_slice(h, GREATEST(len(h) - {w} + 1, 1), len(h)))"


@query("next_day_features", f"""WITH panel AS ({masked_sql(MIXED_SQL)}),
 state AS (SELECT series_id, MIN(ds) AS t0, MAX(ds) AS tn, list(y ORDER BY ds) AS h
  FROM panel WHERE y IS NOT NULL GROUP BY 1),
 dated AS (SELECT *, tn + 1 AS ds, CAST(tn + 1 - t0 AS DOUBLE) AS trend FROM state)
 SELECT series_id, ds,
 {', '.join(f"COALESCE(h[len(h) - {n} + 1], h[len(h)], 0.0) AS lag{n}" if n == 1 else
            f"CASE WHEN len(h) >= {n} THEN h[len(h) - {n} + 1] ELSE h[len(h)] END AS lag{n}"
            for n in LAGS)},
 {', '.join(f"{r(_tail(w))} AS ma{w}" for w in WINDOWS)}, trend, {_DOW},
 {fourier_sql(rounded=True)} FROM dated""")
def next_day_features(spark, sf_dir):
    state = ops.series_state(masked(mixed_panel(spark, sf_dir)))
    return _round_all(ops.next_day_features(state))


@query("complete_rows", f"""WITH {features_sql(MIXED_SQL)}
 SELECT series_id, ds, y, n_rows, {r('ma90')} AS ma90 FROM feats WHERE {COMPLETE}""")
def complete_rows(spark, sf_dir):
    feats = ops.feature_matrix(mixed_panel(spark, sf_dir))
    return ops.complete_rows(feats).select(KEY, DAY, TARGET, "n_rows", rnd("ma90").alias("ma90"))


_SCALED = ("lag1", "ma7", "ma30", "trend", "dow_0")


@query("standard_scale", f"""WITH {features_sql(LINEITEM_SQL)}, used AS (SELECT * FROM feats
  WHERE {COMPLETE}), s AS (SELECT series_id,
 {', '.join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in _SCALED)} FROM used GROUP BY 1)
 SELECT series_id, ds,
 {', '.join(f"{r(f'({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END')} AS {c}" for c in _SCALED)}
 FROM used JOIN s USING (series_id)""")
def standard_scale(spark, sf_dir):
    feats = ops.complete_rows(ops.feature_matrix(known_rows(lineitem_daily(spark, sf_dir))))
    scaled = ops.standard_scale(feats.select(KEY, DAY, *_SCALED), _SCALED)
    return _round_all(scaled)
