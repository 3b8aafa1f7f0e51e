"""Trend queries."""

from pyspark.sql import functions as F

from dayloom.operators import evaluate, trend, trend_state
from dayloom.operators.panel import by_series, known_rows
from dayloom.plans.catalog.base import MIXED_SQL, masked, masked_sql, mixed_panel, query, r, rnd
from dayloom.plans.stage import stage, stage_panel
from dayloom.schema import DAY, KEY, TARGET

MASKED_SQL = masked_sql(MIXED_SQL)


def _det(m):
    if len(m) == 1:
        return f"({m[0][0]})"
    if len(m) == 2:
        return f"(({m[0][0]}) * ({m[1][1]}) - ({m[0][1]}) * ({m[1][0]}))"
    out = []
    for j in range(3):
        minor = [[row[c] for c in range(3) if c != j] for row in m[1:]]
        out.append(f"{'-' if j == 1 else '+'} ({m[0][j]}) * {_det(minor)}")
    return f"({' '.join(out)[2:]})"


def fits_sql(rows, name="fits"):
    """CTEs: polynomial fits of degree 0-2 over relation ``rows`` (series_id, y, t, half)."""
    penalty = [["1", "-1", "1"],
               ["-1", "1 + 1 / (half * half)", "-1 - 2 / (half * half)"],
               ["1", "-1 - 2 / (half * half)", "1 + 4 / (half * half) + 1 / (half * half * half * half)"]]
    cols = []
    for k in (1, 2, 3):
        a = [[f"s{i + j} + 1e-6 * ({penalty[i][j]})" for j in range(k)] for i in range(k)]
        z = []
        for c in range(k):
            top = [[f"q{i}" if j == c else a[i][j] for j in range(k)] for i in range(k)]
            z.append(f"{_det(top)} / NULLIF({_det(a)}, 0)")
        z += ["0.0"] * (3 - k)
        d = k - 1
        cols += [f"({z[0]}) - ({z[1]}) + ({z[2]}) AS c0_{d}",
                 f"(({z[1]}) - 2 * ({z[2]})) / half AS c1_{d}", f"({z[2]}) / (half * half) AS c2_{d}"]
    sums = ", ".join([f"SUM(u ** {i}) AS s{i}" for i in range(5)]
                     + [f"SUM(u ** {i} * y) AS q{i}" for i in range(3)])
    return f"""{name}_u AS (SELECT *, (t - half) / half AS u FROM {rows}),
 {name}_s AS (SELECT series_id, MAX(half) AS half, MIN(t0) AS t0, AVG(y) AS mean_y, {sums}
  FROM {name}_u GROUP BY 1),
 {name} AS (SELECT series_id, t0, mean_y, {', '.join(cols)} FROM {name}_s)"""


def clock_sql(source, name="clock"):
    return f"""{name} AS (SELECT series_id, ds, y, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ds) AS pos,
  COUNT(*) OVER (PARTITION BY series_id) AS n, MIN(ds) OVER (PARTITION BY series_id) AS t0,
  CAST(ds - MIN(ds) OVER (PARTITION BY series_id) AS DOUBLE) AS t,
  GREATEST((MAX(ds) OVER (PARTITION BY series_id) - MIN(ds) OVER (PARTITION BY series_id)) / 2.0, 1.0) AS half
  FROM ({source}) WHERE y IS NOT NULL)"""


def trend_sql(source, p="tr"):
    """CTEs ending in ``<p>``: chosen degree and coefficients per series."""
    early = "(pos <= GREATEST(FLOOR(n * 0.8), 1) OR n < 5)"
    value = "(y - (c0_{d} + c1_{d} * t + c2_{d} * t * t)) ** 2"
    rmse = ", ".join(f"SQRT(AVG({value.format(d=d)})) AS rmse{d}" for d in range(3))
    pick = "CASE degree WHEN 0 THEN {c}_0 WHEN 1 THEN {c}_1 ELSE {c}_2 END"
    return f"""{clock_sql(source, p + '_clock')},
 {p}_early AS (SELECT * FROM {p}_clock WHERE {early}), {fits_sql(p + '_early', p + '_fits')},
 {p}_err AS (SELECT series_id, {rmse} FROM {p}_clock JOIN {p}_fits USING (series_id)
  WHERE NOT {early} GROUP BY 1),
 {p}_n AS (SELECT series_id, MAX(n) AS n FROM {p}_clock GROUP BY 1),
 {p}_d AS (SELECT *, CASE WHEN rmse0 IS NULL THEN 0 WHEN rmse0 <= rmse1 AND rmse0 <= rmse2 THEN 0
  WHEN rmse1 <= rmse2 THEN 1 ELSE 2 END AS degree
  FROM {p}_fits JOIN {p}_n USING (series_id) LEFT JOIN {p}_err USING (series_id)),
 {p} AS (SELECT series_id, t0, n, CAST(degree AS INTEGER) AS degree, rmse0, rmse1, rmse2,
  CASE WHEN rmse0 IS NULL THEN mean_y ELSE {pick.format(c='c0')} END AS c0,
  CASE WHEN rmse0 IS NULL THEN 0 ELSE {pick.format(c='c1')} END AS c1,
  CASE WHEN rmse0 IS NULL THEN 0 ELSE {pick.format(c='c2')} END AS c2 FROM {p}_d)"""


@query("trend_fit", f"""WITH {clock_sql(MASKED_SQL)}, {fits_sql('clock')}
 {' UNION ALL '.join(f"SELECT series_id, {d} AS degree, {r(f'c0_{d}', 2)} AS c0, "
  f"{r(f'c1_{d}', 4)} AS c1, {r(f'c2_{d}', 6)} AS c2 FROM fits" for d in range(3))}""")
def trend_fit(spark, sf_dir):
    fits = trend.polynomial_fits(trend.with_clock(masked(mixed_panel(spark, sf_dir))))
    rows = F.array(*[F.struct(F.lit(d).alias("degree"), F.col(f"fit{d}").alias("c"))
                     for d in range(3)])
    return fits.select(KEY, F.explode(rows).alias("f")).select(
        KEY, "f.degree", rnd("f.c.c0", 2).alias("c0"), rnd("f.c.c1", 4).alias("c1"),
        rnd("f.c.c2", 6).alias("c2"))


_DEGREE_SQL = f"""WITH {trend_sql(MASKED_SQL)} SELECT series_id, t0, n, degree,
 {r('c0', 2)} AS c0, {r('c1', 4)} AS c1, {r('c2', 6)} AS c2,
 {r('rmse0', 2)} AS rmse0, {r('rmse1', 2)} AS rmse1, {r('rmse2', 2)} AS rmse2 FROM tr"""


@query("trend_degree", _DEGREE_SQL)
def trend_degree(spark, sf_dir):
    return _rounded(trend.trend_fit(masked(mixed_panel(spark, sf_dir))))


@query("trend_degree_appended", _DEGREE_SQL)
def trend_degree_appended(spark, sf_dir):
    """The same from kept sums: all but the last days of a series first, then those appended."""
    panel = stage_panel(masked(mixed_panel(spark, sf_dir)))
    late = F.col(DAY) > F.date_sub(F.max(DAY).over(by_series()), 45)
    parts = panel.withColumn("late", late)
    before, after = (trend_state.day_state(parts.filter(cond).drop("late")) for cond in ("NOT late", "late"))
    return _rounded(trend_state.trend_from_state(stage(trend_state.merge_states(stage(before, "trend-state"), after), "trend-state")))


def _rounded(t):
    return t.select(KEY, "t0", "n", "degree", rnd("coef.c0", 2).alias("c0"),
                    rnd("coef.c1", 4).alias("c1"), rnd("coef.c2", 6).alias("c2"),
                    *[rnd(f"rmse{d}", 2).alias(f"rmse{d}") for d in range(3)])


_VALUE = "c0 + c1 * (p.ds - t0) + c2 * (p.ds - t0) * (p.ds - t0)"


@query("trend_extrapolate", f"""WITH {trend_sql(MASKED_SQL)}, days AS ({MIXED_SQL})
 SELECT p.series_id, p.ds, {r(_VALUE, 2)} AS trend FROM days p JOIN tr USING (series_id)""")
def trend_extrapolate(spark, sf_dir):
    panel = stage_panel(masked(mixed_panel(spark, sf_dir)))
    out = trend.trend_extrapolate(panel.select(KEY, DAY), trend.trend_fit(panel))
    return out.withColumn("trend", rnd("trend", 2))


@query("detrended", f"""WITH {trend_sql(MIXED_SQL)}, days AS ({MIXED_SQL})
 SELECT p.series_id, p.ds, {r(f'y - ({_VALUE})', 2)} AS y FROM days p JOIN tr USING (series_id)""")
def detrended(spark, sf_dir):
    panel = stage_panel(mixed_panel(spark, sf_dir))
    return trend.detrend(panel, trend.trend_fit(panel)).withColumn(TARGET, rnd(TARGET, 2))


TRAIN_SQL = f"""SELECT series_id, ds, y FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ds) AS p,
 COUNT(*) OVER (PARTITION BY series_id) AS k FROM ({MIXED_SQL}))
 WHERE k >= 10 AND p <= k - GREATEST(FLOOR(k * 0.2), 1)"""


@query("trend_choice", f"""WITH {trend_sql(TRAIN_SQL, 'a')}, {trend_sql(MIXED_SQL, 'b')}
 SELECT a.series_id, a.t0, GREATEST(a.degree, b.degree) AS degree,
 CASE WHEN a.degree >= b.degree THEN 'train' ELSE 'full' END AS source,
 {r('CASE WHEN a.degree >= b.degree THEN a.c0 ELSE b.c0 END', 2)} AS c0,
 {r('CASE WHEN a.degree >= b.degree THEN a.c1 ELSE b.c1 END', 4)} AS c1,
 {r('CASE WHEN a.degree >= b.degree THEN a.c2 ELSE b.c2 END', 6)} AS c2
 FROM a JOIN b USING (series_id)""")
def trend_choice(spark, sf_dir):
    panel = stage_panel(mixed_panel(spark, sf_dir))
    train = evaluate.time_split(panel).filter("part = 'train'")
    t = trend.trend_choice(train, known_rows(panel))
    return t.select(KEY, "t0", "degree", "source", rnd("coef.c0", 2).alias("c0"),
                    rnd("coef.c1", 4).alias("c1"), rnd("coef.c2", 6).alias("c2"))


@query("trend_label", f"""WITH {trend_sql(MIXED_SQL)} SELECT series_id, degree,
 CASE WHEN degree <= 0 THEN 'none' WHEN degree = 1 THEN 'linear' ELSE 'linear+parabola' END AS label
 FROM tr""")
def trend_label(spark, sf_dir):
    return trend.trend_label(trend.trend_fit(mixed_panel(spark, sf_dir)))
