"""Model and forecasting queries."""

import math

from pyspark.sql import functions as F

from dayloom.operators import evaluate, exog, features, forecast, models
from dayloom.operators.panel import by_series, daily_panel
from dayloom.plans import benchmark as jobs
from dayloom.plans.catalog.base import (
    LINEITEM_SQL, MIXED_SQL, ORDERS_SQL, exog_panel, lineitem_daily, lineitem_wide, masked, masked_exog_panel,
    masked_sql, mixed_panel, orders_daily, query, r, rnd, table,
)
from dayloom.plans.catalog.evaluation import split_sql
from dayloom.plans.catalog.features import COMPLETE, features_sql
from dayloom.plans.stage import stage_by_series, stage_panel
from dayloom.schema import DAY, HARMONICS, KEY, LAGS, PERIODS, TARGET, WINDOWS
from dayloom.sources.sinks import join_predictions

_FIXED = 1 + 7 + 2 * HARMONICS * len(PERIODS)
_FEATURES = features.base_feature_names()
RIDGES = ("Ridge (alpha=0.5)", "Ridge (alpha=2.0)")


def _plain_state(split):
    """Recursion state with the fixed periods and no trend."""
    zero = {f"c{i}": F.lit(0.0) for i in range(3)}
    return forecast.recursion_state(split).withColumns(
        {"periods": F.array(*[F.lit(p) for p in PERIODS]), "degree": F.lit(0), **zero})


def _ma7_walk(split):
    """The linear walk with weight one on the seven-day average and zero elsewhere."""
    state = _plain_state(split)
    used = sum((F.when(F.col("n_train") > n, 1).otherwise(0) for n in LAGS), F.lit(0))
    one = F.concat(F.array_repeat(F.lit(0.0), used), F.array(F.lit(1.0)),
                   F.array_repeat(F.lit(0.0), len(WINDOWS) - 1 + _FIXED + 1))
    weighted = state.withColumns(
        {"d": used + len(WINDOWS) + _FIXED, "weights": F.concat(one, one)})
    return forecast.walk_forward_linear(weighted, None, ["ma7"])


def _ma7_sql(split):
    """CTEs ending in ``walk`` (series_id, ds, yhat) for days after the last train day."""
    return f"""tr AS (SELECT series_id, MAX(ds) AS tn, list(y ORDER BY ds) AS all_y
  FROM {split} WHERE part = 'train' GROUP BY 1),
 goal AS (SELECT series_id, MAX(ds) AS last_ds FROM {split} WHERE part = 'test' GROUP BY 1),
 seed AS (SELECT series_id, tn, last_ds, list_slice(all_y, GREATEST(len(all_y) - 6, 1), len(all_y)) AS h
  FROM tr JOIN goal USING (series_id)),
 steps AS (SELECT series_id, tn AS ds, last_ds, h, CAST(NULL AS DOUBLE) AS yhat FROM seed
  UNION ALL SELECT series_id, ds + 1, last_ds,
   CASE WHEN len(h) < 7 THEN list_append(h, list_avg(h)) ELSE list_append(h[2:7], list_avg(h)) END,
   list_avg(h) FROM steps WHERE ds < last_ds),
 walk AS (SELECT series_id, ds, yhat FROM steps WHERE yhat IS NOT NULL)"""


@query("walk_forward_ma7", f"""WITH RECURSIVE {split_sql(MIXED_SQL)}, {_ma7_sql('split')}
 SELECT series_id, 'ma7' AS model, ds, y, {r('yhat', 4)} AS yhat FROM walk
 JOIN split USING (series_id, ds) WHERE part = 'test'""")
def walk_forward_ma7(spark, sf_dir):
    out = _ma7_walk(evaluate.time_split(mixed_panel(spark, sf_dir)))
    return out.withColumn("yhat", rnd("yhat", 4))


@query("calendar_gaps", f"""WITH {split_sql(MIXED_SQL)}, b AS (SELECT series_id,
  MAX(ds) FILTER (part = 'train') AS tn, MAX(ds) FILTER (part = 'test') AS te FROM split GROUP BY 1),
 days AS (SELECT series_id, CAST(UNNEST(generate_series(tn + 1, te, INTERVAL 1 DAY)) AS DATE) AS ds
  FROM b WHERE te > tn)
 SELECT d.series_id, d.ds, s.ds IS NOT NULL AS wanted FROM days d
 LEFT JOIN (SELECT * FROM split WHERE part = 'test') s ON s.series_id = d.series_id AND s.ds = d.ds""")
def calendar_gaps(spark, sf_dir):
    return forecast.calendar_gaps(evaluate.time_split(stage_panel(mixed_panel(spark, sf_dir))))


def _future_split_sql(source):
    return f"""fpanel AS (SELECT *, MAX(CASE WHEN y IS NOT NULL THEN ds END)
  OVER (PARTITION BY series_id) AS lo FROM ({source})),
 fsplit AS (SELECT series_id, ds, y, CASE WHEN y IS NOT NULL THEN 'train'
  WHEN ds > lo THEN 'test' END AS part FROM fpanel)"""


_MASKED = masked_sql(MIXED_SQL)


@query("predictions_joined", f"""WITH RECURSIVE {_future_split_sql(_MASKED)}, {_ma7_sql('fsplit')}
 SELECT p.series_id, strftime(p.ds, '%d/%m/%Y') AS date, p.y AS y,
 {r('w.yhat', 4)} AS predicted_y FROM fpanel p
 LEFT JOIN (SELECT walk.* FROM walk JOIN fsplit USING (series_id, ds) WHERE part = 'test') w
  ON w.series_id = p.series_id AND w.ds = p.ds""")
def predictions_joined(spark, sf_dir):
    panel = stage_panel(masked(mixed_panel(spark, sf_dir)))
    best = _ma7_walk(jobs.as_future_split(panel)).drop("y")
    return join_predictions(panel, best.withColumn("yhat", rnd("yhat", 4)), "y")


@query("flat_fallback", f"""WITH RECURSIVE {_future_split_sql(_MASKED)}, {_ma7_sql('fsplit')},
 lasts AS (SELECT series_id, ARG_MAX(y, ds) AS last_y FROM fpanel WHERE y IS NOT NULL GROUP BY 1)
 SELECT f.series_id, 'ma7' AS model, f.ds,
 CASE WHEN day(f.ds) % 2 = 1 THEN {r('w.yhat', 4)} ELSE last_y END AS yhat
 FROM fsplit f JOIN walk w USING (series_id, ds) JOIN lasts USING (series_id)
 WHERE part = 'test'""")
def flat_fallback(spark, sf_dir):
    panel = stage_panel(masked(mixed_panel(spark, sf_dir)))
    split = jobs.as_future_split(panel)
    # The model answers on odd days of the month only.
    given = _ma7_walk(split).filter(F.dayofmonth(DAY) % 2 == 1)
    wanted = split.filter("part = 'test'").select(KEY, F.lit("ma7").alias("model"), DAY)
    out = forecast.flat_fallback(given.withColumn("yhat", rnd("yhat", 4)), wanted, panel)
    return out


_DISTANCE = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _FEATURES)


@query("knn_one_step", f"""WITH {features_sql(LINEITEM_SQL)},
 ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ds) AS p FROM feats),
 ready AS (SELECT *, CASE WHEN p > n_rows - GREATEST(FLOOR(n_rows * 0.2), 1) THEN 'test'
  ELSE 'train' END AS part FROM ranked WHERE {COMPLETE}),
 near AS (SELECT a.series_id, a.ds, a.y, b.y AS ny, ROW_NUMBER() OVER (PARTITION BY a.series_id, a.ds
  ORDER BY {_DISTANCE}, b.ds) AS rk FROM ready a JOIN ready b ON a.series_id = b.series_id
  WHERE a.part = 'test' AND b.part = 'train')
 SELECT series_id, ds, y, {r('AVG(ny)', 4)} AS yhat FROM near WHERE rk <= 5 GROUP BY 1, 2, 3""")
def knn_one_step(spark, sf_dir):
    split = evaluate.time_split(stage_panel(lineitem_daily(spark, sf_dir))).drop("n_known")
    rows = features.feature_vectors(split, extra=("part",))
    out = models.knn_one_step(rows.filter("part = 'train'"), rows.filter("part = 'test'"))
    return out.withColumn("yhat", rnd("yhat", 4))


def _train_vectors(panel):
    train = evaluate.time_split(panel).filter("part = 'train'").drop("part", "n_known")
    return features.feature_vectors(train.withColumn("detrended", F.col(TARGET)),
                                    extra=("detrended",))


def _fit_query(name, chosen):
    """Coefficients by series; no SQL counterpart, optimality is tested on fixtures."""
    @query(name)
    def run(spark, sf_dir):
        weights = models.fit_linear(_train_vectors(lineitem_daily(spark, sf_dir)), chosen)
        table = models.coefficients(weights, chosen).filter(~F.endswith("model", F.lit("+Trend")))
        return table.select(KEY, "model", "n", "intercept", F.posexplode("coef").alias("i", "coef"))

    return run


_fit_query("ridge_fit", RIDGES)
_fit_query("lasso_fit", ("Lasso (alpha=0.1)",))
_fit_query("elastic_net_fit", ("ElasticNet (alpha=0.01, l1=0.7)",))
_fit_query("bayesian_ridge_fit", ("BayesianRidge",))
_fit_query("sgd_objective_fit", ("SGD",))
_fit_query("huber_fit", ("Huber (epsilon=1.35)",))
_fit_query("linear_svr_fit", ("SVR (Linear)", "LinearSVR"))


@query("walk_forward_ridge")
def walk_forward_ridge(spark, sf_dir):
    panel = stage_panel(lineitem_daily(spark, sf_dir))
    split = evaluate.time_split(panel)
    weights = models.fit_linear(_train_vectors(panel), RIDGES)
    return forecast.walk_forward_linear(_plain_state(split), weights, RIDGES)


@query("benchmark_models")
def benchmark_models(spark, sf_dir):
    return jobs.benchmark(stage_panel(lineitem_daily(spark, sf_dir))).scores


@query("benchmark_trees")
def benchmark_trees(spark, sf_dir):
    return jobs.benchmark(stage_panel(lineitem_daily(spark, sf_dir)), tuple(models.TREE_MODELS)).scores


@query("benchmark_exog")
def benchmark_exog(spark, sf_dir):
    return jobs.benchmark(stage_panel(exog_panel(spark, sf_dir)), RIDGES).scores


@query("benchmark_wide")
def benchmark_wide(spark, sf_dir):
    return jobs.benchmark(stage_panel(lineitem_wide(spark, sf_dir)), RIDGES + (
        "Lasso (alpha=0.1)",)).scores


@query("future_forecast")
def future_forecast(spark, sf_dir):
    return jobs.forecast_future(stage_panel(masked_exog_panel(spark, sf_dir)), RIDGES)


@query("future_forecast_trend")
def future_forecast_trend(spark, sf_dir):
    return jobs.forecast_future_trend(stage_panel(masked(lineitem_daily(spark, sf_dir))), RIDGES)


@query("future_top3")
def future_top3(spark, sf_dir):
    panel = stage_panel(masked(lineitem_daily(spark, sf_dir)))
    chosen = RIDGES + ("BayesianRidge", "SGD")
    scores = jobs.benchmark(panel, chosen).scores
    return jobs.future_of_top(panel, scores, chosen)


_CLOSED = ("Ridge (alpha=0.5)", "Ridge (alpha=2.0)", "Lasso (alpha=0.1)", "ElasticNet (alpha=0.01, l1=0.7)", "SGD")
_SHRUNK = "SIGN(c) * GREATEST(ABS(c) - {l1!r}, 0) / (1 + {l2!r}) / s"
# On one feature every quadratic model has a closed form: shrink, then soften.
_WEIGHT = {
    _CLOSED[0]: "sxy / (sxx + 0.5)", _CLOSED[1]: "sxy / (sxx + 2.0)",
    _CLOSED[2]: _SHRUNK.format(l1=0.1, l2=0.0), _CLOSED[3]: _SHRUNK.format(l1=0.01 * 0.7, l2=0.01 * 0.3),
    _CLOSED[4]: "sxy / (sxx * (1 + 0.0001))",
}
_BY_MODEL = " UNION ALL ".join(f"SELECT series_id, n, mx, my, '{m}' AS model, {w} AS w FROM q" for m, w in _WEIGHT.items())


@query("linear_one_feature", f"""WITH panel AS ({MIXED_SQL}),
 p AS (SELECT series_id, CAST(ds - MIN(ds) OVER (PARTITION BY series_id) AS DOUBLE) AS t, y / 1000.0 AS v FROM panel),
 a AS (SELECT *, AVG(t) OVER (PARTITION BY series_id) AS mx, AVG(v) OVER (PARTITION BY series_id) AS my FROM p),
 m AS (SELECT series_id, COUNT(*) AS n, MIN(mx) AS mx, MIN(my) AS my, SUM((t - mx) * (t - mx)) AS sxx,
  SUM((t - mx) * (v - my)) AS sxy FROM a GROUP BY 1),
 q AS (SELECT *, SQRT(sxx / n) AS s, sxy / SQRT(sxx / n) / n AS c FROM m)
 SELECT series_id, model, n, {r('w', 5)} AS coef, {r('my - w * mx', 5)} AS intercept FROM ({_BY_MODEL})""")
def linear_one_feature(spark, sf_dir):
    """The quadratic models on the day number alone, where SQL can solve them too."""
    panel = mixed_panel(spark, sf_dir)
    first = F.min(DAY).over(by_series())
    rows = panel.select(KEY, DAY, F.array(F.datediff(DAY, first).cast("double")).alias("x"),
                        (F.col(TARGET) / 1000.0).alias(TARGET), (F.col(TARGET) / 1000.0).alias("detrended"))
    table = models.coefficients(models.fit_linear(rows, _CLOSED), _CLOSED).filter(~F.endswith("model", F.lit("+Trend")))
    return table.select(KEY, "model", "n", rnd(F.col("coef")[0], 5).alias("coef"), rnd("intercept", 5).alias("intercept"))


_WIDE_MODELS = RIDGES + ("SGD",)
_PARTS_SQL = """SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS ds,
 CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 1000 AS y, MIN(l_partkey) AS part_key FROM lineitem GROUP BY 1, 2"""
# A level's penalty: its count and the penalty weigh it against the other columns.
_PENALTY = {_WIDE_MODELS[0]: ("0.5", "0.5"), _WIDE_MODELS[1]: ("2.0", "2.0"),
            _WIDE_MODELS[2]: ("0.0001 * (tt - t1 * t1 / n)", "0.0001 * c * (1 - c / n)")}
_PENALTIES = " UNION ALL ".join(f"SELECT *, '{m}' AS model, {a} AS pt, {b} AS p FROM lt" for m, (a, b) in _PENALTY.items())


@query("benchmark_exog_wide", f"""WITH panel AS ({_PARTS_SQL}),
 placed AS (SELECT *, CAST(ds - MIN(ds) OVER w AS DOUBLE) AS t, ROW_NUMBER() OVER (w ORDER BY ds) AS pos,
  COUNT(*) OVER w AS n_known FROM panel WINDOW w AS (PARTITION BY series_id)),
 split AS (SELECT *, pos > n_known - GREATEST(FLOOR(n_known * 0.2), 1) AS test FROM placed),
 tot AS (SELECT series_id, CAST(COUNT(*) AS DOUBLE) AS n, SUM(t) AS t1, SUM(t * t) AS tt, SUM(y) AS y1, SUM(t * y) AS ty
  FROM split WHERE NOT test GROUP BY 1),
 lv AS (SELECT series_id, part_key, CAST(COUNT(*) AS DOUBLE) AS c, SUM(t) AS lt1, SUM(y) AS ly1 FROM split WHERE NOT test GROUP BY 1, 2),
 lt AS (SELECT * FROM lv JOIN tot USING (series_id)), l AS ({_PENALTIES}),
 s AS (SELECT series_id, model, ANY_VALUE(n) - SUM(c * c / (c + p)) AS a, ANY_VALUE(t1) - SUM(c * lt1 / (c + p)) AS b,
  ANY_VALUE(tt + pt) - SUM(lt1 * lt1 / (c + p)) AS d, ANY_VALUE(y1) - SUM(c * ly1 / (c + p)) AS e,
  ANY_VALUE(ty) - SUM(lt1 * ly1 / (c + p)) AS f FROM l GROUP BY 1, 2),
 u AS (SELECT *, (a * f - b * e) / (a * d - b * b) AS slope FROM s), v AS (SELECT *, (e - b * slope) / a AS icpt FROM u),
 w AS (SELECT l.series_id, l.model, part_key, (ly1 - icpt * c - slope * lt1) / (c + p) AS weight FROM l JOIN v USING (series_id, model)),
 f AS (SELECT x.series_id, v.model, x.y, icpt + slope * t + COALESCE(weight, 0) AS yhat FROM split x JOIN v USING (series_id)
  LEFT JOIN w ON w.series_id = x.series_id AND w.model = v.model AND w.part_key = x.part_key WHERE test),
 m AS (SELECT series_id, model, COUNT(*) AS n_test, SQRT(AVG((y - yhat) * (y - yhat))) AS rmse FROM f GROUP BY 1, 2)
 SELECT series_id, model, n_test, {r('rmse', 5)} AS rmse,
  CAST(ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY rmse, model) AS INTEGER) AS rank FROM m""")
def benchmark_exog_wide(spark, sf_dir):
    """Day number and one category column with a level per part, ranked on the last days."""
    rows = daily_panel(table(spark, sf_dir, "lineitem"), F.col("l_returnflag"), F.col("l_shipdate"),
                       F.col("l_extendedprice").cast("decimal(18,2)"), part_key=F.min("l_partkey").cast("string"))
    panel = stage_panel(rows.withColumn(TARGET, F.col(TARGET) / 1000))
    kinds = [{"original_name": "part_key", "kind": "categorical"}]
    split = evaluate.time_split(panel).withColumns({
        "t": F.datediff(DAY, F.min(DAY).over(by_series())).cast("double"), "levels": exog.Columns(kinds).levels()})
    train = split.filter("part = 'train'").select(KEY, DAY, TARGET, F.col(TARGET).alias("detrended"), F.array("t").alias("x"), "levels")
    weights = stage_by_series(models.fit_linear(train, _WIDE_MODELS))
    plain = models.coefficients(weights, _WIDE_MODELS).select(KEY, "model", "intercept", F.col("coef")[0].alias("slope"))
    by_level = models.level_weights(weights, _WIDE_MODELS)
    test = split.filter("part = 'test'").select(KEY, DAY, TARGET, "t", F.col("levels")[0].alias("level_name"))
    value = F.col("intercept") + F.col("slope") * F.col("t") + F.coalesce("weight", F.lit(0.0))
    out = test.join(plain, KEY).join(by_level, [KEY, "model", "level_name"], "left").withColumn("yhat", value)
    board = evaluate.leaderboard(evaluate.metrics(out.filter(~F.endswith("model", F.lit(models.TREND_SUFFIX)))))
    return board.select(KEY, "model", "n_test", rnd("rmse", 5).alias("rmse"), "rank")


_REPORTED = f"""{MIXED_SQL} UNION ALL SELECT 'twice' AS series_id, ds, y FROM ({LINEITEM_SQL}) WHERE series_id = 'A'
 UNION ALL SELECT 'twice', ds, y FROM ({LINEITEM_SQL}) WHERE series_id = 'R'
 UNION ALL SELECT * FROM (SELECT 'short' AS series_id, ds, y FROM ({ORDERS_SQL}) WHERE series_id = '1-URGENT' ORDER BY ds LIMIT 9)"""
_USED = " + ".join(f"CAST(n > {lag} AS INTEGER)" for lag in LAGS)
_LONGEST = "CASE " + " ".join(f"WHEN n > {lag} THEN {lag}" for lag in sorted(LAGS, reverse=True)) + " ELSE 0 END"


@query("fit_report", f"""WITH panel AS ({_REPORTED}), d AS (SELECT series_id, ds, COUNT(*) AS rows FROM panel GROUP BY 1, 2),
 s AS (SELECT series_id, SUM(rows)::BIGINT AS n, MAX(rows) AS most FROM d GROUP BY 1),
 c AS (SELECT *, CASE WHEN most > 1 THEN 'several rows on one day' WHEN n < 10 THEN 'fewer than ten known rows' END AS reason FROM s)
 SELECT series_id, model, n - ({_LONGEST}) AS n, CAST({_USED} + {len(WINDOWS) + _FIXED} AS INTEGER) AS d, 1 AS rounds,
  TRUE AS converged, reason FROM c CROSS JOIN (VALUES {', '.join(f"('{m}')" for m in _WIDE_MODELS)}) AS m(model) WHERE reason IS NULL
 UNION ALL SELECT series_id, NULL, n, NULL, 0, FALSE, reason FROM c WHERE reason IS NOT NULL""")
def fit_report(spark, sf_dir):
    """Fits of long and short series, a series with days twice, and one that is too short."""
    lines = lineitem_daily(spark, sf_dir).filter(F.col(KEY).isin("A", "R")).withColumn(KEY, F.lit("twice"))
    first = orders_daily(spark, sf_dir).filter(F.col(KEY) == "1-URGENT").orderBy(DAY).limit(9).withColumn(KEY, F.lit("short"))
    panel = stage_panel(mixed_panel(spark, sf_dir).unionByName(lines).unionByName(first))
    return jobs.fit_report(panel, _WIDE_MODELS, detect_periods=False)


@query("bayesian_one_feature", f"""WITH RECURSIVE panel AS ({MIXED_SQL}),
 p AS (SELECT series_id, CAST(ds - MIN(ds) OVER (PARTITION BY series_id) AS DOUBLE) AS t, y / 1000.0 AS v FROM panel),
 a AS (SELECT *, AVG(t) OVER (PARTITION BY series_id) AS mx, AVG(v) OVER (PARTITION BY series_id) AS my FROM p),
 m AS (SELECT series_id, COUNT(*) AS n, MIN(mx) AS mx, MIN(my) AS my, SUM((t - mx) * (t - mx)) AS sxx,
  SUM((t - mx) * (v - my)) AS sxy, SUM((v - my) * (v - my)) AS syy FROM a GROUP BY 1),
 i AS (SELECT *, 0 AS k, 1 / (syy / n + {2.0 ** -52!r}) AS noise, CAST(1.0 AS DOUBLE) AS prec, CAST(NULL AS DOUBLE) AS before, FALSE AS done FROM m
  UNION ALL SELECT series_id, n, mx, my, sxx, sxy, syy, k + 1,
   CASE WHEN stop THEN noise ELSE (n - eff + 2e-6) / (GREATEST(syy - 2 * w * sxy + w * w * sxx, 0) + 2e-6) END,
   CASE WHEN stop THEN prec ELSE (eff + 2e-6) / (w * w + 2e-6) END, w, stop
  FROM (SELECT *, COALESCE(ABS(w - before) < 1e-3, FALSE) AS stop, noise * sxx / (prec + noise * sxx) AS eff
   FROM (SELECT *, sxy / (sxx + prec / noise) AS w FROM i)) WHERE NOT done AND k < 300),
 f AS (SELECT *, sxy / (sxx + prec / noise) AS w, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY k DESC) AS nth FROM i)
 SELECT series_id, n, {r('w', 5)} AS coef, {r('my - w * mx', 5)} AS intercept FROM f WHERE nth = 1""")
def bayesian_one_feature(spark, sf_dir):
    """Evidence maximisation on the day number alone, its rounds written out in SQL."""
    rows = mixed_panel(spark, sf_dir).select(
        KEY, DAY, F.array(F.datediff(DAY, F.min(DAY).over(by_series())).cast("double")).alias("x"),
        (F.col(TARGET) / 1000.0).alias(TARGET), (F.col(TARGET) / 1000.0).alias("detrended"))
    table = models.coefficients(models.fit_linear(rows, ("BayesianRidge",)), ("BayesianRidge",)).filter("model = 'BayesianRidge'")
    return table.select(KEY, "n", rnd(F.col("coef")[0], 5).alias("coef"), rnd("intercept", 5).alias("intercept"))


# Weights of a linear model on lags, averages, day number, weekday and three of the waves.
_LAG_WEIGHTS = dict(zip(LAGS, (0.3, 0.15, 0.1, 0.05, 0.05)))
_MEAN_WEIGHTS = dict(zip(WINDOWS, (0.1, 0.1, 0.05)))
_WAVE_WEIGHTS = {"fourier_sin_7_1": 50.0, "fourier_cos_30_2": 20.0, "fourier_sin_365_1": 200.0}
_DAY_WEIGHT, _WEEKDAY_WEIGHT, _INTERCEPT = 0.01, 10.0, 5.0


def _weighted_walk(split):
    """The linear walk with given weights on every kind of feature."""
    state = _plain_state(split)
    used = sum((F.when(F.col("n_train") > n, 1).otherwise(0) for n in LAGS), F.lit(0))
    fixed = [*_MEAN_WEIGHTS.values(), _DAY_WEIGHT, *(_WEEKDAY_WEIGHT * i for i in range(7)),
             *(_WAVE_WEIGHTS.get(n, 0.0) for p in PERIODS for n in features.fourier_names(p)), _INTERCEPT]
    one = F.concat(F.slice(F.array(*map(F.lit, _LAG_WEIGHTS.values())), F.lit(1), used), F.array(*map(F.lit, fixed)))
    return forecast.walk_forward_linear(
        state.withColumns({"d": used + len(WINDOWS) + _FIXED, "weights": F.concat(one, one)}), None, ["weighted"])


def _weighted_sql(split):
    """CTEs ending in ``walk``: the same weights, one day a round, on the last 365 values."""
    lags = " + ".join(f"CASE WHEN n_train > {n} THEN {w!r} * h[len(h) - {n - 1}] ELSE 0 END" for n, w in _LAG_WEIGHTS.items())
    means = " + ".join(f"{w!r} * list_avg(h[GREATEST(len(h) - {n - 1}, 1):len(h)])" for n, w in _MEAN_WEIGHTS.items())
    waves = " + ".join(f"{w!r} * {n.split('_')[1]}({2 * math.pi * int(n.split('_')[3])!r} * (ds + 1 - t0) / {float(n.split('_')[2])!r})"
                       for n, w in _WAVE_WEIGHTS.items())
    return f"""tr AS (SELECT series_id, MIN(ds) AS t0, MAX(ds) AS tn, COUNT(*) AS n_train, list(y ORDER BY ds) AS all_y
  FROM {split} WHERE part = 'train' GROUP BY 1),
 goal AS (SELECT series_id, MAX(ds) AS last_ds FROM {split} WHERE part = 'test' GROUP BY 1),
 steps AS (SELECT series_id, t0, n_train, last_ds, tn AS ds, list_slice(all_y, GREATEST(len(all_y) - 364, 1), len(all_y)) AS h,
  CAST(NULL AS DOUBLE) AS yhat FROM tr JOIN goal USING (series_id)
  UNION ALL SELECT series_id, t0, n_train, last_ds, ds + 1, list_slice(list_append(h, z), GREATEST(len(h) - 363, 1), len(h) + 1), z FROM (
   SELECT *, {lags} + {means} + {_DAY_WEIGHT!r} * (ds + 1 - t0) + {_WEEKDAY_WEIGHT!r} * (isodow(ds + 1) - 1) + {waves} + {_INTERCEPT!r} AS z
   FROM steps WHERE ds < last_ds)),
 walk AS (SELECT series_id, ds, yhat FROM steps WHERE yhat IS NOT NULL)"""


@query("walk_forward_weights", f"""WITH RECURSIVE {split_sql(MIXED_SQL)}, {_weighted_sql('split')}
 SELECT series_id, 'weighted' AS model, ds, y, {r('yhat', 3)} AS yhat FROM walk JOIN split USING (series_id, ds) WHERE part = 'test'""")
def walk_forward_weights(spark, sf_dir):
    out = _weighted_walk(evaluate.time_split(stage_panel(mixed_panel(spark, sf_dir))))
    return out.withColumn("yhat", rnd("yhat", 3))


@query("future_weights", f"""WITH RECURSIVE {_future_split_sql(_MASKED)}, {_weighted_sql('fsplit')}
 SELECT series_id, 'weighted' AS model, ds, {r('yhat', 3)} AS yhat FROM walk JOIN fsplit USING (series_id, ds) WHERE part = 'test'""")
def future_weights(spark, sf_dir):
    """Days without a target, each forecast from those before it."""
    out = _weighted_walk(jobs.as_future_split(stage_panel(masked(mixed_panel(spark, sf_dir)))))
    return out.select(KEY, "model", DAY, rnd("yhat", 3).alias("yhat"))
