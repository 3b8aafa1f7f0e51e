"""Split, metric and ranking queries, over the three polynomial trends as models."""

from pyspark.sql import functions as F

from dayloom.operators import evaluate, trend
from dayloom.operators.panel import whole_series
from dayloom.plans.catalog.base import (
    LINEITEM_SQL, MIXED_SQL, WIDE_SQL, lineitem_daily, lineitem_wide, mixed_panel, query, r, rnd,
)
from dayloom.plans.catalog.trends import clock_sql, fits_sql
from dayloom.schema import DAY, KEY, TARGET

MODELS = ("trend0", "trend1", "trend2")


def split_sql(source, name="split"):
    return f"""{name}_n AS (SELECT series_id, ds, y, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ds) AS p,
  COUNT(*) OVER (PARTITION BY series_id) AS n_known FROM ({source}) WHERE y IS NOT NULL),
 {name} AS (SELECT series_id, ds, y, n_known, CASE WHEN n_known < 10 THEN 'reject'
  WHEN p > n_known - GREATEST(FLOOR(n_known * 0.2), 1) THEN 'test' ELSE 'train' END AS part
  FROM {name}_n)"""


def forecasts_sql(source):
    """CTEs ending in ``fc`` (series_id, model, ds, y, yhat)."""
    train = "SELECT series_id, ds, y FROM split WHERE part = 'train'"
    rows = " UNION ALL ".join(
        f"SELECT s.series_id, 'trend{d}' AS model, s.ds, s.y, "
        f"c0_{d} + c1_{d} * (s.ds - t0) + c2_{d} * (s.ds - t0) * (s.ds - t0) AS yhat "
        f"FROM split s JOIN fits USING (series_id) WHERE part = 'test'" for d in range(3))
    return f"{split_sql(source)}, {clock_sql(train)}, {fits_sql('clock')}, fc AS ({rows})"


def trend_forecasts(panel):
    """Each trend degree as a model: fitted on train rows, read off on test rows.

    Fit sums are window sums over the train part, so one read and one shuffle do.
    """
    full = whole_series()
    split = evaluate.time_split(panel).filter("part <> 'reject'")
    train = F.col("part") == "train"
    last_train = F.max(F.when(train, F.col(DAY))).over(full)
    first = F.first(DAY).over(full)
    clocked = split.select(
        KEY, DAY, TARGET, "part",
        F.datediff(F.col(DAY), first).cast("double").alias("t"),
        F.greatest(F.datediff(last_train, first) / F.lit(2.0), F.lit(1.0)).alias("half"),
    )
    sums = clocked.select(
        "*", *[F.sum(F.when(train, v)).over(full).alias(n) for n, v in trend.fit_sums().items()])
    fitted = sums.filter("part = 'test'").select(KEY, DAY, TARGET, "t", *trend.fit_columns(2))
    t = F.col("t")
    options = F.array(*[
        F.struct(F.lit(m).alias("model"),
                 (F.col(f"fit{d}")["c0"] + F.col(f"fit{d}")["c1"] * t
                  + F.col(f"fit{d}")["c2"] * t * t).alias("yhat"))
        for d, m in enumerate(MODELS)
    ])
    return fitted.select(KEY, DAY, TARGET, F.explode(options).alias("o")).select(
        KEY, "o.model", DAY, TARGET, "o.yhat")


@query("time_split", f"""WITH {split_sql(MIXED_SQL)} SELECT * FROM split""")
def time_split(spark, sf_dir):
    return evaluate.time_split(mixed_panel(spark, sf_dir))


@query("trend_forecasts", f"""WITH {forecasts_sql(MIXED_SQL)}
 SELECT series_id, model, ds, y, {r('yhat', 2)} AS yhat FROM fc""")
def trend_forecasts_query(spark, sf_dir):
    return trend_forecasts(mixed_panel(spark, sf_dir)).withColumn("yhat", rnd("yhat", 2))


_METRIC = {
    "rmse": "COALESCE(SQRT(AVG((y - yhat) * (y - yhat))), CAST('inf' AS DOUBLE))",
    "mape": "COALESCE(AVG(CASE WHEN abs(y) > 1e-10 THEN abs(y - yhat) / abs(y) END), 0.0)",
    "smape": """COALESCE(AVG(CASE WHEN abs(y) + abs(yhat) > 1e-10
 THEN 2 * abs(y - yhat) / (abs(y) + abs(yhat)) END), 0.0)""",
    "accuracy_pct": """CASE WHEN MAX(y) = MIN(y) THEN CASE WHEN AVG(abs(y - yhat)) = 0 THEN 100.0 ELSE 0.0 END
 ELSE LEAST(GREATEST(1 - AVG(abs(y - yhat)) / NULLIF(MAX(y) - MIN(y), 0), 0.0), 1.0) * 100 END""",
}


def _metric_query(name, metric, digits):
    sql = f"""WITH {forecasts_sql(MIXED_SQL)} SELECT series_id, model, COUNT(*) AS n_test,
 {r(_METRIC[metric], digits)} AS {metric} FROM fc GROUP BY 1, 2"""

    @query(name, sql)
    def run(spark, sf_dir):
        scores = evaluate.metrics(trend_forecasts(mixed_panel(spark, sf_dir)))
        return scores.select(KEY, "model", "n_test", rnd(metric, digits).alias(metric))

    return run


metric_rmse = _metric_query("metric_rmse", "rmse", 2)
metric_mape = _metric_query("metric_mape", "mape", 6)
metric_smape = _metric_query("metric_smape", "smape", 6)
metric_accuracy = _metric_query("metric_accuracy", "accuracy_pct", 4)


def board_sql(source):
    """CTEs ending in ``board``."""
    scores = ", ".join(f"{e} AS {m}" for m, e in _METRIC.items())
    return f"""{forecasts_sql(source)},
 scores AS (SELECT series_id, model, COUNT(*) AS n_test, {scores} FROM fc GROUP BY 1, 2),
 board AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY rmse, model) AS INTEGER) AS rank
  FROM scores)"""


_BOARD = f"""SELECT series_id, model, rank, {r('rmse', 2)} AS rmse, {r('mape')} AS mape,
 {r('smape')} AS smape, {r('accuracy_pct', 4)} AS accuracy_pct FROM board"""


def trend_leaderboard(panel):
    return evaluate.leaderboard(evaluate.metrics(trend_forecasts(panel)))


def _shown(board):
    return board.select(KEY, "model", "rank", rnd("rmse", 2).alias("rmse"),
                        rnd("mape").alias("mape"), rnd("smape").alias("smape"),
                        rnd("accuracy_pct", 4).alias("accuracy_pct"))


@query("leaderboard", f"WITH {board_sql(LINEITEM_SQL)} {_BOARD}")
def leaderboard(spark, sf_dir):
    return _shown(trend_leaderboard(lineitem_daily(spark, sf_dir)))


@query("leaderboard_wide", f"WITH {board_sql(WIDE_SQL)} {_BOARD}")
def leaderboard_wide(spark, sf_dir):
    return _shown(trend_leaderboard(lineitem_wide(spark, sf_dir)))


@query("top_models", f"""WITH {board_sql(MIXED_SQL)}, firsts AS (SELECT series_id, MIN(ds) AS split_ds
  FROM split WHERE part = 'test' GROUP BY 1)
 SELECT series_id, model, rank, rank = 1 AS is_best, split_ds FROM board JOIN firsts USING (series_id)
 WHERE rank <= 3""")
def top_models(spark, sf_dir):
    rows = trend_forecasts(mixed_panel(spark, sf_dir))
    # The first test day rides along with the scores: no second pass over the panel.
    first = rows.groupBy(KEY, "model").agg(
        F.min(DAY).alias("split_ds"), evaluate.rmse().alias("rmse"))
    top = evaluate.top_models(evaluate.leaderboard(first))
    return top.select(KEY, "model", "rank", (F.col("rank") == 1).alias("is_best"), "split_ds")


@query("benchmark_table", f"""WITH {board_sql(MIXED_SQL)} SELECT series_id, model, rank,
 ROUND(rmse, 3) AS rmse, ROUND(accuracy_pct, 3) AS accuracy_pct, rank <= 3 AS is_top FROM board""")
def benchmark_table(spark, sf_dir):
    return evaluate.benchmark_table(trend_leaderboard(mixed_panel(spark, sf_dir)))
