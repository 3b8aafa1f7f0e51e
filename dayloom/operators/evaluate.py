"""Chronological split, error metrics and ranking."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayloom.operators.panel import by_day, known_rows, whole_series
from dayloom.schema import DAY, KEY, MIN_ROWS, TARGET, TEST_FRACTION, TOP_MODELS

GUARD = 1e-10  # rows this close to zero have no relative error


SHORT, SEVERAL = "fewer than ten known rows", "several rows on one day"


def series_checks(panel: DataFrame) -> DataFrame:
    """(series_id, n_known, reason) of every series; a reason keeps it out of fits.

    Rows are counted by day first, so a series with any number of rows on a day moves as days.
    """
    days = panel.groupBy(KEY, DAY).agg(F.count(F.lit(1)).alias("rows"), F.count(TARGET).alias("known"))
    per = days.groupBy(KEY).agg(F.sum("known").alias("n_known"), F.max("rows").alias("most"))
    reason = F.when(F.col("most") > 1, SEVERAL).when(F.col("n_known") < MIN_ROWS, SHORT)
    return per.select(KEY, "n_known", reason.alias("reason"))


def accepted(panel: DataFrame, checks: DataFrame) -> DataFrame:
    """Rows of the series that ``series_checks`` has no reason against; pass written-down checks, as they are looked at here."""
    lost = checks.filter("reason IS NOT NULL").select(KEY)
    return panel if lost.isEmpty() else panel.join(lost, KEY, "left_anti")


def time_split(panel: DataFrame, test_fraction=TEST_FRACTION) -> DataFrame:
    """Known rows with ``part``: the last share of each series is ``test``.

    Series under ten known rows get ``part = 'reject'`` instead of failing the panel.
    """
    n = F.count(F.lit(1)).over(whole_series())
    test_size = F.greatest(F.floor(F.col("n_known") * F.lit(test_fraction)), F.lit(1))
    part = (
        F.when(F.col("n_known") < MIN_ROWS, "reject")
        .when(F.col("pos") > F.col("n_known") - test_size, "test")
        .otherwise("train")
    )
    return (
        known_rows(panel)
        .withColumns({"pos": F.row_number().over(by_day()), "n_known": n})
        .withColumn("part", part)
        .drop("pos")
    )


def _finite(c):
    return F.when(~F.isnan(c), c)


def rmse():
    err = F.col(TARGET) - _finite(F.col("yhat"))
    return F.coalesce(F.sqrt(F.avg(err * err)), F.lit(float("inf")))


def mape():
    y, err = F.abs(F.col(TARGET)), F.abs(F.col(TARGET) - _finite(F.col("yhat")))
    return F.coalesce(F.avg(F.when(y > GUARD, err / F.when(y > GUARD, y))), F.lit(0.0))


def smape():
    yhat = _finite(F.col("yhat"))
    size = F.abs(F.col(TARGET)) + F.abs(yhat)
    ratio = 2 * F.abs(yhat - F.col(TARGET)) / F.when(size > GUARD, size)
    return F.coalesce(F.avg(ratio), F.lit(0.0))


def accuracy_pct():
    """Share of the test range not lost to the mean absolute error, in percent."""
    yhat = _finite(F.col("yhat"))
    seen = F.when(yhat.isNotNull() & (F.abs(yhat) != float("inf")), F.col(TARGET))
    mae = F.avg(F.abs(seen - yhat))
    span = F.max(seen) - F.min(seen)
    share = F.least(F.greatest(1 - mae / F.when(span != 0, span), F.lit(0.0)), F.lit(1.0)) * 100
    flat = F.when(mae == 0, 100.0).otherwise(0.0)
    return F.coalesce(F.when(span == 0, flat).otherwise(share), F.lit(0.0))


def metrics(forecasts: DataFrame) -> DataFrame:
    """All metrics of ``(series_id, model, ds, y, yhat)`` in one aggregation."""
    return forecasts.groupBy(KEY, "model").agg(
        F.count(F.lit(1)).alias("n_test"),
        rmse().alias("rmse"), mape().alias("mape"), smape().alias("smape"),
        accuracy_pct().alias("accuracy_pct"),
    )


def with_unscored(series: DataFrame, scores: DataFrame) -> DataFrame:
    """Series without any forecast stay in the table, as a failed ``NoModels`` entry."""
    worst = {"model": F.lit("NoModels"), "n_test": F.lit(0), "rmse": F.lit(float("inf")),
             "mape": F.lit(0.0), "smape": F.lit(0.0), "accuracy_pct": F.lit(0.0)}
    return series.select(KEY).join(scores, KEY, "left").withColumns(
        {c: F.coalesce(F.col(c), v) for c, v in worst.items()})


def leaderboard(scores: DataFrame) -> DataFrame:
    """Rank by RMSE within a series; failed models carry infinity and come last."""
    value = F.coalesce(_finite(F.col("rmse")), F.lit(float("inf")))
    w = Window.partitionBy(KEY).orderBy(value, "model")
    return scores.withColumn("rank", F.row_number().over(w))


def top_models(board: DataFrame, n=TOP_MODELS) -> DataFrame:
    return board.filter(F.col("rank") <= n)


def benchmark_table(board: DataFrame, n=TOP_MODELS) -> DataFrame:
    finite = F.col("rmse") != float("inf")
    return board.select(
        KEY, "model", "rank",
        F.when(finite, F.round("rmse", 3)).alias("rmse"),
        F.round("accuracy_pct", 3).alias("accuracy_pct"),
        (F.col("rank") <= n).alias("is_top"),
    )


def first_test_day(split: DataFrame) -> DataFrame:
    return split.filter("part = 'test'").groupBy(KEY).agg(F.min(DAY).alias("split_ds"))
