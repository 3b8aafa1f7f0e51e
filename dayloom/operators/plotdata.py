"""Tables behind the forecast chart: what is visible, its bounds, joined-up lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.operators.trend import trend_extrapolate
from dayloom.schema import DAY, KEY, TARGET

PADDING = 0.05


def visible(panel: DataFrame, split_days: DataFrame, has_future=True, only_test=True) -> DataFrame:
    """Rows from the split on, with the last training row when a future line joins on."""
    if not only_test:
        return panel.select(KEY, DAY, TARGET)
    dated = panel.select(KEY, DAY, TARGET).join(split_days.select(KEY, "split_ds"), KEY)
    shown = dated.filter(F.col(DAY) >= F.col("split_ds")).drop("split_ds")
    if not has_future:
        return shown
    anchor = (
        dated.filter(F.col(DAY) < F.col("split_ds"))
        .groupBy(KEY).agg(F.max_by(F.struct(DAY, TARGET), DAY).alias("r"))
        .select(KEY, f"r.{DAY}", f"r.{TARGET}")
    )
    return anchor.unionByName(shown)


def bounds(shown: DataFrame, *forecasts: DataFrame) -> DataFrame:
    """Axis range over actuals and shown forecasts, widened by 5 % on each side."""
    values = shown.select(KEY, DAY, F.col(TARGET).alias("v"))
    for f in forecasts:
        values = values.unionByName(f.select(KEY, DAY, F.col("yhat").alias("v")))
    pad = (F.col("hi") - F.col("lo")) * PADDING
    return (
        values.groupBy(KEY)
        .agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max(DAY).alias("last_day"))
        .select(KEY, (F.col("lo") - pad).alias("y_min"), (F.col("hi") + pad).alias("y_max"),
                "last_day")
    )


def connected(shown: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Forecast lines with the last known actual put in front of each."""
    last = shown.filter(F.col(TARGET).isNotNull()).groupBy(KEY).agg(
        F.max(DAY).alias(DAY), F.max_by(TARGET, DAY).alias("yhat")
    )
    lines = forecasts.select(KEY, "model").distinct()
    start = lines.join(last, KEY).select(KEY, "model", DAY, "yhat", F.lit(True).alias("anchor"))
    body = forecasts.select(KEY, "model", DAY, "yhat", F.lit(False).alias("anchor"))
    return start.unionByName(body)


def trend_overlay(panel: DataFrame, trend: DataFrame, split_days: DataFrame,
                  limits: DataFrame) -> DataFrame:
    """Trend values between the split and the last visible day."""
    return (
        trend_extrapolate(panel.select(KEY, DAY), trend)
        .join(split_days.select(KEY, "split_ds"), KEY)
        .join(limits.select(KEY, "last_day"), KEY)
        .filter((F.col(DAY) >= F.col("split_ds")) & (F.col(DAY) <= F.col("last_day")))
        .select(KEY, DAY, "trend")
    )
