"""Autocorrelation and the seasonal periods read off it."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.operators.features import series_state
from dayloom.schema import (
    KEY, MAX_PERIOD, MIN_ACF_ROWS, MIN_CYCLES, PEAK_FLOOR, PERIODS, TOP_PERIODS,
)


CELLS = 1 << 19  # values transformed at once, 4 MB


def _autocorrelation(values: np.ndarray, max_lag: int):
    """Autocorrelations of rows of one length; None for a constant one."""
    n = values.shape[1]
    centred = values - values.mean(axis=1, keepdims=True)
    width = 1 << (2 * n - 1).bit_length()
    spectrum = np.fft.rfft(centred, width)
    cov = np.fft.irfft(spectrum * np.conj(spectrum), width)[:, : min(max_lag, max(1, n // 2)) + 1]
    return [row / row[0] if row[0] > 0 else None for row in cov]


def _acf_column(values: Column, max_lag: int) -> Column:
    @F.pandas_udf("array<double>")
    def run(series: pd.Series) -> pd.Series:
        found = np.full(len(series), None, dtype=object)
        size, held = series.map(len).to_numpy(), series.to_numpy()
        for n in np.unique(size):
            alike, step = np.flatnonzero(size == n), max(1, CELLS // (4 * int(n)))
            for at in range(0, len(alike), step):
                some = alike[at:at + step]
                for i, row in zip(some, _autocorrelation(np.stack(held[some]).astype(float), max_lag)):
                    found[i] = row
        return pd.Series(found, index=series.index)

    return run(values)


def acf_arrays(panel: DataFrame, max_lag=MAX_PERIOD) -> DataFrame:
    """One row per series, ``acf`` from lag 0; NULL when too short or constant.

    A series is one bounded array (one value per day), so the transform runs in place
    beside it; a join of the series with its shifted self would ship 400 rows per row.
    """
    inf = F.lit(float("inf"))
    finite = F.filter("hist", lambda v: ~F.isnan(v) & (F.abs(v) != inf))
    state = series_state(panel).select(KEY, finite.alias("values"))
    long_enough = F.size("values") >= MIN_ACF_ROWS
    return state.select(
        KEY, F.size("values").cast("bigint").alias("n"),
        F.when(long_enough, F.col("values")).alias("values"),
    ).transform(lambda df: _with_acf(df, max_lag))


def _with_acf(df: DataFrame, max_lag: int) -> DataFrame:
    long_part = F.coalesce(F.col("values"), F.array(F.lit(0.0)))
    acf = _acf_column(long_part, max_lag)
    return df.withColumn("acf", acf).select(
        KEY, "n", F.when(F.col("values").isNotNull(), F.col("acf")).alias("acf")
    )


def acf(panel: DataFrame, max_lag=MAX_PERIOD) -> DataFrame:
    # The outer form adds no size filter, which would run the Python column twice.
    rows = acf_arrays(panel, max_lag).select(KEY, "n", F.posexplode_outer("acf").alias("k", "acf"))
    return rows.filter("k IS NOT NULL")


def _peaks(acf_col, n, max_period, min_cycles):
    """(acf, lag) of every interior local maximum that is strong and repeats enough."""
    lags = F.sequence(F.lit(2), F.size(acf_col) - 2)

    def at(i):
        return F.element_at(acf_col, (i + 1).cast("int"))

    def is_peak(i):
        v = at(i)
        return ((v > at(i - 1)) & (v > at(i + 1)) & (v > PEAK_FLOOR)
                & (i <= max_period) & (n >= i * min_cycles))

    found = F.filter(lags, is_peak)
    return F.transform(found, lambda i: F.struct((-at(i)).alias("strength"), i.alias("lag")))


def seasonal_periods(panel: DataFrame, max_period=MAX_PERIOD, top_n=TOP_PERIODS,
                     min_cycles=MIN_CYCLES) -> DataFrame:
    """Per series the detected periods, strongest first.

    The ``top_n`` strongest peaks are taken before near and integer-multiple ones are
    dropped, so fewer than ``top_n`` may remain.
    """
    def keep(kept, p):
        clash = F.exists(kept, lambda q: (F.abs(p - q) <= 2)
                         | (F.greatest(p, q) % F.least(p, q) == 0))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(p)))

    enough = F.size("acf") >= 4
    peaks = F.when(enough, _peaks(F.col("acf"), F.col("n"), max_period, min_cycles))
    strongest = F.transform(F.slice(F.array_sort(peaks), 1, top_n), lambda s: s["lag"])
    empty = F.array().cast("array<int>")
    periods = F.coalesce(F.aggregate(strongest, empty, keep), empty)
    return acf_arrays(panel, max_period).select(KEY, "n", periods.alias("periods"))


def merge_periods(detected: Column, fixed=PERIODS) -> Column:
    """Fixed periods first, then detected ones not yet present."""
    base = F.array(*[F.lit(int(p)) for p in fixed])
    return F.filter(F.array_distinct(F.concat(base, detected)), lambda p: p > 1)


def merged_periods(panel: DataFrame, fixed=PERIODS) -> DataFrame:
    return seasonal_periods(panel).select(
        KEY, merge_periods(F.col("periods"), fixed).alias("periods")
    )
