"""Time features. Everything ordered shares one window, hence one shuffle and one sort."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.operators.panel import by_day, by_series, whole_series
from dayloom.schema import DAY, HARMONICS, KEY, LAGS, PERIODS, TARGET, WINDOWS


def lag_name(n):
    return f"lag{n}"


def ma_name(n):
    return f"ma{n}"


def dow_name(i):
    return f"dow_{i}"


def fourier_names(period, harmonics=HARMONICS):
    return [f"fourier_{f}_{period}_{k}" for k in range(1, harmonics + 1) for f in ("sin", "cos")]


def base_feature_names(lags=LAGS, windows=WINDOWS, periods=PERIODS, harmonics=HARMONICS):
    names = [lag_name(n) for n in lags] + [ma_name(n) for n in windows] + ["trend"]
    names += [dow_name(i) for i in range(7)]
    for p in periods:
        names += fourier_names(p, harmonics)
    return names


def n_rows() -> Column:
    return F.count(F.lit(1)).over(whole_series())


def lag_columns(lags=LAGS):
    """Earlier targets by row position; a lag no row can reach stays NULL throughout."""
    return [F.lag(TARGET, n).over(by_day()).alias(lag_name(n)) for n in lags]


def moving_average_columns(windows=WINDOWS):
    """Means of the preceding rows only, so a row never sees its own target."""
    return [F.avg(TARGET).over(by_day().rowsBetween(-w, -1)).alias(ma_name(w)) for w in windows]


def trend_index() -> Column:
    return F.datediff(F.col(DAY), F.first(DAY).over(whole_series())).cast("double").alias("trend")


def dow_columns(day=DAY):
    """Monday is 0; always seven columns."""
    return [(F.weekday(F.col(day)) == i).cast("double").alias(dow_name(i)) for i in range(7)]


def fourier_columns(t: Column, periods=PERIODS, harmonics=HARMONICS):
    out = []
    for p in periods:
        for k in range(1, harmonics + 1):
            angle = t * F.lit(2.0 * math.pi * k) / F.lit(float(p))
            out += [F.sin(angle).alias(f"fourier_sin_{p}_{k}"),
                    F.cos(angle).alias(f"fourier_cos_{p}_{k}")]
    return out


def fourier_vector(t: Column, periods: Column, harmonics=HARMONICS) -> Column:
    """Same terms for periods held in an array column (they differ by series)."""
    def terms(p):
        angles = [t * F.lit(2.0 * math.pi * k) / p.cast("double") for k in range(1, harmonics + 1)]
        return F.array(*[f(a) for a in angles for f in (F.sin, F.cos)])

    return F.flatten(F.transform(periods, terms))


def lag_features(panel: DataFrame, lags=LAGS) -> DataFrame:
    return panel.select(KEY, DAY, TARGET, *lag_columns(lags))


def moving_averages(panel: DataFrame, windows=WINDOWS) -> DataFrame:
    return panel.select(KEY, DAY, TARGET, *moving_average_columns(windows))


def dow_onehot(panel: DataFrame) -> DataFrame:
    return panel.select(KEY, DAY, *dow_columns())


def trend_features(panel: DataFrame) -> DataFrame:
    return panel.select(KEY, DAY, trend_index())


def fourier_features(panel: DataFrame, periods=PERIODS, harmonics=HARMONICS) -> DataFrame:
    base = trend_features(panel)
    return base.select(KEY, DAY, *fourier_columns(F.col("trend"), periods, harmonics))


def feature_matrix(panel: DataFrame, lags=LAGS, windows=WINDOWS, periods=PERIODS,
                   harmonics=HARMONICS, exog=()) -> DataFrame:
    """Wide feature frame in model order; ``exog`` are ready projections to append."""
    exog = list(exog)
    ordered = panel.select(
        "*", n_rows().alias("n_rows"), *lag_columns(lags), *moving_average_columns(windows),
        trend_index(),
    )
    return ordered.select(
        KEY, DAY, TARGET, "n_rows",
        *[lag_name(n) for n in lags], *[ma_name(w) for w in windows], "trend",
        *dow_columns(), *fourier_columns(F.col("trend"), periods, harmonics), *exog,
    )


def complete_rows(features: DataFrame, lags=LAGS) -> DataFrame:
    """Rows whose used features and target are all present.

    A lag only counts when the series is longer than it; dropping on every NULL would
    empty all shorter series.
    """
    cond = F.col(TARGET).isNotNull()
    lag_cols = {lag_name(n): n for n in lags}
    for c in features.columns:
        if c in lag_cols:
            cond = cond & ((F.col("n_rows") <= lag_cols[c]) | F.col(c).isNotNull())
        elif c not in (KEY, DAY, TARGET, "n_rows"):
            cond = cond & F.col(f"`{c}`").isNotNull()
    return features.filter(cond)


def feature_vectors(panel: DataFrame, periods: Column = None, exog=None, extra=(),
                    lags=LAGS, windows=WINDOWS, harmonics=HARMONICS) -> DataFrame:
    """Model-edge form: complete rows only, features of one row as ``x`` ARRAY<DOUBLE>.

    The array holds just the lags the series is long enough for, and the Fourier
    terms of its own periods (array column as made by ``merge_periods``), so its length
    may differ between series but never within one.  ``exog`` is an array of exogenous numbers.
    """
    keep = [c if isinstance(c, Column) else F.col(c) for c in extra]
    ordered = panel.select(
        "*", n_rows().alias("n_rows"), *lag_columns(lags), *moving_average_columns(windows),
        trend_index(),
    )
    used = sum((F.when(F.col("n_rows") > n, 1).otherwise(0) for n in lags), F.lit(0))
    t = F.col("trend")
    fourier = F.array(*fourier_columns(t, PERIODS, harmonics))
    if periods is not None:
        # The fixed periods come first in every list; only the rest varies by series.
        n_fixed = len(PERIODS)
        detected = F.slice(periods, n_fixed + 1, F.greatest(F.size(periods) - n_fixed, F.lit(0)))
        fourier = F.concat(fourier, fourier_vector(t, detected, harmonics))
    known_lags = F.slice(F.array(*[F.col(lag_name(n)) for n in lags]), F.lit(1), used)
    parts = [
        known_lags,
        F.array(*[F.col(ma_name(w)) for w in windows], t, *dow_columns()),
        fourier,
    ] + ([exog] if exog is not None else [])
    x = F.concat(*parts)
    # Calendar values are known where the day is, so they are worked out for complete rows only.
    complete = F.col(TARGET).isNotNull() & t.isNotNull() & F.forall(known_lags, lambda e: e.isNotNull())
    for entry in [F.col(ma_name(w)) for w in windows] + ([periods] if periods is not None else []):
        complete = complete & entry.isNotNull()
    for entries in ([periods] if periods is not None else []) + ([exog] if exog is not None else []):
        complete = complete & F.forall(entries, lambda e: e.isNotNull())
    return ordered.filter(complete).select(KEY, DAY, TARGET, "n_rows", *keep, x.alias("x"))


def vector_names(periods: Column, n_rows="n_rows", lags=LAGS, windows=WINDOWS, harmonics=HARMONICS) -> Column:
    """Names of the entries of ``feature_vectors`` for a series of ``n_rows`` with its own ``periods``, in their order."""
    used = sum((F.when(F.col(n_rows) > n, 1).otherwise(0) for n in lags), F.lit(0))
    waves = F.flatten(F.transform(periods, lambda p: F.array(*[
        F.concat(F.lit(f"fourier_{f}_"), p.cast("string"), F.lit(f"_{k}")) for k in range(1, harmonics + 1) for f in ("sin", "cos")])))
    fixed = [ma_name(w) for w in windows] + ["trend"] + [dow_name(i) for i in range(7)]
    return F.concat(F.slice(F.array(*[F.lit(lag_name(n)) for n in lags]), F.lit(1), used), F.array(*[F.lit(n) for n in fixed]), waves)


def named_features(panel: DataFrame, periods: DataFrame) -> DataFrame:
    """(series_id, ds, y, n_rows, names, x): complete rows; each series has the features it is long enough and periodic for.

    ``periods(series_id, periods)`` lists the Fourier periods of each series, the fixed ones first.
    """
    rows = feature_vectors(panel.join(periods.select(KEY, "periods"), KEY), periods=F.col("periods"), extra=("periods",))
    return rows.select(KEY, DAY, TARGET, "n_rows", vector_names(F.col("periods")).alias("names"), "x")


def used_features(named: DataFrame) -> DataFrame:
    """Features of each kind that the rows of ``named_features`` really hold, one row per series."""
    def kind(prefix):
        return F.size(F.filter("names", lambda n: n.startswith(prefix))).cast("bigint")

    per = named.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_complete"), F.first("n_rows").alias("n_rows"), F.first("names").alias("names"),
                                 F.min(F.size("x")).alias("narrow"), F.max(F.size("x")).alias("wide"))
    return per.select(KEY, "n_rows", "n_complete", kind("lag").alias("n_lags"), kind("ma").alias("n_windows"), kind("dow_").alias("n_dow"),
                      kind("fourier_").alias("n_fourier"), F.col("wide").cast("bigint").alias("n_features"),
                      ((F.col("narrow") == F.size("names")) & (F.col("wide") == F.size("names"))).alias("all_named"))


def feature_info(panel: DataFrame, lags=LAGS, windows=WINDOWS, periods=PERIODS,
                 harmonics=HARMONICS, n_exog=0) -> DataFrame:
    """How many features of each kind a series gets."""
    rows = F.count(F.lit(1))
    used = sum((F.when(rows > n, 1).otherwise(0) for n in lags), F.lit(0))
    fixed = len(windows) + 1 + 7 + 2 * harmonics * len(periods) + n_exog
    used_names = F.concat_ws(",", *[F.when(rows > n, F.lit(str(n))) for n in lags])
    return panel.groupBy(KEY).agg(
        rows.alias("n_rows"),
        used.cast("bigint").alias("n_lags"),
        used_names.alias("used_lags"),
        F.lit(len(windows)).cast("bigint").alias("n_windows"),
        F.lit(7).cast("bigint").alias("n_dow"),
        F.lit(2 * harmonics * len(periods)).cast("bigint").alias("n_fourier"),
        F.lit(n_exog).cast("bigint").alias("n_exog"),
        (used + fixed).cast("bigint").alias("n_features"),
    )


def standard_scale(rows: DataFrame, columns) -> DataFrame:
    """Per-series z-scores with the population deviation; a constant column divides by 1.

    Means are window aggregates over the series, so the rows are read once and stay in
    the partitioning the feature windows gave them.
    """
    columns = list(columns)
    rest = [c for c in rows.columns if c not in columns and c != KEY]
    stats = rows.select(
        "*", *[F.avg(c).over(by_series()).alias(f"{c}__mean") for c in columns],
        *[F.stddev_pop(c).over(by_series()).alias(f"{c}__std") for c in columns],
    )

    def scaled(c):
        std, centred = F.col(f"{c}__std"), F.col(c) - F.col(f"{c}__mean")
        constant = std <= F.abs(F.col(f"{c}__mean")) * 1e-14
        return F.when(constant, centred).otherwise(centred / F.when(~constant, std)).alias(c)

    return stats.select(KEY, *rest, *[scaled(c) for c in columns])


def series_state(panel: DataFrame) -> DataFrame:
    """One row per series: first and last day, row count and the ordered targets."""
    ordered = F.array_sort(F.collect_list(F.struct(DAY, TARGET)))
    return (
        panel.filter(F.col(TARGET).isNotNull())
        .groupBy(KEY)
        .agg(F.min(DAY).alias("start_ds"), F.max(DAY).alias("last_ds"),
             F.count(F.lit(1)).alias("n_train"), ordered.alias("pairs"))
        .select(KEY, "start_ds", "last_ds", "n_train",
                F.col(f"pairs.{TARGET}").alias("hist"))
    )


def next_day_features(state: DataFrame, day: Column = None, lags=LAGS, windows=WINDOWS,
                      periods=PERIODS, harmonics=HARMONICS) -> DataFrame:
    """Features of one future day from history: short history falls back to the last value."""
    hist, size = F.col("hist"), F.size("hist")
    target = F.date_add(F.col("last_ds"), 1) if day is None else day
    last = F.try_element_at(hist, F.lit(-1))

    def lag_value(n):
        return F.coalesce(F.try_element_at(hist, F.lit(-n)), last, F.lit(0.0)).alias(lag_name(n))

    def tail_mean(w):
        tail = F.slice(hist, F.greatest(size - w + 1, F.lit(1)), F.lit(w))
        total = F.aggregate(tail, F.lit(0.0), lambda a, v: a + v)
        return F.when(size > 0, total / F.greatest(F.least(size, F.lit(w)), F.lit(1))) \
            .otherwise(0.0).alias(ma_name(w))

    dated = state.withColumn("target_ds", target)
    t = F.datediff(F.col("target_ds"), F.col("start_ds")).cast("double")
    return dated.select(
        KEY, F.col("target_ds").alias(DAY), *[lag_value(n) for n in lags],
        *[tail_mean(w) for w in windows], t.alias("trend"), *dow_columns("target_ds"),
        *fourier_columns(t, periods, harmonics),
    )
