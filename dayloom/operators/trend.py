"""Polynomial trend of degree 0-2 per series, from sums in one aggregation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.operators.panel import by_day, known_rows, whole_series
from dayloom.schema import DAY, KEY, MAX_TREND_DEGREE, MIN_TREND_ROWS, TARGET, TREND_RIDGE


def with_clock(panel: DataFrame) -> DataFrame:
    """Known rows with position, count, days since the first day and half the span."""
    full = whole_series()
    t = F.datediff(F.col(DAY), F.first(DAY).over(full))
    span = F.datediff(F.last(DAY).over(full), F.first(DAY).over(full))
    return known_rows(panel).select(
        KEY, DAY, TARGET,
        F.row_number().over(by_day()).alias("pos"),
        F.count(F.lit(1)).over(full).alias("n"),
        F.first(DAY).over(full).alias("t0"),
        t.cast("double").alias("t"),
        F.greatest(span / F.lit(2.0), F.lit(1.0)).alias("half"),
    )


def trend_value(day: Column, coef="coef", t0="t0") -> Column:
    t = F.datediff(day, F.col(t0)).cast("double")
    return F.col(f"{coef}.c0") + F.col(f"{coef}.c1") * t + F.col(f"{coef}.c2") * t * t


def _det(m):
    if len(m) == 1:
        return m[0][0]
    if len(m) == 2:
        return m[0][0] * m[1][1] - m[0][1] * m[1][0]
    minors = [[[row[c] for c in range(3) if c != j] for row in m[1:]] for j in range(3)]
    return m[0][0] * _det(minors[0]) - m[0][1] * _det(minors[1]) + m[0][2] * _det(minors[2])


def fit_sums():
    """Sums of a fit, in u = (t - half) / half: powers of raw day counts lose digits."""
    u = (F.col("t") - F.col("half")) / F.col("half")
    p = [F.lit(1.0), u, u * u, u * u * u, u * u * u * u]
    terms = {f"s{i}": v for i, v in enumerate(p)}
    terms.update({f"q{i}": v * F.col(TARGET) for i, v in enumerate(p[:3])})
    return terms


def fit_columns(max_degree):
    """Closed-form coefficients in t for each degree, from the sums ``s*`` and ``q*``.

    The small ridge belongs to the coefficients in t; ``penalty`` is that ridge carried
    over to u, which keeps the solution the same as solving in t.
    """
    inv = F.lit(1.0) / F.col("half")
    inv2 = inv * inv
    penalty = [
        [F.lit(1.0), F.lit(-1.0), F.lit(1.0)],
        [F.lit(-1.0), 1 + inv2, -1 - 2 * inv2],
        [F.lit(1.0), -1 - 2 * inv2, 1 + 4 * inv2 + inv2 * inv2],
    ]
    zero = F.lit(0.0)
    columns = []
    for k in range(1, max_degree + 2):
        a = [[F.col(f"s{i + j}") + F.lit(TREND_RIDGE) * penalty[i][j] for j in range(k)]
             for i in range(k)]
        q = [F.col(f"q{i}") for i in range(k)]
        det = _det(a)
        z = [
            _det([[q[i] if j == c else a[i][j] for j in range(k)] for i in range(k)])
            / F.when(det != 0, det)
            for c in range(k)
        ] + [zero] * (3 - k)
        columns.append(F.struct(
            (z[0] - z[1] + z[2]).alias("c0"),
            ((z[1] - 2 * z[2]) * inv).alias("c1"),
            (z[2] * inv2).alias("c2"),
        ).alias(f"fit{k - 1}"))
    return columns


def polynomial_fits(rows: DataFrame, max_degree=MAX_TREND_DEGREE) -> DataFrame:
    """Least squares of degree 0..max_degree over clocked rows: one aggregation."""
    sums = rows.groupBy(KEY).agg(
        F.min("t0").alias("t0"), F.max("half").alias("half"), F.max("n").alias("n"),
        *[F.sum(v).alias(name) for name, v in fit_sums().items()],
    )
    return sums.select(KEY, "t0", "n", *fit_columns(max_degree))


def early_rows() -> Column:
    """First 80 % of a series; all of it when too short to compare degrees."""
    split = F.greatest(F.floor(F.col("n") * F.lit(0.8)), F.lit(1))
    return (F.col("pos") <= split) | (F.col("n") < MIN_TREND_ROWS)


def trend_fit(panel: DataFrame, max_degree=MAX_TREND_DEGREE) -> DataFrame:
    """Chosen trend per series: ``(series_id, t0, n, degree, coef, rmse0..)``.

    Degrees are fitted on the first 80 % of known rows and compared on the rest; the
    winner keeps its 80 % coefficients.  Below five rows the trend is the mean.  The
    sums are window sums, so input is read once and shuffled once, without a self-join.
    """
    clocked = with_clock(panel).withColumn("early", early_rows())
    full = whole_series()
    sums = clocked.select(
        "*", F.avg(TARGET).over(full).alias("mean_y"),
        *[F.sum(F.when(F.col("early"), v)).over(full).alias(name)
          for name, v in fit_sums().items()],
    )
    # Only holdout rows are scored; a short series keeps one row to carry its mean.
    scored = sums.filter(~F.col("early") | (F.col("pos") == F.col("n"))).select(
        KEY, TARGET, "t", "t0", "n", "early", "mean_y", *fit_columns(max_degree)
    )
    degrees = range(max_degree + 1)
    t = F.col("t")

    def error(d):
        f = F.col(f"fit{d}")
        e = F.col(TARGET) - (f["c0"] + f["c1"] * t + f["c2"] * t * t)
        return F.when(~F.col("early"), e * e)

    rows = scored.groupBy(KEY).agg(
        F.first("t0").alias("t0"), F.first("n").alias("n"), F.first("mean_y").alias("mean_y"),
        *[F.first(f"fit{d}").alias(f"fit{d}") for d in degrees],
        *[F.sqrt(F.avg(error(d))).alias(f"rmse{d}") for d in degrees],
    )
    return choose_degree(rows, max_degree)


def choose_degree(rows: DataFrame, max_degree=MAX_TREND_DEGREE) -> DataFrame:
    """The fit with the least holdout error from ``fit*`` and ``rmse*``; the mean without any holdout."""
    degrees = range(max_degree + 1)
    options = F.array(*[
        F.struct(F.col(f"rmse{d}").alias("rmse"), F.lit(d).alias("degree"),
                 F.col(f"fit{d}").alias("coef"))
        for d in degrees
    ])
    best = F.array_min(F.filter(options, lambda o: o["rmse"].isNotNull()))
    flat = F.struct(F.col("mean_y").alias("c0"), F.lit(0.0).alias("c1"), F.lit(0.0).alias("c2"))
    return rows.withColumn("best", best).select(
        KEY, "t0", "n",
        F.coalesce(F.col("best.degree"), F.lit(0)).alias("degree"),
        F.coalesce(F.col("best.coef"), flat).alias("coef"),
        *[f"rmse{d}" for d in degrees],
    )


def trend_extrapolate(days: DataFrame, trend: DataFrame) -> DataFrame:
    """Trend value for any (series, day)."""
    return (
        days.join(trend.select(KEY, "t0", "coef"), KEY)
        .withColumn("trend", trend_value(F.col(DAY)))
        .drop("t0", "coef")
    )


def detrend(panel: DataFrame, trend: DataFrame) -> DataFrame:
    with_trend = trend_extrapolate(panel, trend)
    return with_trend.withColumn(TARGET, F.col(TARGET) - F.col("trend")).drop("trend")


def retrend(forecasts: DataFrame, trend: DataFrame, column="yhat") -> DataFrame:
    with_trend = trend_extrapolate(forecasts, trend)
    return with_trend.withColumn(column, F.col(column) + F.col("trend")).drop("trend")


def trend_choice(train: DataFrame, full: DataFrame, leak_free=False) -> DataFrame:
    """Stronger of the train-slice trend and the all-known-rows trend, ties to train.

    The second fit sees test targets; ``leak_free`` keeps the train-slice fit only.
    """
    own = trend_fit(train).select(KEY, "t0", "degree", "coef")
    if leak_free:
        return own.withColumn("source", F.lit("train"))
    other = trend_fit(full).select(
        KEY, F.col("t0").alias("t0_full"), F.col("degree").alias("degree_full"),
        F.col("coef").alias("coef_full"),
    )
    use_own = F.col("degree") >= F.col("degree_full")
    return own.join(other, KEY).select(
        KEY,
        F.when(use_own, F.col("t0")).otherwise(F.col("t0_full")).alias("t0"),
        F.greatest("degree", "degree_full").alias("degree"),
        F.when(use_own, F.col("coef")).otherwise(F.col("coef_full")).alias("coef"),
        F.when(use_own, "train").otherwise("full").alias("source"),
    )


def trend_label(trend: DataFrame) -> DataFrame:
    label = (F.when(F.col("degree") <= 0, "none").when(F.col("degree") == 1, "linear")
             .otherwise("linear+parabola"))
    return trend.select(KEY, "degree", label.alias("label"))
