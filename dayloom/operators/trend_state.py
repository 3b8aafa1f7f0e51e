"""Trend fits from sums that are kept and merged as days are appended.

A series is held as blocks of 64 calendar days, each with the power sums of its days and values.
Values are whole ticks (four decimals), so every sum is an exact integer and does not depend on
the order or the batches in which days arrived: a fit of merged states equals a fit of all days bit
for bit.  Fitting reads the sums of all blocks and the days of one block per series, the one in which
the first 80 % end.
"""

from functools import reduce
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayloom.operators.panel import known_rows
from dayloom.operators.trend import choose_degree, fit_columns
from dayloom.schema import DAY, KEY, MAX_TREND_DEGREE, MIN_TREND_ROWS, TARGET

BLOCK = 64
TICKS = 10_000
EXACT = "decimal(38,0)"
DAYS = [f"o{k}" for k in range(5)]       # sums of the day's place in its block, to the power k
VALUES = [f"q{k}" for k in range(3)]     # the same times the value


def _exact(c):
    return c.cast(EXACT)


def _power(c, k):
    return reduce(lambda a, b: _exact(a * b), [c] * k, _exact(F.lit(1)))


def day_state(panel: DataFrame) -> DataFrame:
    """State of the known rows of a panel: one row per series and block of days.

    Values are rounded to four decimals.  A day is expected once per series over all states.
    """
    day = F.datediff(DAY, F.lit("1970-01-01").cast("date"))
    rows = known_rows(panel).select(
        KEY, F.floor(day / BLOCK).cast("int").alias("block"), F.pmod(day, F.lit(BLOCK)).alias("o"), day.alias("day"),
        _exact(F.round(F.col(TARGET) * TICKS)).alias("v"))
    o, v = _exact(F.col("o")), F.col("v")
    return rows.groupBy(KEY, "block").agg(
        *[_exact(F.sum(_power(o, k))).alias(n) for k, n in enumerate(DAYS)],
        *[_exact(F.sum(_exact(_power(o, k) * v))).alias(n) for k, n in enumerate(VALUES)],
        _exact(F.sum(_exact(v * v))).alias("vv"), F.min("day").alias("first"), F.max("day").alias("last"),
        F.array_sort(F.collect_list(F.struct("o", "v"))).alias("days"))


def merge_states(one: DataFrame, other: DataFrame) -> DataFrame:
    """State of the days of both."""
    return one.unionByName(other).groupBy(KEY, "block").agg(
        *[_exact(F.sum(n)).alias(n) for n in (*DAYS, *VALUES, "vv")], F.min("first").alias("first"), F.max("last").alias("last"),
        F.array_sort(F.flatten(F.collect_list("days"))).alias("days"))


def _moved(sums, shift, scale=1):
    """Sums of (scale o + shift)^k from those of o^k, exactly."""
    return [reduce(lambda a, b: _exact(a + b), [
        _exact(_exact(_power(shift, k - j) * F.lit(comb(k, j) * scale ** j)) * sums[j]) for j in range(k + 1)])
        for k in range(len(sums))]


def _of_days(days, day_power, with_value):
    """Sum over (o, v) entries of o^power, or of that times v."""
    def term(e):
        p = _power(_exact(e["o"]), day_power)
        return _exact(p * e["v"]) if with_value else p

    return F.aggregate(days, _exact(F.lit(0)), lambda a, e: _exact(a + term(e)))


def trend_from_state(state: DataFrame, max_degree=MAX_TREND_DEGREE) -> DataFrame:
    """What ``trend_fit`` gives for the days of a state: (series_id, t0, n, degree, coef, rmse0..)."""
    whole, before = Window.partitionBy(KEY), Window.partitionBy(KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    count = F.col("o0").cast("bigint")
    blocks = state.select(
        "*", F.sum(count).over(whole).alias("n"), F.min("first").over(whole).alias("start"), F.max("last").over(whole).alias("end"),
        F.coalesce(F.sum(count).over(before), F.lit(0)).alias("passed"))
    split = F.when(F.col("n") < MIN_TREND_ROWS, F.col("n")).otherwise(F.greatest(F.floor(F.col("n") * F.lit(0.8)), F.lit(1)))
    blocks = blocks.withColumn("early", F.least(F.greatest(split - F.col("passed"), F.lit(0)), count).cast("int"))
    head = F.slice("days", F.lit(1), F.col("early"))

    def early(name, k, with_value):
        """Of a block's sum, the part of its first ``early`` days; only a block that is cut looks at days."""
        return F.when(F.col("early") == 0, _exact(F.lit(0))).when(F.col("early") == count, F.col(name)).otherwise(
            _of_days(head, k, with_value))

    zero = _exact(F.lit(0))
    squares = F.when(F.col("early") == 0, zero).when(F.col("early") == count, F.col("vv")).otherwise(
        F.aggregate(head, zero, lambda a, e: _exact(a + _exact(e["v"] * e["v"]))))
    span = F.greatest(F.col("end") - F.col("start"), F.lit(2))
    blocks = blocks.select(
        KEY, "n", "start", _exact(span).alias("span"), _exact(F.col("block") * BLOCK - F.col("start")).alias("shift"), *DAYS, *VALUES, "vv",
        *[early(n, k, False).alias(f"e_{n}") for k, n in enumerate(DAYS)],
        *[early(n, k, True).alias(f"e_{n}") for k, n in enumerate(VALUES)], squares.alias("e_vv"))
    # the fit's clock is (2 t - span) / span: whole numbers until the last division
    clock = _exact(2 * F.col("shift") - F.col("span"))
    late = {n: _exact(F.col(n) - F.col(f"e_{n}")) for n in (*DAYS, *VALUES, "vv")}
    fit_days = _moved([F.col(f"e_{n}") for n in DAYS], clock, 2)
    fit_values = _moved([F.col(f"e_{n}") for n in VALUES], clock, 2)
    test_days = _moved([late[n] for n in DAYS], F.col("shift"))
    test_values = _moved([late[n] for n in VALUES], F.col("shift"))
    sums = blocks.select(
        KEY, "n", "start", "span", F.col("q0").alias("total"), late["vv"].alias("lvv"),
        *[c.alias(f"w{k}") for k, c in enumerate(fit_days)], *[c.alias(f"x{k}") for k, c in enumerate(fit_values)],
        *[c.alias(f"t{k}") for k, c in enumerate(test_days)], *[c.alias(f"y{k}") for k, c in enumerate(test_values)])
    added = [c for c in sums.columns if c not in (KEY, "n", "start", "span")]
    per = sums.groupBy(KEY).agg(F.first("n").alias("n"), F.first("start").alias("start"), F.first("span").alias("span"),
                                *[_exact(F.sum(c)).alias(c) for c in added])
    width, ticks = F.col("span").cast("double"), F.lit(float(TICKS))
    down = lambda c, k: c.cast("double") / F.pow(width, F.lit(float(k)))
    # held-out values around their mean in whole ticks, still exact, so that their squares keep their digits
    middle = _exact(F.round(F.col("total") / F.col("n")))
    centred = [_exact(F.col(f"y{k}") - _exact(middle * F.col(f"t{k}"))) for k in range(3)]
    square = _exact(F.col("lvv") - _exact(2 * _exact(middle * F.col("y0"))) + _exact(_exact(middle * middle) * F.col("t0")))
    rows = per.select(
        KEY, "n", F.date_add(F.lit("1970-01-01").cast("date"), F.col("start")).alias("first_day"), (width / 2).alias("half"),
        *[down(F.col(f"w{k}"), k).alias(f"s{k}") for k in range(5)], *[(down(F.col(f"x{k}"), k) / ticks).alias(f"q{k}") for k in range(3)],
        *[F.col(f"t{k}").cast("double").alias(f"t{k}") for k in range(5)], *[(c.cast("double") / ticks).alias(f"y{k}") for k, c in enumerate(centred)],
        (square.cast("double") / (ticks * ticks)).alias("yy"), (middle.cast("double") / ticks).alias("middle"),
        (F.col("total").cast("double") / ticks / F.col("n")).alias("mean_y"))
    fits = rows.select("*", *fit_columns(max_degree))

    def rmse(d):
        c0, c1, c2 = F.col(f"fit{d}.c0") - F.col("middle"), F.col(f"fit{d}.c1"), F.col(f"fit{d}.c2")
        t, y = [F.col(f"t{k}") for k in range(5)], [F.col(f"y{k}") for k in range(3)]
        rest = (F.col("yy") - 2 * (c0 * y[0] + c1 * y[1] + c2 * y[2]) + c0 * c0 * t[0] + 2 * c0 * c1 * t[1]
                + (c1 * c1 + 2 * c0 * c2) * t[2] + 2 * c1 * c2 * t[3] + c2 * c2 * t[4])
        return F.when(t[0] > 0, F.sqrt(F.greatest(rest, F.lit(0.0)) / t[0])).alias(f"rmse{d}")

    degrees = range(max_degree + 1)
    return choose_degree(fits.select(
        KEY, F.col("first_day").alias("t0"), "n", "mean_y", *[f"fit{d}" for d in degrees], *[rmse(d) for d in degrees]), max_degree)
