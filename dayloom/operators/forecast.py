"""Recursive forecasting: every prediction enters the history of the next day.

A linear model splits into a part known in advance (intercept, calendar, exogenous
values, trend) and eight weights on lags and averages of the growing history.  One map
stage advances all series and models of a batch together, day by day; there is no
driver loop over steps and no lineage to cut.  Waves are worked out once for all series of a slice.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.functions import kernels
from dayloom.operators.models import NEIGHBOUR_MODEL, TREND_SUFFIX, _level_pairs, has
from dayloom.operators.panel import by_day, whole_series
from dayloom.schema import DAY, HARMONICS, KEY, LAGS, MEMORY, PERIODS, TARGET, WINDOWS

FORECAST = "series_id string, model string, ds date, y double, yhat double"
_FORECAST_SCHEMA = pa.schema([
    ("series_id", pa.string()), ("model", pa.string()), ("ds", pa.date32()),
    ("y", pa.float64()), ("yhat", pa.float64())])
EPOCH = "1970-01-01"
PATH_CELLS = 2_000_000  # values held at once by a recursion stage, 16 MB; sums of windows take twice as much again


def calendar_gaps(split: DataFrame) -> DataFrame:
    """Every day from the day after training to the last wanted day, gaps marked.

    The recursion passes through all of them; only wanted days are reported.
    """
    bounds = split.groupBy(KEY).agg(
        F.max(F.when(F.col("part") == "train", F.col(DAY))).alias("last_train"),
        F.max(F.when(F.col("part") == "test", F.col(DAY))).alias("last_day"),
    )
    days = bounds.filter(F.col("last_day") > F.col("last_train")).select(
        KEY, F.explode(F.sequence(F.date_add("last_train", 1), F.col("last_day"))).alias(DAY)
    )
    wanted = split.filter("part = 'test'").select(KEY, DAY, F.lit(True).alias("wanted"))
    return days.join(wanted, [KEY, DAY], "left").select(
        KEY, DAY, F.coalesce("wanted", F.lit(False)).alias("wanted")
    )


def recursion_state(split: DataFrame, exog_arrays=None, level_arrays=None, missing_day=None, memory=MEMORY) -> DataFrame:
    """One row per series with all that recursion needs, from a ``part`` column.

    ``hist`` keeps the newest ``memory`` values: no feature may look further back.  Wanted days
    are offsets from the last training day, beside their actual targets, exogenous numbers
    (``exog``, end to end) and names of category levels (``hits``); ``default_hits`` are those of a
    day without a row (``missing_day``, equal on all rows of a series).
    """
    train, test = F.col("part") == "train", F.col("part") == "test"
    extra = [c.alias(n) for c, n in ((exog_arrays, "e"), (level_arrays, "l")) if c is not None]
    # Only the newest rows are gathered: the others count, but no feature sees them.
    n_train = F.count(F.when(train, 1)).over(whole_series())
    place = F.count(F.when(train, 1)).over(by_day())
    rows = split.filter(train | test).withColumn("newest", train & (place > n_train - memory))
    known = F.array_sort(F.collect_list(F.when(F.col("newest"), F.struct(DAY, TARGET))))
    wanted = F.array_sort(F.collect_list(F.when(test, F.struct(DAY, TARGET, *extra))))
    one = rows.groupBy(KEY).agg(
        F.min(F.when(train, F.col(DAY))).alias("start_ds"),
        F.max(F.when(train, F.col(DAY))).alias("last_ds"),
        F.count_if(train).alias("n_train"),
        known.alias("known"), wanted.alias("wanted"),
        F.first(F.array().cast("array<string>") if missing_day is None else missing_day).alias("default_hits"),
    ).filter("last_ds IS NOT NULL AND size(wanted) > 0")
    epoch = F.lit(EPOCH).cast("date")
    return one.select(
        KEY, "n_train",
        F.datediff("start_ds", epoch).alias("start_day"),
        F.datediff("last_ds", epoch).alias("last_day"),
        F.col(f"known.{TARGET}").alias("hist"),
        F.transform("wanted", lambda w: F.datediff(w[DAY], F.col("last_ds"))).alias("offsets"),
        F.col(f"wanted.{TARGET}").alias("actual"),
        (F.flatten(F.col("wanted.e")) if exog_arrays is not None
         else F.array().cast("array<double>")).alias("exog"),
        (F.col("wanted.l") if level_arrays is not None
         else F.array().cast("array<array<string>>")).alias("hits"),
        "default_hits",
    )


def calendar_of(row, horizon):
    day = row.last_day + 1 + np.arange(horizon)
    return kernels.calendar_block((day - row.start_day).astype(float), day, row.periods)


def _exog_block(row, horizon):
    """Numbers of every day up to the horizon; 0 on days without a row."""
    width = len(row.exog) // len(row.offsets)
    block = np.zeros((horizon, width))
    if width:
        block[np.asarray(row.offsets) - 1] = np.reshape(row.exog, (len(row.offsets), -1))
    return block


def _level_days(row, levels, horizon):
    """(day, level number) of the known levels on every day; days without a row have the default ones."""
    number = {name: k for k, name in enumerate(levels)}
    if not number:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    days = [row.default_hits] * horizon
    for offset, names in zip(row.offsets, row.hits):
        days[offset - 1] = names
    pairs = [(h, number[name]) for h, names in enumerate(days) for name in names if name in number]
    return tuple(np.array(pairs, np.int64).reshape(-1, 2).T)


def trend_of(row, horizon):
    t = row.last_day + 1 + np.arange(horizon) - row.start_day
    return row.c0 + row.c1 * t + row.c2 * t * t


def chunks(pdf, paths_per_series):
    """State rows in slices of alike horizon whose path matrix stays small.

    Sorting by horizon keeps short series from being carried along a long one.
    """
    horizon = pdf["offsets"].map(max).to_numpy()
    order = np.argsort(horizon, kind="stable")[::-1]
    start = 0
    while start < len(order):
        longest = int(horizon[order[start]])
        size = max(1, PATH_CELLS // (paths_per_series * (MEMORY + longest)))
        yield longest, list(pdf.iloc[order[start:start + size]].itertuples(index=False))
        start += size


def emit(rows, owners, labels, paths):
    """Forecast rows on wanted days: one path per (owner series, model label)."""
    offsets = [np.asarray(r.offsets) for r in rows]
    actual = [np.asarray(r.actual, dtype=float) for r in rows]
    counts = np.array([len(offsets[o]) for o in owners])
    steps = np.concatenate([offsets[o] for o in owners])
    path = np.repeat(np.arange(len(owners)), counts)
    last_day = np.array([r.last_day for r in rows])[owners]
    keys = np.array([r.series_id for r in rows], dtype=object)[owners]
    y = np.concatenate([actual[o] for o in owners])
    return pa.RecordBatch.from_arrays([
        pa.array(np.repeat(keys, counts), pa.string()),
        pa.array(np.repeat(np.asarray(labels, dtype=object), counts), pa.string()),
        pa.array((np.repeat(last_day, counts) + steps).astype(np.int32)).view(pa.date32()),
        pa.array(y, pa.float64(), mask=np.isnan(y)),
        pa.array(paths[path, steps - 1], pa.float64()),
    ], names=["series_id", "model", "ds", "y", "yhat"])


def _plain_part(first_t, weekday, weights, lift, horizon):
    """Intercept, trend, weekday and polynomial ``lift`` of paths on every day, one row per path.

    ``weights``: trend, seven weekdays, intercept; ``first_t`` and ``weekday`` are those of the first day.
    """
    h = np.arange(horizon)
    c0, c1, c2 = lift.T
    t, slope = first_t, weights[:, 0]
    dow = np.take_along_axis(weights[:, 1:8], (weekday[:, None] + np.arange(7)) % 7, axis=1)
    own = np.column_stack([weights[:, 8] + slope * t + c0 + c1 * t + c2 * t * t, slope + c1 + 2.0 * c2 * t, c2, dow])
    return own @ np.vstack([np.ones(horizon), h, h * h, *(h % 7 == i for i in range(7))])


def _wave_tables(rows, horizon):
    """A function from a row to the waves of its periods, a table with one column a day for each part of them."""
    age = [r.last_day + 1 - r.start_day for r in rows]
    start, tables = min(age), {}
    t = np.arange(start, max(age) + horizon)

    def waves(row):
        at = row.last_day + 1 - row.start_day - start
        periods, fixed = tuple(row.periods), len(PERIODS)
        for key in (periods[:fixed], *((p,) for p in periods[fixed:])):
            if key not in tables:
                tables[key] = np.ascontiguousarray(kernels.calendar_block(t.astype(float), t, key)[:, 8:].T)
            yield tables[key][:, at:at + horizon]

    return waves


def _linear_walker(names, add_trend, lags, windows):
    """Map stage over state rows joined with weights; a series walks the models it wants."""
    def alike(rows):
        """Places of the rows whose weights have one layout, and walk the same models."""
        found = {}
        for i, row in enumerate(rows):
            own = tuple(k for k, m in enumerate(names) if has(getattr(row, "wanted", -1), m))
            if own:
                used = sum(row.n_train > n for n in lags)
                found.setdefault((row.d, used, len(row.periods), len(getattr(row, "levels", ())), row.degree > 0, own), []).append(i)
        return found.items()

    def walk_chunk(longest, rows):
        base, recent, labels, owners = [], [], [], []
        waves = _wave_tables(rows, longest)
        for (d, used, n_periods, n_levels, sloped, own), at in alike(rows):
            some, variants = [rows[i] for i in at], (0, 1) if sloped else (0,)
            w = np.stack([r.weights for r in some]).reshape(len(at), len(names), 2, d + 1)[:, own][:, :, variants]
            paths = w.reshape(-1, d + 1)
            each = len(own) * len(variants)
            calendar = used + len(windows)
            end = calendar + 8 + 2 * HARMONICS * n_periods
            lift = np.zeros((len(at), len(own), len(variants), 3))
            if sloped and add_trend:
                lift[:, :, 1] = np.array([(r.c0, r.c1, r.c2) for r in some])[:, None]
            first = np.array([r.last_day + 1 for r in some])
            fixed = _plain_part(
                np.repeat(first - np.array([r.start_day for r in some]), each).astype(float), np.repeat((first + 3) % 7, each),
                np.hstack([paths[:, calendar:calendar + 8], paths[:, d:]]), lift.reshape(-1, 3), longest)
            for k, row in enumerate(some):
                mine = slice(k * each, (k + 1) * each)
                wave = calendar + 8
                for table in waves(row):
                    fixed[mine] += paths[mine, wave:wave + len(table)] @ table
                    wave += len(table)
                if d - n_levels > end:
                    fixed[mine] += paths[mine, end:d - n_levels] @ _exog_block(row, longest).T
                if n_levels:
                    day, level = _level_days(row, list(row.levels), longest)
                    np.add.at(fixed[mine].T, day, paths[mine, d - n_levels + level].T)
            r = np.zeros((len(paths), len(lags) + len(windows)))
            r[:, :used] = paths[:, :used]
            r[:, len(lags):] = paths[:, used:calendar]
            base.append(fixed)
            recent.append(r)
            labels += [names[k] + (TREND_SUFFIX if v else "") for k in own for v in variants] * len(at)
            owners += np.repeat(at, each).tolist()
        if not owners:
            return None
        base, recent = np.ascontiguousarray(np.concatenate(base).T), np.ascontiguousarray(np.concatenate(recent).T)
        paths = kernels.walk([rows[o].hist for o in owners], longest,
                             lambda h, z: base[h] + (z.T * recent).sum(axis=0), lags, windows)
        return emit(rows, owners, labels, paths)

    def run(batches):
        for batch in batches:
            for longest, rows in chunks(batch.to_pandas(), 2 * len(names)):
                if (out := walk_chunk(longest, rows)) is not None:
                    yield out

    return run


def walk_forward_linear(state: DataFrame, weights: DataFrame, names,
                        add_trend=True, lags=LAGS, windows=WINDOWS) -> DataFrame:
    """Recursive forecasts of all linear models: ``(series_id, model, ds, y, yhat)``.

    ``names`` are the models in weight order; without ``weights`` the state carries its
    own ``d`` and ``weights``.  ``state`` has ``periods``, ``degree``
    and the trend coefficients ``c0..c2``.
    """
    joined = state if weights is None else state.join(weights.drop("n", "rounds"), KEY)
    walker = _linear_walker(list(names), add_trend, lags, windows)
    return joined.mapInArrow(walker, FORECAST)


def walk_forward_knn(state: DataFrame, vectors: DataFrame, k=5,
                     add_trend=True, lags=LAGS, windows=WINDOWS) -> DataFrame:
    """Recursive nearest-neighbour forecast; a series and its train rows share a task.

    Category columns add to a squared distance the levels that only one of the two rows has.
    """
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        paths, labels, rows = [], [], []
        if left.num_rows and right.num_rows:
            right = right.sort_by("ds")
            n = right.num_rows
            x = np.asarray(right["x"].combine_chunks().flatten()).reshape(n, -1)
            levels, at, column = _level_pairs(right)
            own = np.bincount(at, minlength=n).astype(float)
            by_level = np.argsort(column, kind="stable")
            at, first = at[by_level], np.searchsorted(column[by_level], np.arange(len(levels) + 1))
            row = next(left.to_pandas().itertuples(index=False))
            rows = [row]
            longest = int(max(row.offsets))
            used = sum(row.n_train > m for m in lags)
            picks = list(range(used)) + [len(lags) + i for i in range(len(windows))]
            known = np.column_stack([calendar_of(row, longest), _exog_block(row, longest)])
            day, level = _level_days(row, levels, longest)

            def apart(h):
                """Levels that differ from those of day h; a level no row has is the same for all rows."""
                shared = np.zeros(n)
                for one in level[day == h]:
                    shared[at[first[one]:first[one + 1]]] += 2.0
                return own - shared

            for column, suffix in ((TARGET, ""), ("detrended", TREND_SUFFIX)):
                if suffix and row.degree <= 0:
                    continue
                y = right[column].to_numpy()
                lift = (trend_of(row, longest) if suffix and add_trend else np.zeros(longest))

                def step(h, z):
                    q = np.concatenate([z[0, picks], known[h]])
                    return kernels.nearest_mean(x, y, q, k, apart(h) if levels else 0.0) + lift[h]

                paths.append(kernels.walk([row.hist], longest, step, lags, windows)[0])
                labels.append(NEIGHBOUR_MODEL + suffix)
        if not paths:
            return _FORECAST_SCHEMA.empty_table()
        batch = emit(rows, [0] * len(paths), labels, np.stack(paths))
        return pa.Table.from_batches([batch], schema=_FORECAST_SCHEMA)

    # Fresh column identities: both sides may come from the same panel.
    own = state.toDF(*state.columns)
    return own.groupBy(KEY).cogroup(
        vectors.select(KEY, DAY, TARGET, "detrended", "x", *[c for c in vectors.columns if c == "levels"]).groupBy(KEY)
    ).applyInArrow(run, FORECAST)


def flat_fallback(forecasts: DataFrame, wanted: DataFrame, panel: DataFrame) -> DataFrame:
    """Last observed target where a model gave nothing: ``wanted`` is (series, model, ds)."""
    last = panel.filter(F.col(TARGET).isNotNull()).groupBy(KEY).agg(
        F.max_by(TARGET, DAY).alias("last_y")
    )
    given = forecasts.select(KEY, "model", DAY, "yhat")
    return (
        wanted.join(given, [KEY, "model", DAY], "left")
        .join(last, KEY, "left")
        .select(KEY, "model", DAY,
                F.coalesce(F.when(~F.isnan("yhat"), F.col("yhat")), "last_y", F.lit(0.0))
                .alias("yhat"))
    )
