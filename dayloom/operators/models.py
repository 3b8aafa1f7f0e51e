"""Regressors fitted for every series at once.

One map stage over rows that lie series by series.  The complete rows of the series in a batch shrink
together to centred moments (d x d each), which are all that the quadratic models need; stacks of
series of one width are then solved together, so no solver loop runs once per series and no matrix
leaves its task.  Models that need the rows themselves (Huber, linear epsilon-insensitive) are fitted
where the rows are.  Rows of a series are already together after the feature windows, so the
stage adds no shuffle, and a series is at most one row per calendar day.

Category columns come as the names of the levels a row has; a series numbers its own, for a level
it never had can get no weight.  Up to ``DENSE_COLUMNS`` columns they are written out; beyond that
the fit works on the list of ones (``functions.wide``), so any number of levels is fitted.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.functions import kernels, wide
from dayloom.operators.panel import by_series
from dayloom.schema import KEY, TARGET

TREND_SUFFIX = "+Trend"

# Model names with their settings.
MOMENT_MODELS = {
    "Ridge (alpha=0.5)": ("ridge", {"alpha": 0.5}),
    "Ridge (alpha=2.0)": ("ridge", {"alpha": 2.0}),
    "Lasso (alpha=0.1)": ("elastic_net", {"alpha": 0.1, "ratio": 1.0}),
    "ElasticNet (alpha=0.01, l1=0.7)": ("elastic_net", {"alpha": 0.01, "ratio": 0.7}),
    "BayesianRidge": ("bayesian", {}),
    "SGD": ("scaled_ridge", {"alpha": 1e-4}),
}
ROW_MODELS = {
    "Huber (epsilon=1.35)": ("huber", {"epsilon": 1.35, "alpha": 1e-4}),
    "SVR (Linear)": ("insensitive", {"c": 1.0, "epsilon": 0.1, "penalise_intercept": False}),
    "LinearSVR": ("insensitive", {"c": 1.0, "epsilon": 0.0, "penalise_intercept": True}),
}
STACK = 512  # series solved together; a 40-wide Gram matrix stack is then about 7 MB
CELLS = 1 << 20  # values of a stack of rows or matrices held at once, 8 MB
LINEAR_MODELS = tuple(MOMENT_MODELS) + tuple(ROW_MODELS)
NEIGHBOUR_MODEL = "KNN (n_neighbors=5)"
TREE_MODELS = {
    "GB (n_estimators=100)": ("boosting", {"trees": 100, "depth": 3}),
    "DecisionTree": ("tree", {"depth": 10}),
}
ALL_MODELS = LINEAR_MODELS + (NEIGHBOUR_MODEL,) + tuple(TREE_MODELS)

DENSE_COLUMNS = 256  # widest series whose category columns are written out

_WEIGHTS = ("series_id string, n bigint, d int, wanted bigint, levels array<string>, weights array<double>, "
            "rounds array<int>")
_FITTED = pa.schema([
    ("series_id", pa.string()), ("n", pa.int64()), ("d", pa.int32()), ("wanted", pa.int64()), ("levels", pa.list_(pa.string())),
    ("weights", pa.list_(pa.float64())), ("rounds", pa.list_(pa.int32()))])
_STACKED = ("n", "mean_x", "scale_x", "mean_y", "gram", "cross", "yy", "row_weights", "row_rounds")


def linear_order(models):
    """Order in which weights of the chosen linear models are stored."""
    return [m for m in MOMENT_MODELS if m in models] + [m for m in ROW_MODELS if m in models]


def wanted_mask(models) -> int:
    """The models as bits, by their place in ``ALL_MODELS``."""
    return sum(1 << ALL_MODELS.index(m) for m in set(models))


def wants(model):
    """Whether a row's ``wanted`` mask has the model."""
    return F.col("wanted").bitwiseAND(F.lit(wanted_mask([model]))) != 0


def has(mask, model):
    return model not in ALL_MODELS or bool(mask >> ALL_MODELS.index(model) & 1)


def _matrix(column, n):
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False)).reshape(n, -1)


def _scale(x):
    centre, spread = x.mean(axis=0), x.std(axis=0)
    return centre, np.where(_is_flat(spread, centre), 1.0, spread)


def _is_flat(spread, centre):
    return spread <= 1e-14 * np.maximum(np.abs(centre), 1.0)


def _or_nan(fit, d):
    """A fit that fails leaves NaN weights: its forecasts score infinity and rank last."""
    try:
        return fit()
    except np.linalg.LinAlgError:
        return np.full(d, np.nan)


def _row_fit(kind, params, x, y):
    """Weights then intercept, and the rounds taken; negative rounds ran out."""
    log = []

    def fit():
        w, b = getattr(kernels, kind)(x, y, log=log, **params)
        return np.append(w, b)

    return _or_nan(fit, x.shape[1] + 1), (log or [-1])[0]


def _level_pairs(table):
    """(names, rows, columns): the levels of a series in order, and the ones of their 0/1 matrix."""
    if "levels" not in table.column_names:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists = table["levels"].combine_chunks()
    flat = lists.flatten().dictionary_encode()
    names = flat.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    size = np.diff(lists.offsets.to_numpy())
    return [names[i] for i in order], np.repeat(np.arange(len(lists)), size), place[flat.indices.to_numpy()]


_WIDE = {"ridge": lambda d, y, p: wide.ridge(d, y, p["alpha"]), "scaled_ridge": lambda d, y, p: wide.scaled_ridge(d, y, p["alpha"]),
         "elastic_net": lambda d, y, p: wide.elastic_net(d, y, p["alpha"] * p["ratio"], p["alpha"] * (1 - p["ratio"])),
         "bayesian": lambda d, y, p: wide.bayesian_ridge(d, y), "huber": lambda d, y, p: wide.huber(d, y, **p),
         "insensitive": lambda d, y, p: wide.insensitive(d, y, **p)}


def _wide_fits(design, targets, names, mask):
    """Weights and rounds of every model in turn, raw and detrended; failed ones are NaN, with rounds below 1."""
    weights, rounds = [], []
    same = np.array_equal(targets[:, 0], targets[:, 1])
    for name in names:
        kind, params = (MOMENT_MODELS | ROW_MODELS)[name]
        for t in range(2):
            if t and same:
                weights.append(weights[-1])
                rounds.append(rounds[-1])
                continue
            try:
                w, r = _WIDE[kind](design, targets[:, t], params) if has(mask, name) else (design.failed(), 0)
            except np.linalg.LinAlgError:
                w, r = design.failed(), -1
            weights.append(w)
            rounds.append(r if np.isfinite(w).all() else min(r, -r))
    return np.concatenate(weights), rounds


def _fitted(series_id, n, d, mask, levels, weights, rounds):
    """Rows of fits of one width: ``weights`` and ``rounds`` have one line per series."""
    lists = [pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel(), kind)) for m, kind in (
        (weights, pa.float64()), (rounds.astype(np.int32), pa.int32()))]
    ahead = [pa.array(v, f.type) for v, f in zip((series_id, n, [d] * len(n), [mask] * len(n), levels), _FITTED)]
    return pa.RecordBatch.from_arrays([*ahead, *lists], schema=_FITTED)


def _whole_series(batches):
    """(rows, sizes): tables of whole series and their numbers of rows, from batches that hold them one after the other.

    ``rows`` says on every row how many its series has.
    """
    held, missing = [], 0
    for batch in batches:
        if missing and missing >= batch.num_rows:  # the series that is open goes on
            held.append(batch)
            missing -= batch.num_rows
            if not missing:
                yield pa.Table.from_batches(held), [sum(b.num_rows for b in held)]
                held = []
            continue
        sizes, at, counts = [sum(b.num_rows for b in held) + missing] if held else [], missing, batch.column("rows").to_numpy()
        while at < batch.num_rows:
            sizes.append(int(counts[at]))
            at += sizes[-1]
        cut = batch.num_rows if at == batch.num_rows else at - sizes.pop()
        if sizes:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]), sizes
        held, missing = ([batch.slice(cut)], at - batch.num_rows) if cut < batch.num_rows else ([], 0)


def _one_series(table, models, dense_columns):
    """A wide series as rows of fits, or the moments of any other as a stack of one."""
    row_models = [m for m in ROW_MODELS if m in models]
    n = table.num_rows
    x = _matrix(table["x"], n)
    mask = table["wanted"][0].as_py() if "wanted" in table.column_names else -1
    levels, at, column = _level_pairs(table)
    targets = np.column_stack([table[c].to_numpy() for c in (TARGET, "detrended")])
    d, series_id = x.shape[1] + len(levels), [table[KEY][0].as_py()]
    if levels and d > dense_columns:
        weights, rounds = _wide_fits(wide.Design(x, at, column, len(levels)), targets, linear_order(models), mask)
        return _fitted(series_id, [n], d, mask, [levels], weights[None], np.array([rounds])), None
    if levels:
        ones = np.zeros((n, len(levels)))
        ones[at, column] = 1.0
        x = np.hstack([x, ones])
    one = {"series_id": series_id, "n": np.array([n]), "levels": [levels]}
    return None, (d, mask, one | {c: np.asarray(v) for c, v in _dense_moments(x, targets, row_models, mask).items()})


def _many_series(table, sizes):
    """(d, mask, moments) of series without category columns, stacked by width."""
    sizes, lists = np.array(sizes), table["x"].combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    width = np.diff(lists.offsets.to_numpy())
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False))
    first = np.cumsum(sizes) - sizes
    targets = np.column_stack([table[c].to_numpy() for c in (TARGET, "detrended")])
    names = table[KEY].take(pa.array(first)).to_pylist()
    masks = table["wanted"].to_numpy()[first] if "wanted" in table.column_names else np.full(len(sizes), -1)
    for d in np.unique(width[first]):
        own = width == d
        x = flat[np.repeat(own, width)].reshape(-1, d)
        place = np.cumsum(own) - 1
        for mask in np.unique(masks):
            these = np.flatnonzero((width[first] == d) & (masks == mask))
            these, at = these[np.argsort(sizes[these], kind="stable")[::-1]], 0
            while at < len(these):  # alike lengths side by side, in slices of bounded size
                some = these[at:at + max(1, CELLS // int(d * max(d, sizes[these[at]])))]
                at += len(some)
                n = sizes[some]
                step = np.arange(n[0])
                real = step < n[:, None]
                rows = np.where(real, first[some, None] + step, first[some, None])
                yield int(d), int(mask), {"series_id": [names[i] for i in some], "n": n, "levels": [[]] * len(some),
                                          **_stacked_moments(x[place[rows]], targets[rows], real, n)}


def _stacked_moments(x, y, real, n):
    """Centred moments of both targets for series of up to ``x.shape[1]`` rows, those that are ``real``."""
    x[~real], y[~real] = 0.0, 0.0
    per = n[:, None].astype(float)
    centre, mean_y = x.sum(axis=1) / per, y.sum(axis=1) / per
    xc, yc = x - centre[:, None], y - mean_y[:, None]
    xc[~real], yc[~real] = 0.0, 0.0
    spread = np.sqrt((xc * xc).sum(axis=1) / per)
    side = xc.transpose(0, 2, 1)
    return {"mean_x": centre, "scale_x": np.where(_is_flat(spread, centre), 1.0, spread), "mean_y": mean_y,
            "gram": np.matmul(side, xc), "cross": np.matmul(side, yc), "yy": (yc ** 2).sum(axis=1),
            "row_weights": np.zeros((len(n), 0)), "row_rounds": np.zeros((len(n), 0), int)}


def _dense_moments(x, targets, row_models, mask):
    """Centred moments of both targets, and the fits that need the rows."""
    centre, scale = _scale(x)
    xc, mean_y = x - centre, targets.mean(axis=0)
    yc = targets - mean_y
    rows, rounds = [], []
    for name in row_models:
        kind, params = ROW_MODELS[name]
        for t in range(2):
            if t and np.array_equal(targets[:, 0], targets[:, 1]):
                rows.append(rows[-1])
                rounds.append(rounds[-1])
                continue
            fitted, done = _row_fit(kind, params, xc / scale, targets[:, t]) if has(mask, name) else (
                np.full(x.shape[1] + 1, np.nan), 0)
            w = fitted[:-1] / scale
            rows.append(np.append(w, fitted[-1] - w @ centre))
            rounds.append(done)
    return {
        "mean_x": [centre], "scale_x": [scale], "mean_y": [mean_y],
        "gram": [xc.T @ xc], "cross": [xc.T @ yc],
        "yy": [(yc ** 2).sum(axis=0)],
        "row_weights": [np.concatenate(rows) if rows else np.zeros(0)], "row_rounds": [rounds],
    }


def _solve_stack(names, n, mean_x, scale, mean_y, gram, cross, yy):
    """Weights (S, models, 2 targets, d + 1) of every quadratic model for one stack, and rounds (S, models, 2)."""
    s, d = mean_x.shape
    rounds = np.ones((s, len(names), 2), int)
    scaled_gram = gram / (scale[:, :, None] * scale[:, None, :])
    scaled_cross = cross / scale[:, :, None]
    per_row = n[:, None, None].astype(float)
    out = np.empty((s, len(names), 2, d + 1))
    for i, name in enumerate(names):
        kind, p = MOMENT_MODELS[name]
        if kind == "ridge":
            w = kernels.ridge(gram, cross, np.full(s, p["alpha"]))
        elif kind == "scaled_ridge":
            w = kernels.ridge(scaled_gram, scaled_cross, p["alpha"] * n) / scale[:, :, None]
        elif kind == "elastic_net":
            # Both targets of a series are separate problems on the same matrix, if they differ.
            side = np.swapaxes(scaled_cross / per_row, 1, 2)
            other = np.flatnonzero((side[:, 0] != side[:, 1]).any(axis=1))
            w = kernels.elastic_net(scaled_gram / per_row, np.concatenate([side[:, 0], side[other, 1]]),
                                    p["alpha"] * p["ratio"], p["alpha"] * (1 - p["ratio"]), of=np.r_[np.arange(s), other])
            both = np.stack([w[:s], w[:s]], axis=2)
            both[other, :, 1] = w[s:]
            w = both / scale[:, :, None]
        else:
            logs = [[[], []] for _ in range(s)]
            w = np.stack([
                np.stack([_or_nan(lambda: kernels.bayesian_ridge(
                    gram[r], cross[r, :, t], yy[r, t], n[r], log=logs[r][t]), d) for t in range(2)], axis=1)
                for r in range(s)
            ])
            rounds[:, i] = [[(log or [-1])[0] for log in pair] for pair in logs]
        rounds[:, i] = np.where(np.isfinite(w).all(axis=1), rounds[:, i], -np.abs(rounds[:, i]))
        out[:, i, :, :d] = np.swapaxes(w, 1, 2)
        out[:, i, :, d] = mean_y - np.einsum("sd,sdt->st", mean_x, w)
    return out, rounds


def _solve_guarded(names, *arrays):
    """A stack with a series that cannot be solved is solved one by one; that series gets NaN."""
    try:
        return _solve_stack(names, *arrays)
    except np.linalg.LinAlgError:
        if len(arrays[0]) == 1:
            return np.full((1, len(names), 2, arrays[1].shape[1] + 1), np.nan), np.full((1, len(names), 2), -1)
        alone = [_solve_guarded(names, *(a[i:i + 1] for a in arrays)) for i in range(len(arrays[0]))]
        return tuple(np.concatenate(part) for part in zip(*alone))


def _solve(names, d, mask, stack):
    """Rows of fits of series that have one width and want the same models, from their moments."""
    own = [m for m in names if has(mask, m)]
    s = len(stack["n"])
    weights, rounds = np.full((s, len(names), 2, d + 1), np.nan), np.zeros((s, len(names), 2), int)
    if own:
        at = [names.index(m) for m in own]
        weights[:, at], rounds[:, at] = _solve_guarded(own, *(stack[c] for c in _STACKED[:-2]))
    weights = np.concatenate([weights.reshape(s, -1), stack["row_weights"]], axis=1)
    rounds = np.concatenate([rounds.reshape(s, -1), stack["row_rounds"]], axis=1)
    return _fitted(stack["series_id"], stack["n"], d, mask, stack["levels"], weights, rounds)


def _fits(models, dense_columns):
    """Map stage from rows that lie series by series to one row of fits per series."""
    names = [m for m in MOMENT_MODELS if m in models]
    alone = any(m in ROW_MODELS for m in models)

    def joined(parts):
        stack = {c: np.concatenate([p[c] for p in parts]) for c in _STACKED}
        return stack | {c: [v for p in parts for v in p[c]] for c in ("series_id", "levels")}

    def run(batches):
        waiting, cells = {}, 0  # moments by width and mask, solved once there are enough
        for table, sizes in _whole_series(batches):
            if alone or "levels" in table.column_names:
                ends = np.cumsum(sizes).tolist()
                found = (_one_series(table.slice(e - n, n), models, dense_columns) for e, n in zip(ends, sizes))
            else:
                found = ((None, part) for part in _many_series(table, sizes))
            for ready, part in found:
                if ready is not None:  # a wide series, solved where its rows were
                    yield ready
                    continue
                d, mask, moments = part
                parts = waiting.setdefault((d, mask), [])
                parts.append(moments)
                cells += moments["gram"].size
                if sum(len(p["n"]) for p in parts) * d * d >= min(CELLS, STACK * d * d):
                    cells -= sum(p["gram"].size for p in waiting.pop((d, mask)))
                    yield _solve(names, d, mask, joined(parts))
                elif cells > 4 * CELLS:
                    for (d, mask), parts in waiting.items():
                        yield _solve(names, d, mask, joined(parts))
                    waiting, cells = {}, 0
        for (d, mask), parts in waiting.items():
            yield _solve(names, d, mask, joined(parts))

    return run


def fit_linear(vectors: DataFrame, models=LINEAR_MODELS) -> DataFrame:
    """One row per series of ``(series_id, x, y, detrended)`` rows: ``weights`` = models x (raw, detrended) x (d weights, intercept).

    Optional columns: ``levels`` (names of a row's category levels) and ``wanted`` (a mask of
    models, equal on all rows of a series; the others are not fitted).
    Models follow ``linear_order(models)``.  The last of the d columns are the series' ``levels``.
    ``rounds`` has one entry per model and target: 0 was not wanted, a negative one did not converge.
    """
    extra = [c for c in ("levels", "wanted") if c in vectors.columns]
    # The count brings the rows of a series together where they are not yet, and tells a task when it has them all.
    rows = vectors.select(KEY, TARGET, "detrended", "x", *extra, F.count(F.lit(1)).over(by_series()).alias("rows"))
    return rows.mapInArrow(_fits(models, DENSE_COLUMNS), _WEIGHTS)


def coefficients(weights: DataFrame, models=LINEAR_MODELS) -> DataFrame:
    """Tidy view: one row per series, model and target variant."""
    names = F.array(*[F.lit(m) for m in linear_order(models)])
    width = F.col("d") + 1
    return weights.select(
        KEY, "n", "d", "weights", F.posexplode(names).alias("i", "model")
    ).select(
        KEY, "n", "d", "weights", "model", "i",
        F.explode(F.array(F.lit(0), F.lit(1))).alias("variant"),
    ).withColumn(
        "start", (F.col("i") * 2 + F.col("variant")) * width
    ).select(
        KEY, "n",
        F.when(F.col("variant") == 1, F.concat("model", F.lit(TREND_SUFFIX)))
        .otherwise(F.col("model")).alias("model"),
        F.element_at("weights", F.col("start") + width).alias("intercept"),
        F.slice("weights", F.col("start") + 1, F.col("d")).alias("coef"),
    )


def fit_status(weights: DataFrame, models=LINEAR_MODELS) -> DataFrame:
    """One row per series, model and target variant: rounds taken, whether they were enough, and why not."""
    names = F.array(*[F.lit(m + suffix) for m in linear_order(models) for suffix in ("", TREND_SUFFIX)])
    rounds = F.abs("signed").alias("rounds")
    finite = F.forall(F.slice("weights", F.col("i") * (F.col("d") + 1) + 1, F.col("d") + 1), lambda w: ~F.isnan(w))
    return weights.select(KEY, "n", "d", "rounds", "weights", F.posexplode(names).alias("i", "model")).select(
        KEY, "model", "n", "d", F.get("rounds", "i").alias("signed"), finite.alias("finite")).where("signed <> 0").select(
        KEY, "model", "n", "d", rounds, (F.col("signed") > 0).alias("converged"),
        F.when(F.col("signed") > 0, None).when(~F.col("finite"), "no solution").otherwise("rounds ran out").alias("reason"))


def level_weights(weights: DataFrame, models=LINEAR_MODELS) -> DataFrame:
    """(series_id, model, level_name, weight) of the category levels of every series."""
    names = F.array(*[F.lit(m + suffix) for m in linear_order(models) for suffix in ("", TREND_SUFFIX)])
    rows = weights.select(KEY, "d", "levels", "weights", F.posexplode(names).alias("i", "model"))
    start = F.col("i") * (F.col("d") + 1) + F.col("d") - F.size("levels")
    own = F.slice("weights", start + 1, F.size("levels"))
    return rows.select(KEY, "model", F.explode(F.arrays_zip(F.col("levels").alias("level_name"), own.alias("weight"))).alias("z")).select(
        KEY, "model", "z.level_name", "z.weight")


def knn_one_step(train: DataFrame, test: DataFrame, k=5) -> DataFrame:
    """Mean target of the k nearest train rows for each test row of the same series.

    Both sides are ``(series_id, ds, y, x)``.  Distances stay inside the task of a
    series, block by block; no (test, train) pair is ever a row.
    """
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return pa.table({"series_id": pa.array([], pa.string()),
                             "ds": pa.array([], pa.date32()), "y": pa.array([], pa.float64()),
                             "yhat": pa.array([], pa.float64())})
        left = left.sort_by("ds")
        x, y = _matrix(left["x"], left.num_rows), left[TARGET].to_numpy()
        yhat = [kernels.nearest_mean(x, y, q, k) for q in _matrix(right["x"], right.num_rows)]
        return pa.table({"series_id": right[KEY], "ds": right["ds"], "y": right[TARGET],
                         "yhat": pa.array(yhat, pa.float64())})

    columns = (KEY, "ds", TARGET, "x")
    # Fresh column identities: both sides may come from the same panel.
    own = train.select(*columns).toDF(*columns)
    return own.groupBy(KEY).cogroup(
        test.select(*columns).groupBy(KEY)
    ).applyInArrow(run, "series_id string, ds date, y double, yhat double")
