"""Tree regressors: spark.ml fits pooled over the panel, then recursive forecasting.

Rows of all series train one model, each series scaled by its own mean and deviation;
for a one-series panel this is the plain model.  Lags available depend on series
length, so there is one fit per number of usable lags, at most six.  A fitted tree is a
small table of nodes (bounded by depth and tree count, not by data); it travels to the
recursion stage in the task closure, and the walk over days is a single map stage.
"""

import re
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.functions import kernels
from dayloom.operators import forecast
from dayloom.operators.models import TREE_MODELS, TREND_SUFFIX, has
from dayloom.schema import KEY, LAGS, PERIODS, TARGET, WINDOWS
from dayloom.session import shared_dir

_LINE = re.compile(r"^\s*(If|Else|Predict)\b.*?(?:feature (\d+) (<=|>) |: )(-?[\d.E+-]+)\)?\s*$")


def scaled_vectors(vectors: DataFrame, facts: DataFrame) -> DataFrame:
    """Training rows with target, lags and averages on the scale of their series."""
    used = F.size("x") - (len(WINDOWS) + 8 + 6 * len(PERIODS))
    moving = used + len(WINDOWS)
    rows = vectors.join(facts.select(KEY, "degree", "mean_y", "std_y"), KEY)
    recent = F.transform(F.slice("x", F.lit(1), moving),
                         lambda v: (v - F.col("mean_y")) / F.col("std_y"))
    rest = F.slice("x", moving + 1, F.size("x") - moving)
    return rows.select(
        KEY, used.alias("n_lags"), "degree",
        ((F.col(TARGET) - F.col("mean_y")) / F.col("std_y")).alias("label_raw"),
        (F.col("detrended") / F.col("std_y")).alias("label_detrended"),
        array_to_vector(F.concat(recent, rest)).alias("features"),
    )


def series_scale(train: DataFrame) -> DataFrame:
    std = F.stddev_pop(TARGET)
    return train.groupBy(KEY).agg(
        F.avg(TARGET).alias("mean_y"), F.when(std > 0, std).otherwise(1.0).alias("std_y"))


def _regressor(kind, params, label):
    common = dict(featuresCol="features", labelCol=label, maxDepth=params["depth"], seed=42)
    if kind == "boosting":
        return GBTRegressor(maxIter=params["trees"], stepSize=0.1, checkpointInterval=25, **common)
    return DecisionTreeRegressor(maxBins=256, **common)


def _nodes(text):
    """Flat arrays (feature, threshold, left, right, value) from a model's description."""
    feature, threshold, left, right, value, pending = [], [], [], [], [], []
    for line in text.splitlines():
        m = _LINE.match(line)
        if not m:
            continue
        kind, index, _, number = m.groups()
        if kind == "Else":
            owner = pending.pop()
            right[owner] = len(feature)
            continue
        here = len(feature)
        feature.append(int(index) if kind == "If" else 0)
        threshold.append(float(number) if kind == "If" else np.inf)
        value.append(float(number) if kind == "Predict" else 0.0)
        # The node after an If is its left child; a leaf points at itself.
        left.append(here + 1 if kind == "If" else here)
        right.append(here)
        if kind == "If":
            pending.append(here)
    return feature, threshold, left, right, value


def _ensemble(model):
    """Stacked node arrays (trees x nodes) with tree weights and depth."""
    trees = list(getattr(model, "trees", [model]))
    weights = np.asarray(getattr(model, "treeWeights", [1.0]), dtype=float)
    parts = [_nodes(t.toDebugString) for t in trees]
    size = max(len(p[0]) for p in parts)
    stack = [np.zeros((len(parts), size), dtype=t) for t in (int, float, int, int, float)]
    for i, p in enumerate(parts):
        for field, values in zip(stack, p):
            field[i, :len(values)] = values
    return (*stack, weights, max(t.depth for t in trees))


def predict_trees(ensemble, x):
    """Weighted leaf values for rows ``x``, all trees walked together."""
    feature, threshold, left, right, value, weights, depth = ensemble
    tree = np.arange(len(weights))
    at = np.zeros((len(x), len(weights)), dtype=int)
    for _ in range(depth):
        seen = np.take_along_axis(x, feature[tree, at], axis=1)
        at = np.where(seen <= threshold[tree, at], left[tree, at], right[tree, at])
    return value[tree, at] @ weights


def fit_trees(rows: DataFrame, chosen=tuple(TREE_MODELS), parallel=8):
    """{(model, n_lags, variant): node arrays}: one distributed fit per entry.

    The fits are independent and mostly wait on small jobs, so they are submitted
    together and the scheduler interleaves them.
    """
    shared_dir(rows.sparkSession)  # boosting cuts its lineage in the checkpoint folder
    present = rows.groupBy("n_lags").agg(F.max("degree").alias("degree")).collect()
    tasks = [
        (name, r["n_lags"], variant)
        for r in present for name in chosen for variant in ("", TREND_SUFFIX)
        if not variant or r["degree"] > 0
    ]

    def fit(task):
        name, n_lags, variant = task
        own = rows.filter(F.col("n_lags") == n_lags)
        data = own.filter("degree > 0") if variant else own
        label = "label_detrended" if variant else "label_raw"
        kind, params = TREE_MODELS[name]
        return _ensemble(_regressor(kind, params, label).fit(data.select("features", label)))

    with ThreadPool(parallel) as pool:
        return dict(zip(tasks, pool.map(fit, tasks)))


def _walker(fitted, add_trend, lags, windows):
    def walk_chunk(longest, rows):
        used = np.array([sum(r.n_train > m for m in lags) for r in rows])
        known = [forecast.calendar_of(r, longest) for r in rows]
        lift = np.stack([forecast.trend_of(r, longest) for r in rows])
        mean, std = np.array([r.mean_y for r in rows]), np.array([r.std_y for r in rows])
        sloped = np.array([r.degree > 0 for r in rows])
        for (name, n_lags, variant), ensemble in fitted.items():
            asked = np.array([has(getattr(r, "wanted", -1), name) for r in rows])
            on = np.flatnonzero((used == n_lags) & asked & (sloped if variant else True))
            if not len(on):
                continue
            picks = list(range(n_lags)) + [len(lags) + i for i in range(len(windows))]
            calendar = np.stack([known[i] for i in on])

            def step(h, z):
                recent = (z[:, picks] - mean[on, None]) / std[on, None]
                y = predict_trees(ensemble, np.column_stack([recent, calendar[:, h]])) * std[on]
                if not variant:
                    return y + mean[on]
                return y + lift[on, h] if add_trend else y

            paths = kernels.walk([rows[i].hist for i in on], longest, step, lags, windows)
            yield forecast.emit(rows, on, [name + variant] * len(on), paths)

    def run(batches):
        for batch in batches:
            # A calendar row is some thirty values wide, hence the smaller slices.
            for longest, rows in forecast.chunks(batch.to_pandas(), 32):
                yield from walk_chunk(longest, rows)

    return run


def walk_forward_trees(state: DataFrame, facts: DataFrame, fitted, add_trend=True, lags=LAGS,
                       windows=WINDOWS) -> DataFrame:
    joined = state.join(facts.select(KEY, "mean_y", "std_y"), KEY)
    return joined.mapInArrow(_walker(fitted, add_trend, lags, windows), forecast.FORECAST)

