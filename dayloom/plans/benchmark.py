"""Benchmark and future forecast over a whole panel."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.operators import evaluate, exog, forecast, models, trees, trend
from dayloom.operators.features import feature_vectors
from dayloom.operators.panel import known_rows, with_last_observed
from dayloom.operators.seasonality import merged_periods
from dayloom.plans.stage import stage_by_series
from dayloom.schema import DAY, KEY, PERIODS, TARGET, TEST_FRACTION, TOP_MODELS

# Models whose fit and recursion run per series in one job each.
SERIES_MODELS = models.LINEAR_MODELS + (models.NEIGHBOUR_MODEL,)


class Benchmark(NamedTuple):
    scores: DataFrame      # (series_id, model, rank, rmse, mape, smape, accuracy_pct, n_test)
    forecasts: DataFrame   # (series_id, model, ds, y, yhat)
    status: DataFrame      # (series_id, model, status, reason): every series, and the models that failed


def _no_trend(rows: DataFrame) -> DataFrame:
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("c0", "c1", "c2")])
    return rows.groupBy(KEY).agg(F.min(DAY).alias("t0")).select(
        KEY, "t0", F.lit(0).alias("degree"), zero.alias("coef"))


def _facts(train, chosen_trend, detect_periods, chosen, wanted=None):
    """Per series: Fourier periods, the trend in use, and the mask of models it wants."""
    if detect_periods:
        periods = merged_periods(train)
    else:
        fixed = F.array(*[F.lit(p) for p in PERIODS])
        periods = train.select(KEY).distinct().select(KEY, fixed.alias("periods"))
    facts = periods.join(
        chosen_trend.select(KEY, "degree", "coef", "t0"), KEY
    )
    if wanted is None:
        return facts.withColumn("wanted", F.lit(models.wanted_mask(chosen)).cast("long"))
    return facts.join(wanted.select(KEY, "wanted"), KEY)


def _with_exog(split, with_exog):
    """(split, its exogenous columns): kinds are judged on the training rows."""
    train = split.filter("part = 'train'")
    if not with_exog:
        return split, exog.Columns()
    if exog.CELLS in split.columns:  # columns that differ by series
        return exog.with_cell_kinds(split, train), exog.Cells()
    return split, exog.Columns(exog.known_kinds(train.drop("part", "n_known")))


def _vectors(train, facts, columns=exog.Columns()):
    value = F.when(F.col("degree") > 0, F.col(TARGET) - trend.trend_value(F.col(DAY)))
    rows = train.join(facts, KEY).withColumn("detrended", F.coalesce(value, F.col(TARGET)))
    levels = [columns.levels().alias("levels")] if columns.has_levels else []
    return feature_vectors(rows, periods=F.col("periods"), exog=columns.numbers() if columns.has_numbers else None,
                           extra=["detrended", "wanted", *levels])


def _state(split, facts, columns=exog.Columns()):
    state = forecast.recursion_state(
        split, columns.numbers(True) if columns.has_numbers else None, columns.levels() if columns.has_levels else None,
        columns.missing_day() if columns.has_levels else None)
    return state.join(facts, KEY).select(
        *[F.col(c) for c in state.columns], "periods", "degree", "wanted",
        F.col("coef.c0").alias("c0"), F.col("coef.c1").alias("c1"), F.col("coef.c2").alias("c2"),
    )


def run_trees(split: DataFrame, facts: DataFrame, chosen=tuple(models.TREE_MODELS),
              add_trend=True) -> DataFrame:
    """Pooled tree models; fits run eagerly, the recursion is lazy."""
    train = split.filter("part = 'train'").drop("part", "n_known")
    fixed = F.array(*[F.lit(p) for p in PERIODS])
    scaled = facts.withColumn("periods", fixed).join(trees.series_scale(train), KEY)
    rows = trees.scaled_vectors(_vectors(train, facts.withColumn("periods", fixed)), scaled)
    # Every boosting round reads these rows: keep them, Spark rebuilds lost blocks.
    rows = rows.persist()
    fitted = trees.fit_trees(rows, chosen)
    rows.unpersist()
    state = _state(split, facts.withColumn("periods", fixed))
    return trees.walk_forward_trees(state, scaled, fitted, add_trend)


def run_models(split: DataFrame, facts: DataFrame, chosen=SERIES_MODELS, columns=exog.Columns(),
               add_trend=True) -> DataFrame:
    """Fit on ``part = 'train'`` and walk through ``part = 'test'`` rows.

    ``facts.wanted`` says which of the models each series wants (``models.wanted_mask``).
    """
    train = split.filter("part = 'train'").drop("part", "n_known")
    vectors = _vectors(train, facts, columns)
    state = _state(split, facts, columns)
    linear = [m for m in chosen if m in models.LINEAR_MODELS]
    parts = []
    if linear:
        weights = models.fit_linear(vectors, linear)
        parts.append(forecast.walk_forward_linear(
            state.drop("wanted"), weights, models.linear_order(linear), add_trend))
    if models.NEIGHBOUR_MODEL in chosen:
        wants = models.wants(models.NEIGHBOUR_MODEL)
        parts.append(forecast.walk_forward_knn(state.filter(wants), vectors.filter(wants), add_trend=add_trend))
    tree_names = [m for m in chosen if m in models.TREE_MODELS]
    if tree_names:
        mask = F.lit(models.wanted_mask(tree_names))
        parts.append(run_trees(split, facts.filter(F.col("wanted").bitwiseAND(mask) != 0), tree_names, add_trend))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def benchmark(panel: DataFrame, chosen=SERIES_MODELS, test_fraction=TEST_FRACTION,
              detect_periods=True, leak_free=False, with_exog=True) -> Benchmark:
    """Split, fit, walk forward, score and rank every series of the panel.

    A series that is rejected, or without any forecast, has one row ``NoModels`` with an
    infinite error; ``status`` gives the reason.  Exogenous columns may have any number of levels;
    where they differ by series they come as one array column ``cells``.

    Pass a staged panel (``stage_panel``): it is read by several branches here.
    """
    checks = stage_by_series(evaluate.series_checks(panel))
    usable = evaluate.accepted(panel, checks)
    split, columns = _with_exog(evaluate.time_split(usable, test_fraction), with_exog)
    train = split.filter("part = 'train'")
    chosen_trend = trend.trend_choice(train, known_rows(usable), leak_free)
    facts = stage_by_series(_facts(train, chosen_trend, detect_periods, chosen))
    forecasts = run_models(split, facts, chosen, columns)
    scores = evaluate.with_unscored(panel.select(KEY).distinct(), evaluate.metrics(forecasts))
    board = evaluate.leaderboard(scores)
    return Benchmark(board, forecasts, _status(checks, board))


def _status(checks, board):
    """Every series with the reason it was rejected for, and every model without a finite error."""
    failed = F.coalesce(~(F.col("rmse") < float("inf")), F.lit(True))
    series = checks.select(
        KEY, F.lit(None).cast("string").alias("model"),
        F.when(F.col("reason").isNull(), "ok").otherwise("rejected").alias("status"), "reason")
    unscored = F.when(F.col("model") == "NoModels", "no complete rows to fit or no day to predict")
    reason = F.coalesce(unscored, F.lit("no solution or no finite forecast"))
    lost = board.filter(failed).select(KEY, "model", F.lit("failed").alias("status"), reason.alias("reason"))
    return series.unionByName(lost.join(checks.filter("reason IS NOT NULL").select(KEY), KEY, "left_anti"))


def fit_report(panel: DataFrame, chosen=models.LINEAR_MODELS, detect_periods=True, with_exog=True) -> DataFrame:
    """Fits of the linear models on all known rows, one line each, and one line per rejected series.

    (series_id, model, n, d, rounds, converged, reason): rows and columns of the fit, the rounds its
    solver took, and why it has no result or an unfinished one.
    """
    checks = stage_by_series(evaluate.series_checks(panel))
    split = known_rows(evaluate.accepted(panel, checks)).withColumn("part", F.lit("train"))
    split, columns = _with_exog(split, with_exog)
    train = split.drop("part")
    facts = stage_by_series(_facts(train, _no_trend(train), detect_periods, chosen))
    weights = models.fit_linear(_vectors(train, facts, columns), chosen)
    report = models.fit_status(weights, chosen).filter(~F.endswith("model", F.lit(models.TREND_SUFFIX)))
    lost = checks.filter("reason IS NOT NULL").select(
        KEY, F.lit(None).cast("string").alias("model"), F.col("n_known").cast("bigint").alias("n"), F.lit(None).cast("int").alias("d"),
        F.lit(0).alias("rounds"), F.lit(False).alias("converged"), "reason")
    return report.unionByName(lost)


def as_future_split(panel: DataFrame) -> DataFrame:
    """Known rows as ``train``, rows after the last observed day as ``test``."""
    part = F.when(F.col(TARGET).isNotNull(), "train").when(
        F.col(DAY) > F.col("last_observed"), "test")
    return (
        with_last_observed(panel).withColumn("part", part)
        .filter("part IS NOT NULL").drop("last_observed")
    )


def forecast_future(panel: DataFrame, chosen=SERIES_MODELS, detect_periods=True,
                    with_exog=True, wanted=None) -> DataFrame:
    """Refit on all known rows and predict the trailing missing days.

    ``wanted(series_id, wanted)`` gives a mask of models per series; other series and models are
    neither fitted nor walked.
    """
    if wanted is not None:
        panel = panel.join(wanted.select(KEY), KEY, "left_semi")
    split, columns = _with_exog(as_future_split(panel), with_exog)
    train = split.filter("part = 'train'")
    facts = stage_by_series(_facts(train, _no_trend(train), detect_periods, chosen, wanted))
    return run_models(split, facts, chosen, columns).drop("y")


def forecast_future_trend(panel: DataFrame, chosen=SERIES_MODELS, detect_periods=True,
                          with_exog=True, wanted=None) -> DataFrame:
    """The same on the detrended target, lags included; the trend is added at the end."""
    if wanted is not None:
        panel = panel.join(wanted.select(KEY), KEY, "left_semi")
    fitted = trend.trend_fit(panel)
    raw = forecast_future(trend.detrend(panel, fitted), chosen, detect_periods, with_exog, wanted)
    named = raw.withColumn("model", F.concat("model", F.lit(models.TREND_SUFFIX)))
    return trend.retrend(named, fitted).select(KEY, "model", DAY, "yhat")


def wanted_models(top: DataFrame, suffix="") -> DataFrame:
    """(series_id, wanted): masks of the models in ``top(series_id, model)`` whose name ends in ``suffix``, or in no trend mark."""
    bits = F.create_map(*[F.lit(x) for m in models.ALL_MODELS for x in (m + suffix, models.wanted_mask([m]))])
    return top.groupBy(KEY).agg(F.sum(bits[F.col("model")]).alias("wanted")).filter("wanted > 0")


def future_of_top(panel: DataFrame, scores: DataFrame, chosen=SERIES_MODELS,
                  detect_periods=True, with_exog=True, n=TOP_MODELS) -> DataFrame:
    """Future forecasts of each series' best ``n`` models, flat where a model gave none.

    The winners are written down first, so the benchmark runs once; then only a series' winners are
    fitted and walked.
    """
    top = stage_by_series(evaluate.top_models(scores, n).select(KEY, "model", "rank"))
    names = {r.model for r in top.select("model").distinct().collect()}  # as many as there are models
    given = None
    for suffix, job in (("", forecast_future), (models.TREND_SUFFIX, forecast_future_trend)):
        own = tuple(m for m in chosen if m + suffix in names)
        if own:
            part = job(panel, own, detect_periods, with_exog, wanted_models(top, suffix))
            given = part if given is None else given.unionByName(part)
    days = as_future_split(panel).filter("part = 'test'").select(KEY, DAY)
    wanted = top.join(days, KEY).select(KEY, "model", DAY)
    if given is None:
        given = wanted.withColumn("yhat", F.lit(None).cast("double"))
    return forecast.flat_fallback(given, wanted, panel)
