"""Raw rows to a standard panel, and the known / future slices of it."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.functions.dates import parse_fixed, parse_mixed, parse_with
from dayloom.functions.text import no_nan, to_number
from dayloom.schema import DAY, KEY, TARGET

DAY_FIRST_SERIES = "_day_first"
DAY_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def by_series():
    return Window.partitionBy(KEY)


def by_day():
    return Window.partitionBy(KEY).orderBy(DAY)


def whole_series():
    """Ordered like ``by_day`` so Spark evaluates both in one window pass."""
    return by_day().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def exog_columns(panel: DataFrame):
    return [c for c in panel.columns if c not in (KEY, DAY, TARGET)]


def daily_panel(rows: DataFrame, key: Column, day: Column, value: Column, **exog: Column):
    """Aggregate raw rows to one row per series and day.

    Summing happens before the shuffle (partial aggregation), so a series holding a
    large share of the raw rows still reaches the next stage as one row per day.
    Values are summed in their own type: decimals and whole numbers exactly, with room for
    38 digits, anything else as doubles.  ``exog`` are aggregate expressions named by their column.
    """
    kind = rows.select(value).schema[0].dataType
    if isinstance(kind, T.DecimalType):
        value = value.cast(T.DecimalType(38, kind.scale))
    elif isinstance(kind, T.IntegralType):
        value = value.cast(T.DecimalType(38, 0))
    else:
        value = value.cast("double")
    total = F.sum(value).cast("double")
    return (
        rows.groupBy(key.cast("string").alias(KEY), day.cast("date").alias(DAY))
        .agg(total.alias(TARGET), *[e.alias(n) for n, e in exog.items()])
    )


def _parsed_day(raw: DataFrame, column: str, fmt, fmt_column):
    kind = raw.schema[column].dataType
    if isinstance(kind, DAY_TYPES):
        return F.col(column).cast("date")
    if fmt_column:
        return parse_with(f"`{column}`", fmt_column)
    if fmt:
        return parse_fixed(F.col(column).cast("string"), fmt)
    return parse_mixed(F.col(column), F.col(DAY_FIRST_SERIES))


def _with_day_order(raw: DataFrame, column: str, key):
    """Marks the series in which some cell is no date: all their days are read day first.

    One flag a series is what meets the rows again.
    """
    flags = raw.groupBy(key.alias("_flag_key")).agg(
        F.bool_or(parse_mixed(F.col(column)).isNull()).alias(DAY_FIRST_SERIES))
    return raw.join(flags, key.eqNullSafe(F.col("_flag_key")), "left")


def _as_number(raw: DataFrame, column: str):
    kind = raw.schema[column].dataType
    if isinstance(kind, T.StringType):
        return to_number(F.col(column))
    return no_nan(F.col(column).cast("double"))


def standardize(raw: DataFrame, fmt=None, fmt_column=None, date_col=None, target_col=None):
    """First column to ``ds``, last to ``y``, the middle ones kept; projection only.

    ``fmt`` is one format for all rows, ``fmt_column`` a column of formats by row; with
    neither, cells are parsed one by one, month before day, or day before month in a series
    with a cell that is no date.  A frame without a key is one series.
    """
    data = [c for c in raw.columns if c not in (KEY, fmt_column)]
    first, last = date_col or data[0], target_col or data[-1]
    middle = [c for c in data if c not in (first, last, DAY, TARGET)]
    key = F.col(KEY) if KEY in raw.columns else F.lit("series")
    if not fmt and not fmt_column and not isinstance(raw.schema[first].dataType, DAY_TYPES):
        raw = _with_day_order(raw, first, key)
    return raw.select(
        key.cast("string").alias(KEY),
        _parsed_day(raw, first, fmt, fmt_column).alias(DAY),
        _as_number(raw, last).alias(TARGET),
        *[F.col(f"`{c}`") for c in middle],
    )


def series_meta(panel: DataFrame) -> DataFrame:
    """Per series: last day, last observed day, trailing missing targets, row counts."""
    seen = F.when(F.col(TARGET).isNotNull(), F.col(DAY))
    counts = panel.groupBy(KEY, DAY).agg(
        F.count(F.lit(1)).alias("rows"), F.count(TARGET).alias("known"),
        F.max(seen).alias("seen"),
    )
    # Missing targets after the last observed day = all missing - missing before it.
    # Rows per day are bounded by the calendar, so the ordered pass is bounded too.
    last_seen = F.max("seen").over(by_series())
    return (
        counts.withColumn("last_seen", last_seen)
        .groupBy(KEY)
        .agg(
            F.max(DAY).alias("last_day"),
            F.max("last_seen").alias("last_observed"),
            F.sum("rows").alias("n_rows"),
            F.sum("known").alias("n_known"),
            F.coalesce(
                F.sum(F.when(F.col(DAY) > F.col("last_seen"), F.col("rows"))), F.lit(0)
            ).alias("trailing_missing"),
        )
    )


def with_last_observed(panel: DataFrame) -> DataFrame:
    seen = F.when(F.col(TARGET).isNotNull(), F.col(DAY))
    return panel.withColumn("last_observed", F.max(seen).over(by_series()))


def future_rows(panel: DataFrame) -> DataFrame:
    """Rows after the last observed target, exogenous columns kept."""
    return (
        with_last_observed(panel)
        .filter(F.col(DAY) > F.col("last_observed"))
        .drop(TARGET, "last_observed")
    )


def known_rows(panel: DataFrame) -> DataFrame:
    return panel.filter(F.col(TARGET).isNotNull())


def series_fingerprint(panel: DataFrame) -> DataFrame:
    """Order-free content hash per series, plus the coarse form (shape and bounds).

    Hashes are summed as decimals: a sum of longs would overflow.
    """
    row_hash = F.xxhash64(*[F.col(c) for c in panel.columns]).cast("decimal(38,0)")
    return panel.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(DAY).alias("first_day"),
        F.max(DAY).alias("last_day"),
        F.count(TARGET).alias("n_known"),
        F.sum(row_hash).alias("content_hash"),
    )
