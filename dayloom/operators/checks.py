"""Validation checks over raw series: plain aggregates, so any group size is safe.

Nothing here orders or collects the rows of a series: "missing only at the end" and
"one day apart" are both stated as comparisons of aggregates.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions.dates import DATE_FORMATS, SAMPLE_FORMATS, parsed_by
from dayloom.schema import DAY, KEY, LABEL_SAMPLE, TARGET


def check_summary(panel: DataFrame, feature_cols=(), order_col=DAY) -> DataFrame:
    """All row-level checks in one aggregation, one wide row per series.

    ``order_col`` is the order in which "at the end" and "consecutive" are judged:
    the day itself, or a dense row number when the caller has a file order.
    """
    known = F.col(TARGET).isNotNull()
    feature_nulls = sum((F.count_if(F.col(c).isNull()) for c in feature_cols), F.lit(0))
    # With a row number, days are consecutive exactly when day - row number is constant.
    day_number = F.datediff(F.col(DAY), F.lit("1970-01-01").cast("date"))
    if order_col == DAY:
        daily = (F.datediff(F.max(DAY), F.min(DAY)) + 1 == F.count(F.lit(1))) & (
            F.count_distinct(DAY) == F.count(F.lit(1))
        )
    else:
        offset = day_number - F.col(order_col)
        daily = (F.max(offset) == F.min(offset)) & (
            F.max(order_col) - F.min(order_col) + 1 == F.count(F.lit(1))
        )
    last_known = F.max(F.when(known, F.col(order_col)))
    first_missing = F.min(F.when(~known, F.col(order_col)))
    trailing = F.coalesce(first_missing > last_known, last_known.isNotNull())
    return panel.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(DAY).isNull()).alias("unparsed_days"),
        feature_nulls.alias("feature_nulls"),
        F.count_if(~known).alias("target_nulls"),
        F.count(TARGET).alias("n_known"),
        trailing.alias("missing_at_end"),
        F.coalesce(daily & (F.count_if(F.col(DAY).isNull()) == 0), F.lit(False)).alias("is_daily"),
    )


def check_counts(summary: DataFrame, n_columns: int, max_rows=None) -> DataFrame:
    """Column and row counts; ``max_rows`` is an optional threshold."""
    too_many = F.col("n_rows") > max_rows if max_rows else F.lit(False)
    status = (
        F.when(F.lit(n_columns < 2), "error")
        .when(too_many, "error")
        .otherwise("ok")
    )
    return summary.select(
        KEY, "n_rows", F.lit(n_columns).cast("bigint").alias("n_columns"), status.alias("status")
    )


def check_nulls(summary: DataFrame) -> DataFrame:
    """Missing cells of features, target and day."""
    total = F.col("feature_nulls") + F.col("target_nulls") + F.col("unparsed_days")
    return summary.select(KEY, "feature_nulls", "target_nulls", total.alias("total_nulls"))


def check_feature_nulls(summary: DataFrame) -> DataFrame:
    """Only the target may be missing, and a day is no target."""
    status = F.when(F.col("feature_nulls") + F.col("unparsed_days") > 0, "error").otherwise("ok")
    return summary.select(KEY, "feature_nulls", status.alias("status"))


def check_trailing(summary: DataFrame) -> DataFrame:
    status = F.when(F.col("missing_at_end"), "ok").otherwise("error")
    return summary.select(KEY, "n_known", "target_nulls", status.alias("status"))


def check_daily(summary: DataFrame) -> DataFrame:
    status = F.when(F.col("is_daily"), "ok").otherwise("error")
    return summary.select(KEY, "n_rows", status.alias("status"))


def detect_date_format(raw: DataFrame, date_col: str, order_col=None, formats=DATE_FORMATS):
    """First format by which every cell parses and the days are one step apart.

    Equal date strings are merged before the formats are tried, so the 42-fold
    expansion touches distinct strings, not rows.  With ``order_col`` (dense row
    number) the step test runs in file order; otherwise on the set of days.
    """
    text = F.col(date_col).cast("string").alias("text")
    if order_col is None:
        cells = raw.groupBy(KEY, text).agg(F.count(F.lit(1)).alias("rows"))
    else:
        cells = raw.groupBy(KEY, text).agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(order_col).cast("long").alias("lo"), F.max(order_col).cast("long").alias("hi"),
        )
    others = [c for c in cells.columns if c not in (KEY, "text")]
    # Only formats that took the text go on; a marker entry keeps the full row count.
    marker = F.array(F.struct(F.lit(-1).alias("priority"), F.lit(None).cast("string").alias("fmt"),
                              F.lit(None).cast("date").alias("day")))
    taken = F.filter(parsed_by(F.col("text"), formats), lambda p: p["day"].isNotNull())
    tried = cells.select(KEY, *others, F.explode(F.concat(marker, taken)).alias("f")).select(
        KEY, *others, "f.priority", "f.fmt", "f.day")
    day_number = F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))
    by_day = tried.groupBy(KEY, "priority", "fmt", "day").agg(
        F.sum("rows").alias("rows"),
        *([F.min(day_number - F.col("hi")).alias("lo_off"),
           F.max(day_number - F.col("lo")).alias("hi_off")] if order_col else []),
    )
    one_step = (
        (F.datediff(F.max("day"), F.min("day")) + 1 == F.sum("rows"))
        & (F.count("day") == F.sum("rows"))
    )
    if order_col:
        one_step = one_step & (F.min("lo_off") == F.max("hi_off"))
    by_format = by_day.groupBy(KEY, "priority", "fmt").agg(
        one_step.alias("ok"), F.sum("rows").alias("rows"))
    # At most one entry per format and series from here on.
    verdict = by_format.groupBy(KEY).agg(
        F.max(F.when(F.col("priority") == -1, F.col("rows"))).alias("n_rows"),
        F.collect_list(F.when(F.col("ok"), F.struct("priority", "fmt", "rows"))).alias("passed"),
    )
    best = F.array_min(F.filter("passed", lambda p: p["rows"] == F.col("n_rows")))
    return verdict.select(KEY, "n_rows", best["fmt"].alias("date_format"))


def detect_format_sample(raw: DataFrame, date_col: str, order_col=None, n=LABEL_SAMPLE):
    """First of eight formats that parses the leading ``n`` non-blank cells of a series.

    Sampling is the feature here.  The row limit is applied before the shuffle as
    well (group limit), so at most ``n`` rows per series and task move.
    """
    text = F.btrim(F.col(date_col).cast("string"))
    order = F.col(order_col) if order_col else F.col("text")
    w = Window.partitionBy(KEY).orderBy(order)
    sample = (
        raw.withColumn("text", text)
        .filter(F.col("text") != "")
        .withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= n)
        .select(KEY, F.explode(parsed_by(F.col("text"), SAMPLE_FORMATS)).alias("f"))
        .select(KEY, "f.priority", "f.fmt", "f.day")
    )
    return (
        sample
        .groupBy(KEY, "priority", "fmt")
        .agg((F.count("day") == F.count(F.lit(1))).alias("ok"))
        .groupBy(KEY)
        .agg(F.min_by("fmt", F.when(F.col("ok"), F.col("priority"))).alias("fmt"),
             F.max("ok").alias("found"))
        .select(KEY, F.when(F.col("found"), F.col("fmt")).alias("date_format"))
    )


def checklist(summary: DataFrame, n_columns: int, max_rows=None, formats=None) -> DataFrame:
    """Tidy report ``(series_id, check, status, message)`` from the wide summary row."""
    too_many = F.col("n_rows") > max_rows if max_rows else F.lit(False)

    def item(name, bad, good_text, bad_text):
        return F.struct(
            F.lit(name).alias("check"),
            F.when(bad, "error").otherwise("ok").alias("status"),
            F.when(bad, bad_text).otherwise(good_text).alias("message"),
        )

    rows_text = F.format_string("%d rows", F.col("n_rows"))
    missing_text = F.format_string("%d targets to predict", F.col("target_nulls"))
    items = [
        item("rows", too_many, rows_text, F.concat(rows_text, F.lit(", above the limit"))),
        item("columns", F.lit(n_columns < 2), F.lit(f"{n_columns} columns"),
             F.lit("a date and a target column are needed")),
        item("feature_nulls", F.col("feature_nulls") + F.col("unparsed_days") > 0, F.lit("features complete"),
             F.format_string("%d feature cells missing", F.col("feature_nulls") + F.col("unparsed_days"))),
        item("target_nulls", ~F.col("missing_at_end"), missing_text,
             F.lit("missing targets must close the series")),
        item("daily", ~F.col("is_daily"), F.lit("days are consecutive"),
             F.lit("days are not one step apart")),
    ]
    if formats is not None:
        summary = summary.join(formats.select(KEY, "date_format"), KEY, "left")
        items.append(item("date_format", F.col("date_format").isNull(),
                          F.col("date_format"), F.lit("no format fits every row")))
    return summary.select(KEY, F.explode(F.array(*items)).alias("i")).select(
        KEY, "i.check", "i.status", "i.message"
    )


def accepted_series(report: DataFrame) -> DataFrame:
    """Series without an error; the others stay visible in the report."""
    return (
        report.groupBy(KEY)
        .agg(F.count_if(F.col("status") == "error").alias("errors"))
        .filter("errors = 0")
        .select(KEY)
    )
