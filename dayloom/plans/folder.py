"""From a folder of files to forecasts: read, check, benchmark what is accepted, predict, export.

Every file is a series with columns of its own.  A file that can't be used has a row in the report
that says why; the others go on.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.operators import checks, evaluate, exog
from dayloom.operators.panel import standardize
from dayloom.plans import benchmark as jobs
from dayloom.plans.stage import stage, stage_by_series, stage_panel
from dayloom.schema import DAY, KEY
from dayloom.sources import files, sinks

FILE_ROW = "file_row"


class Folder(NamedTuple):
    report: DataFrame      # (series_id, status, message, n_rows, n_predicted, model): one row per file
    scores: DataFrame      # the leaderboard of accepted files
    table: DataFrame       # (series_id, file_row, names, cells, predicted): rows of accepted files in file order


def raw_series(tables: DataFrame) -> DataFrame:
    """Rows of ``read_tables`` by position: first field the date, last named one the target, the rest ``cells``."""
    inner = F.slice("names", F.lit(2), F.greatest(F.size("names") - 2, F.lit(0)))
    return tables.select(
        F.col("path").alias(KEY), F.get("cells", F.lit(0)).alias("date_cell"), F.col("row").alias(FILE_ROW),
        F.transform(inner, lambda n, i: F.get(F.col("cells"), i + 1)).alias(exog.CELLS),
        F.get("cells", F.size("names") - 1).alias("target_cell"))


def check_files(spark: SparkSession, folder: str, expected=None):
    """(tables, panel, report): rows as read, the standard panel of readable files, and one line per file and check."""
    tables = stage(files.read_tables(spark, folder), "tables")
    found = stage(files.table_report(spark, folder, expected), "table-report")
    readable = found.filter("status = 'ok'").select(F.col("path").alias(KEY))
    raw = stage(raw_series(tables).join(readable, KEY, "left_semi"), "raw-series")
    formats = stage(checks.detect_date_format(raw, "date_cell", FILE_ROW), "date-formats")
    panel = standardize(raw.join(formats.select(KEY, "date_format"), KEY), fmt_column="date_format",
                        date_col="date_cell", target_col="target_cell")
    whole = F.when(F.forall(exog.CELLS, lambda c: c.isNotNull()), 1)
    summary = checks.check_summary(panel.withColumn("whole", whole), ("whole",), FILE_ROW)
    listed = checks.checklist(summary, 2, formats=formats).withColumn("place", F.lit(1))
    table = found.select(F.col("path").alias(KEY), F.lit("table").alias("check"), "status", "message", F.lit(0).alias("place"))
    return tables, panel, stage(table.unionByName(listed), "file-checks")


def forecast_folder(spark: SparkSession, folder: str, chosen=jobs.SERIES_MODELS, detect_periods=True, expected=None) -> Folder:
    """All files below ``folder``: checked, benchmarked on their last known days, their empty targets predicted.

    The best model of each file fills its empty targets at the end.  ``expected(file)`` names files that
    must be there.
    """
    tables, panel, report = check_files(spark, folder, expected)
    panel = panel.drop("n_known")
    usable = stage_panel(panel.join(checks.accepted_series(report), KEY, "left_semi").drop(FILE_ROW))
    board = jobs.benchmark(usable, chosen, detect_periods=detect_periods).scores
    best = stage_by_series(evaluate.top_models(board, 1))
    yhat = stage_by_series(jobs.future_of_top(usable, best, chosen, detect_periods, n=1))
    placed = panel.select(KEY, DAY, FILE_ROW).join(yhat.select(KEY, DAY, "yhat"), [KEY, DAY])
    accepted = checks.accepted_series(report)
    rows = tables.select(F.col("path").alias(KEY), F.col("row").alias(FILE_ROW), "names", "cells").join(accepted, KEY, "left_semi")
    table = rows.join(placed.select(KEY, FILE_ROW, DAY, F.col("yhat").alias("predicted")), [KEY, FILE_ROW], "left")
    lines = report.groupBy(KEY).agg(
        F.min(F.when(F.col("status") == "error", F.struct("place", "check", "message")))["message"].alias("problem"))
    counts = tables.groupBy(F.col("path").alias(KEY)).agg(F.count(F.lit(1)).alias("n_rows"))
    predicted = placed.groupBy(KEY).agg(F.count("yhat").alias("n_predicted"))
    out = lines.join(counts, KEY, "left").join(predicted, KEY, "left").join(best.select(KEY, "model"), KEY, "left").select(
        KEY, F.when(F.col("problem").isNull(), "ok").otherwise("error").alias("status"),
        F.coalesce("problem", F.lit("forecast made")).alias("message"), F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"),
        F.coalesce("n_predicted", F.lit(0)).cast("bigint").alias("n_predicted"), "model")
    return Folder(out, board, table)


def export_folder(result: Folder, path: str) -> None:
    """The accepted files under their own column names, with a predicted column, one folder per file."""
    sinks.export_tables(result.table, path, FILE_ROW)
