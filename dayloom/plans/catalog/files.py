"""File queries: the daily panel written out in several dialects and read back."""

import uuid

from pyspark.sql import functions as F

from dayloom.operators import checks
from dayloom.operators.panel import standardize
from dayloom.plans.catalog.base import (
    EVENTS_SQL, LINEITEM_SQL, MASK_DAYS, events_daily, lineitem_daily, masked, query,
)
from dayloom.plans.folder import forecast_folder
from dayloom.plans.stage import stage
from dayloom.schema import DAY, KEY, TARGET
from dayloom.session import shared_dir
from dayloom.sources import files

# Dialect of each series: delimiter, encoding of the writer, target header.
DIALECTS = {
    "A": (",", "UTF-8", "Größe"),
    "N": (";", "ISO-8859-1", "Größe"),
    "R": ("\t", "UTF-8", "Amount"),
}


def write_dialects(spark, sf_dir):
    """One folder per series below a fresh folder of the shared directory."""
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    panel = lineitem_daily(spark, sf_dir)
    for key, (sep, encoding, name) in DIALECTS.items():
        rows = panel.filter(F.col(KEY) == key).select(
            F.date_format(DAY, "dd/MM/yyyy").alias("Date"),
            F.format_string("%.2f", F.col(TARGET)).alias(name))
        (rows.write.option("header", "true").option("sep", sep).option("encoding", encoding)
         .csv(f"{folder}/{key}"))
    return folder


def _owner(path="path"):
    return F.element_at(F.split(path, "/"), -2)


@query("read_panel", LINEITEM_SQL)
def read_panel(spark, sf_dir):
    raw = files.read_panel_files(spark, write_dialects(spark, sf_dir), ["Date", "Amount"])
    keyed = raw.select(_owner().alias(KEY), "Date", "Amount")
    return standardize(keyed, fmt="d/M/yyyy")


_NAMES = {"A": ["Date", "Amount"], "N": ["Tag", "promo, art", "Größe"], "R": ["day", "p", 'the "note"', "Amount"]}
_NOTE = """CASE WHEN day(ds) % 2 = 0 THEN 'a, b; c' ELSE 'say "no"' END"""


def write_mixed(spark, sf_dir):
    """Files of two, three and four columns, one of them quoted and in Latin-1, below one folder."""
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    panel = lineitem_daily(spark, sf_dir)
    day = F.dayofmonth(DAY)
    middle = {"A": [], "N": [day.cast("string")],
              "R": [F.weekday(DAY).cast("string"), F.when(day % 2 == 0, "a, b; c").otherwise('say "no"')]}
    for key, (sep, encoding, _) in DIALECTS.items():
        cells = [F.date_format(DAY, "dd/MM/yyyy"), *middle[key], F.format_string("%.2f", F.col(TARGET))]
        rows = panel.filter(F.col(KEY) == key).select(*[c.alias(n) for c, n in zip(cells, _NAMES[key])])
        (rows.write.option("header", "true").option("sep", sep).option("encoding", encoding).option("escape", '"')
         .csv(f"{folder}/{key}"))
    return folder


@query("read_mixed_folder", f"""SELECT series_id, ds, y, {', '.join(
    f"CASE series_id {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v[i]}{chr(39)}' for k, v in _NAMES.items())} END AS {c}"
    for c, i in (("first_name", 0), ("target_name", -1)))},
 CASE series_id WHEN 'A' THEN '' WHEN 'N' THEN 'promo, art=' || day(ds) ELSE 'p=' || (isodow(ds) - 1) || '|the "note"=' || ({_NOTE}) END AS middle
 FROM ({LINEITEM_SQL})""")
def read_mixed_folder(spark, sf_dir):
    """Each file by its own header: first column the day, last the target, whatever stands between."""
    rows = files.read_tables(spark, write_mixed(spark, sf_dir))
    inner = F.slice(F.arrays_zip(F.col("names").alias("n"), F.col("cells").alias("c")), F.lit(2), F.size("names") - 2)
    named = rows.select(
        _owner().alias(KEY), F.col("cells")[0].alias("Date"), F.get("names", F.lit(0)).alias("first_name"),
        F.get("names", F.size("names") - 1).alias("target_name"),
        F.array_join(F.transform(inner, lambda m: F.concat(m["n"], F.lit("="), m["c"])), "|").alias("middle"),
        F.get("cells", F.size("names") - 1).alias("Amount"))
    return standardize(named, fmt="d/M/yyyy", date_col="Date", target_col="Amount")


def write_ordered(spark, sf_dir):
    """One file a series in the order of days, and a fourth in the order of the written date."""
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    panel = lineitem_daily(spark, sf_dir)
    text = F.date_format(DAY, "dd/MM/yyyy").alias("Date")
    for name, key, order in (("A", "A", DAY), ("N", "N", DAY), ("R", "R", DAY), ("A-mixed", "A", "Date")):
        rows = panel.filter(F.col(KEY) == key).select(DAY, text, F.format_string("%.2f", F.col(TARGET)).alias("Amount"))
        # as many rows as a series has days, so one file is small
        rows.coalesce(1).sortWithinPartitions(order).drop(DAY).write.option("header", "true").csv(f"{folder}/{name}")
    return folder


_ORDERED = f"""{LINEITEM_SQL} UNION ALL SELECT 'A-mixed' AS series_id, ds, y FROM ({LINEITEM_SQL}) WHERE series_id = 'A'"""


@query("daily_in_file_order", f"""WITH p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id
  ORDER BY CASE WHEN series_id = 'A-mixed' THEN strftime(ds, '%d/%m/%Y') ELSE strftime(ds, '%Y%m%d') END) AS row FROM ({_ORDERED})),
 s AS (SELECT *, ds - LAG(ds) OVER (PARTITION BY series_id ORDER BY row) AS step FROM p),
 c AS (SELECT series_id, COUNT(*) AS n_rows, COALESCE(BOOL_AND(step = 1), TRUE) AS daily FROM s GROUP BY 1)
 SELECT series_id, n_rows, CASE WHEN daily THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN daily THEN 'd/M/yyyy' END AS date_format FROM c""")
def daily_in_file_order(spark, sf_dir):
    """Days must follow each other in the order of the file, and the format is the one by which they do."""
    raw = files.read_panel_files(spark, write_ordered(spark, sf_dir), ["Date", "Amount"], "row").withColumn(KEY, _owner())
    raw = stage(raw.select(KEY, "Date", "Amount", "row"), "file-rows")
    found = checks.detect_date_format(raw, "Date", "row")
    panel = standardize(raw.select(KEY, "Date", "row", "Amount"), fmt="d/M/yyyy")
    daily = checks.check_daily(checks.check_summary(panel, order_col="row"))
    return daily.join(found.select(KEY, "date_format"), KEY)


_BY_SERIES = f"SELECT series_id, COUNT(*) AS n FROM ({LINEITEM_SQL}) GROUP BY 1"


def _sniffed(spark, sf_dir):
    found = files.sniff_files(files.read_lines(spark, write_dialects(spark, sf_dir)))
    return found.withColumn(KEY, _owner())


@query("infer_delimiter", f"""SELECT series_id, CASE series_id WHEN 'A' THEN ',' WHEN 'N' THEN ';'
 ELSE chr(9) END AS delimiter, n AS data_lines FROM ({_BY_SERIES})""")
def infer_delimiter(spark, sf_dir):
    found = _sniffed(spark, sf_dir)
    return found.groupBy(KEY, "delimiter").agg((F.sum(F.col("n_lines") - 1)).alias("data_lines"))


@query("infer_encoding", f"""SELECT series_id, CASE series_id WHEN 'N' THEN 'latin-1'
 ELSE 'utf-8-sig' END AS encoding, n AS data_lines FROM ({_BY_SERIES})""")
def infer_encoding(spark, sf_dir):
    found = _sniffed(spark, sf_dir)
    return found.groupBy(KEY, "encoding").agg((F.sum(F.col("n_lines") - 1)).alias("data_lines"))


@query("file_checks", f"""SELECT series_id, '.csv' AS extension, 'ok' AS status,
 TRUE AS has_content FROM ({_BY_SERIES})""")
def file_checks(spark, sf_dir):
    found = files.file_checks(spark, write_dialects(spark, sf_dir)).withColumn(KEY, _owner())
    return found.groupBy(KEY, "extension", "status").agg(
        (F.sum("size_bytes") > 0).alias("has_content"))


def write_jobs(spark, sf_dir):
    """A file per series in the order of days, targets empty at the end; three that can't be used."""
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    panel = masked(lineitem_daily(spark, sf_dir).unionByName(events_daily(spark, sf_dir))).withColumns({
        "Date": F.date_format(DAY, "dd/MM/yyyy"), "Amount": F.format_string("%.2f", F.col(TARGET)),
        "promo": F.dayofmonth(DAY) % 3, "art": F.when(F.weekday(DAY) < 5, "a,b").otherwise("b")})
    panel = panel.withColumn("Amount", F.when(F.col(TARGET).isNotNull(), F.col("Amount")))

    def put(name, rows, order, columns):
        # as many rows as a series has days, so one file is small
        rows.coalesce(1).sortWithinPartitions(order).select(*columns).write.option("header", "true").csv(f"{folder}/{name}")

    for key in FILE_SERIES:
        middle = ["promo", "art"] if key in ("A", "view") else []
        put(key, panel.filter(F.col(KEY) == key), DAY, ["Date", *middle, "Amount"])
    views = panel.filter(F.col(KEY) == "view")
    put("mixed", views, F.md5("Date"), ["Date", "Amount"])
    put("one-column", views, DAY, ["Date"])
    put("no-rows", views.limit(0), DAY, ["Date", "Amount"])
    return folder


FILE_SERIES = ("A", "N", "R", "click", "error", "purchase", "signup", "view")
_JOBS = f"{LINEITEM_SQL} UNION ALL {EVENTS_SQL}"


@query("file_to_forecast", f"""WITH p AS ({_JOBS}), s AS (SELECT series_id, COUNT(*) AS n, MAX(ds) - MIN(ds) + 1 AS span FROM p GROUP BY 1),
 v AS (SELECT COUNT(*) AS n FROM p WHERE series_id = 'view')
 SELECT series_id, CASE WHEN n = span THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN n = span THEN 'forecast made' ELSE 'days are not one step apart' END AS message, n AS n_rows,
  CASE WHEN n = span THEN {MASK_DAYS} ELSE 0 END AS n_predicted, n = span AS has_model FROM s
 UNION ALL SELECT 'mixed', 'error', 'days are not one step apart', n, 0, FALSE FROM v
 UNION ALL SELECT 'one-column', 'error', 'a date and a target column are needed', n, 0, FALSE FROM v
 UNION ALL SELECT 'no-rows', 'error', 'no data rows', 0, 0, FALSE""")
def file_to_forecast(spark, sf_dir):
    """Files in, checks, benchmark and predictions out: one row per file."""
    result = forecast_folder(spark, write_jobs(spark, sf_dir), ("Ridge (alpha=2.0)", "SGD"), detect_periods=False)
    return result.report.select(
        _owner(KEY).alias(KEY), "status", "message", "n_rows", "n_predicted", F.col("model").isNotNull().alias("has_model"))
