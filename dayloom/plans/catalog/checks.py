"""Validation queries."""

from pyspark.sql import functions as F

from dayloom.operators import checks
from dayloom.plans.catalog.base import (
    EXOG_SQL, MIXED_SQL, masked, masked_sql, mixed_panel, query, exog_panel,
)
from dayloom.schema import DAY, KEY, TARGET

FEATURES = ("disc", "status", "labels")


def flawed(spark, sf_dir):
    """Future rows everywhere, one interior gap in a series, missing features in another."""
    base = masked(exog_panel(spark, sf_dir))
    hole = (F.col(KEY) == "N") & (F.year(DAY) == 1998) & (F.dayofyear(DAY) == 40)
    status = F.when((F.col(KEY) != "R") | (F.col("status") != "O"), F.col("status"))
    return base.withColumns({TARGET: F.when(~hole, F.col(TARGET)), "status": status})


FLAWED = f"""panel AS (SELECT series_id, ds, disc, labels,
 CASE WHEN series_id = 'N' AND year(ds) = 1998 AND dayofyear(ds) = 40 THEN NULL ELSE y END AS y,
 CASE WHEN series_id = 'R' THEN NULLIF(status, 'O') ELSE status END AS status
 FROM ({masked_sql(EXOG_SQL)}))"""

DATED = f"panel AS ({MIXED_SQL})"


def _summary(spark, sf_dir):
    return checks.check_summary(flawed(spark, sf_dir), FEATURES)


@query("check_counts", f"""WITH {FLAWED} SELECT series_id, COUNT(*) AS n_rows,
 CAST(5 AS BIGINT) AS n_columns,
 CASE WHEN COUNT(*) > 10000 THEN 'error' ELSE 'ok' END AS status FROM panel GROUP BY 1""")
def check_counts(spark, sf_dir):
    return checks.check_counts(_summary(spark, sf_dir), n_columns=5, max_rows=10_000)


_NULLS = """CAST(COUNT(*) FILTER (disc IS NULL) + COUNT(*) FILTER (status IS NULL)
 + COUNT(*) FILTER (labels IS NULL) AS BIGINT)"""


@query("check_nulls", f"""WITH {FLAWED} SELECT series_id, {_NULLS} AS feature_nulls,
 COUNT(*) FILTER (y IS NULL) AS target_nulls,
 {_NULLS} + COUNT(*) FILTER (y IS NULL) + COUNT(*) FILTER (ds IS NULL) AS total_nulls FROM panel GROUP BY 1""")
def check_nulls(spark, sf_dir):
    return checks.check_nulls(_summary(spark, sf_dir))


@query("check_feature_nulls", f"""WITH {FLAWED} SELECT series_id, {_NULLS} AS feature_nulls,
 CASE WHEN {_NULLS} + COUNT(*) FILTER (ds IS NULL) > 0 THEN 'error' ELSE 'ok' END AS status FROM panel GROUP BY 1""")
def check_feature_nulls(spark, sf_dir):
    return checks.check_feature_nulls(_summary(spark, sf_dir))


_TRAILING = """COALESCE(MIN(ds) FILTER (y IS NULL) > MAX(ds) FILTER (y IS NOT NULL),
 COUNT(y) > 0)"""


@query("check_trailing", f"""WITH {FLAWED} SELECT series_id, COUNT(y) AS n_known,
 COUNT(*) FILTER (y IS NULL) AS target_nulls,
 CASE WHEN {_TRAILING} THEN 'ok' ELSE 'error' END AS status FROM panel GROUP BY 1""")
def check_trailing(spark, sf_dir):
    return checks.check_trailing(_summary(spark, sf_dir))


@query("check_daily", f"""WITH {DATED}, steps AS (SELECT series_id,
 ds - LAG(ds) OVER (PARTITION BY series_id ORDER BY ds) AS step FROM panel)
 SELECT series_id, COUNT(*) AS n_rows,
 CASE WHEN COUNT(*) FILTER (step <> 1) = 0 THEN 'ok' ELSE 'error' END AS status
 FROM steps GROUP BY 1""")
def check_daily(spark, sf_dir):
    return checks.check_daily(checks.check_summary(mixed_panel(spark, sf_dir)))


def _texts(panel):
    """Each source writes its days differently."""
    d = F.col(DAY)
    text = (
        F.when(F.col(KEY) == "A", F.date_format(d, "dd/MM/yyyy"))
        .when(F.col(KEY) == "N", F.date_format(d, "MM-dd-yyyy"))
        .when(F.col(KEY) == "R", F.date_format(d, "d MMMM yyyy"))
        .when(F.col(KEY).isin("click", "view"), F.date_format(d, "yyyy.M.d"))
        .when(F.col(KEY) == "error", F.date_format(d, "yy-MM-dd"))
        .when(F.col(KEY).startswith("1"), F.date_format(d, "MMM.dd.yyyy"))
        .otherwise(F.date_format(d, "yyyy/MM/dd"))
    )
    return panel.select(KEY, text.alias("Date"), DAY, TARGET)


_TEXT = """CASE WHEN series_id = 'A' THEN strftime(ds, '%d/%m/%Y')
 WHEN series_id = 'N' THEN strftime(ds, '%m-%d-%Y')
 WHEN series_id = 'R' THEN day(ds) || ' ' || monthname(ds) || ' ' || year(ds)
 WHEN series_id IN ('click', 'view') THEN year(ds) || '.' || month(ds) || '.' || day(ds)
 WHEN series_id = 'error' THEN strftime(ds, '%y-%m-%d')
 WHEN series_id LIKE '1%' THEN strftime(ds, '%b.%d.%Y')
 ELSE strftime(ds, '%Y/%m/%d') END"""
TEXTS = f"{DATED}, texts AS (SELECT series_id, ds, y, {_TEXT} AS d FROM panel)"


def _strptime(fmt):
    """Spark pattern to the oracle's."""
    out = fmt.replace("MMMM", "%B").replace("MMM", "%b")
    out = out.replace("yyyy", "%Y").replace("yy", "%y").replace("M", "%m")
    return "".join("%d" if c == "d" else c for c in out) if "%" in out else out


def _digits(fmt):
    """The oracle's parser takes short years for long ones; digits are counted first."""
    if fmt.startswith("yyyy"):
        return r"\d{4}\D.*"
    if fmt.startswith("yy"):
        return r"\d{2}\D.*"
    return r".*\D\d{4}" if fmt.endswith("yyyy") else r".*\D\d{2}"


def _parsed_list(formats):
    return " UNION ALL ".join(
        f"SELECT series_id, ds, {i} AS priority, '{f}' AS fmt, "
        f"CASE WHEN regexp_full_match(d, '{_digits(f)}') "
        f"THEN CAST(try_strptime(d, '{_strptime(f)}') AS DATE) END AS day FROM texts"
        for i, f in enumerate(formats)
    )


_DETECT = f"""WITH {TEXTS}, tried AS ({_parsed_list(checks.DATE_FORMATS)}),
 steps AS (SELECT series_id, priority, fmt, day,
  day - LAG(day) OVER (PARTITION BY series_id, priority ORDER BY ds) AS step,
  ROW_NUMBER() OVER (PARTITION BY series_id, priority ORDER BY ds) AS pos FROM tried),
 verdict AS (SELECT series_id, priority, fmt, COUNT(*) AS n_rows,
  BOOL_AND(day IS NOT NULL AND (pos = 1 OR COALESCE(step = 1, FALSE))) AS ok
  FROM steps GROUP BY 1, 2, 3)
 SELECT series_id, MAX(n_rows) AS n_rows,
  ARG_MIN(fmt, priority) FILTER (ok) AS date_format FROM verdict GROUP BY 1"""


@query("detect_date_format", _DETECT)
def detect_date_format(spark, sf_dir):
    return checks.detect_date_format(_texts(mixed_panel(spark, sf_dir)), "Date")


_SAMPLE = f"""WITH base AS ({MIXED_SQL}),
 numbered AS (SELECT series_id, ds, y, {_TEXT} AS d,
  ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ds) AS rn FROM base),
 texts AS (SELECT * FROM numbered WHERE rn <= 200),
 tried AS ({_parsed_list(checks.SAMPLE_FORMATS)}),
 verdict AS (SELECT series_id, priority, fmt, COUNT(day) = COUNT(*) AS ok
  FROM tried GROUP BY 1, 2, 3)
 SELECT series_id, ARG_MIN(fmt, priority) FILTER (ok) AS date_format FROM verdict GROUP BY 1"""


@query("detect_format_sample", _SAMPLE)
def detect_format_sample(spark, sf_dir):
    return checks.detect_format_sample(_texts(mixed_panel(spark, sf_dir)), "Date", order_col=DAY)


@query("checklist", f"""WITH {FLAWED}, s AS (SELECT series_id, COUNT(*) AS n,
 {_NULLS} AS fn, COUNT(*) FILTER (y IS NULL) AS tn, {_TRAILING} AS at_end,
 MAX(ds) - MIN(ds) + 1 = COUNT(DISTINCT ds) AND COUNT(*) = COUNT(DISTINCT ds) AS daily
 FROM panel GROUP BY 1)
 SELECT series_id, 'rows' AS "check", CASE WHEN n > 10000 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN n > 10000 THEN n || ' rows, above the limit' ELSE n || ' rows' END AS message FROM s
 UNION ALL SELECT series_id, 'columns', 'ok', '5 columns' FROM s
 UNION ALL SELECT series_id, 'feature_nulls', CASE WHEN fn > 0 THEN 'error' ELSE 'ok' END,
  CASE WHEN fn > 0 THEN fn || ' feature cells missing' ELSE 'features complete' END FROM s
 UNION ALL SELECT series_id, 'target_nulls', CASE WHEN at_end THEN 'ok' ELSE 'error' END,
  CASE WHEN at_end THEN tn || ' targets to predict'
  ELSE 'missing targets must close the series' END FROM s
 UNION ALL SELECT series_id, 'daily', CASE WHEN daily THEN 'ok' ELSE 'error' END,
  CASE WHEN daily THEN 'days are consecutive' ELSE 'days are not one step apart' END FROM s""")
def checklist(spark, sf_dir):
    return checks.checklist(_summary(spark, sf_dir), n_columns=5, max_rows=10_000)
