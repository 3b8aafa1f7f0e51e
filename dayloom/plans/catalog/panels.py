"""Standardisation queries."""

from pyspark.sql import functions as F

from dayloom.operators import panel as ops
from dayloom.plans.catalog.base import (
    MASKED_EXOG_SQL, MIXED_SQL, masked, masked_exog_panel, masked_sql, mixed_panel, query, rnd, r,
)
from dayloom.plans.catalog.checks import TEXTS, _texts
from dayloom.schema import DAY, KEY, TARGET


@query("standardize", f"""WITH panel AS ({MASKED_EXOG_SQL})
 SELECT series_id, ds, y, {r('disc')} AS disc, status, labels FROM panel""")
def standardize(spark, sf_dir):
    raw = masked_exog_panel(spark, sf_dir).select(
        KEY, F.date_format(DAY, "dd/MM/yyyy").alias("When"), "disc", "status", "labels",
        F.format_string("%.2f", F.col(TARGET)).alias("Amount"),
    ).withColumn("Amount", F.when(F.col("Amount") != "null", F.col("Amount")).otherwise("n/a"))
    out = ops.standardize(raw, fmt="d/M/yyyy")
    return out.withColumn("disc", rnd("disc"))


@query("parse_mixed_dates", f"""WITH {TEXTS} SELECT series_id, d AS raw_date, y,
 CASE WHEN series_id = 'A' THEN CAST(COALESCE(try_strptime(d, '%m/%d/%Y'), try_strptime(d, '%d/%m/%Y'))
  AS DATE) ELSE ds END AS ds FROM texts""")
def parse_mixed_dates(spark, sf_dir):
    # 'yy-MM-dd' texts need a known format, every other spelling is parsed cell by cell.
    raw = _texts(mixed_panel(spark, sf_dir)).drop(DAY).withColumn("raw_date", F.col("Date"))
    short = F.col(KEY) == "error"
    spelled = F.regexp_replace("Date", r"^(\p{L}{3})\.(\d+)\.", "$1 $2 ")
    raw = raw.withColumn("Date", F.when(short, F.concat(F.lit("20"), "Date")).otherwise(spelled))
    return ops.standardize(raw, date_col="Date", target_col=TARGET).select(
        KEY, "raw_date", DAY, TARGET)


_META = f"WITH panel AS ({masked_sql(MIXED_SQL)})"


@query("series_meta", f"""{_META}, seen AS (SELECT *, MAX(CASE WHEN y IS NOT NULL THEN ds END)
 OVER (PARTITION BY series_id) AS lo FROM panel)
 SELECT series_id, MAX(ds) AS last_day, MAX(lo) AS last_observed, COUNT(*) AS n_rows,
 COUNT(y) AS n_known, COUNT(*) FILTER (ds > lo) AS trailing_missing FROM seen GROUP BY 1""")
def series_meta(spark, sf_dir):
    return ops.series_meta(masked(mixed_panel(spark, sf_dir)))


@query("future_rows", f"""WITH panel AS ({MASKED_EXOG_SQL}), seen AS (SELECT *,
 MAX(CASE WHEN y IS NOT NULL THEN ds END) OVER (PARTITION BY series_id) AS lo FROM panel)
 SELECT series_id, ds, {r('disc')} AS disc, status, labels FROM seen WHERE ds > lo""")
def future_rows(spark, sf_dir):
    return ops.future_rows(masked_exog_panel(spark, sf_dir)).withColumn("disc", rnd("disc"))


@query("known_rows", f"{_META} SELECT series_id, ds, y FROM panel WHERE y IS NOT NULL")
def known_rows(spark, sf_dir):
    return ops.known_rows(masked(mixed_panel(spark, sf_dir)))


@query("series_fingerprint", f"""{_META} SELECT series_id, COUNT(*) AS n_rows,
 MIN(ds) AS first_day, MAX(ds) AS last_day, COUNT(y) AS n_known FROM panel GROUP BY 1""")
def series_fingerprint(spark, sf_dir):
    # The content hash is an engine-own value; the coarse form is what SQL can repeat.
    return ops.series_fingerprint(masked(mixed_panel(spark, sf_dir))).drop("content_hash")
