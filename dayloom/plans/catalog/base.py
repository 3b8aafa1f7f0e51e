"""Registry, shared panels and the SQL fragments that mirror them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.operators.panel import by_series, daily_panel
from dayloom.schema import DAY, KEY, TARGET

QUERIES = {}
ORACLES = {}
MASK_DAYS = 14


def query(name, sql=None):
    """Register a (spark, sf_dir) -> DataFrame function, with its oracle SQL if any."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# Exact decimal ties round differently in the two engines: both shift by the same small
# part of the last kept digit before rounding, which moves every tie to one side.
SHIFT = 0.1234567


def rnd(col, digits=6):
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col + F.lit(SHIFT * 10.0 ** -digits), digits) + F.lit(0.0)


def r(expr, digits=6):
    return f"(ROUND(({expr}) + CAST({SHIFT * 10.0 ** -digits!r} AS DOUBLE), {digits}) + 0.0)"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(column):
    """The given values have two decimals; as such both engines sum them exactly."""
    return F.col(column).cast("decimal(18,2)")


def lineitem_daily(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return daily_panel(t, F.col("l_returnflag"), F.col("l_shipdate"), _cents("l_extendedprice"))


def orders_daily(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    return daily_panel(t, F.col("o_orderpriority"), F.col("o_orderdate"), _cents("o_totalprice"))


def events_daily(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "events")
    return daily_panel(t, F.col("event_type"), F.col("ts"), _cents("value"))


def lineitem_wide(spark, sf_dir) -> DataFrame:
    """Many short series: one per part."""
    t = table(spark, sf_dir, "lineitem")
    return daily_panel(t, F.col("l_partkey"), F.col("l_shipdate"), _cents("l_extendedprice"))


def mixed_panel(spark, sf_dir) -> DataFrame:
    """Long, gappy and short series side by side."""
    return (lineitem_daily(spark, sf_dir).unionByName(orders_daily(spark, sf_dir))
            .unionByName(events_daily(spark, sf_dir)))


def exog_panel(spark, sf_dir) -> DataFrame:
    """Line item days with a numeric, a categorical and a label-list column."""
    t = table(spark, sf_dir, "lineitem")
    discount = F.sum(F.col("l_discount").cast("decimal(18,2)")).cast("double")
    return daily_panel(
        t, F.col("l_returnflag"), F.col("l_shipdate"), _cents("l_extendedprice"),
        disc=discount / F.count(F.lit(1)),
        status=F.min("l_linestatus"),
        labels=F.array_join(F.sort_array(F.collect_set("l_linestatus")), ","),
    )


def masked(panel: DataFrame) -> DataFrame:
    """The last two weeks of each series lose their target, as days to predict."""
    late = F.col(DAY) > F.date_sub(F.max(DAY).over(by_series()), MASK_DAYS)
    return panel.withColumn(TARGET, F.when(~late, F.col(TARGET)))


def masked_exog_panel(spark, sf_dir) -> DataFrame:
    """Future rows, and gaps in the categorical column."""
    status = F.when((F.col(KEY) == "R") & (F.dayofmonth(DAY) == 1), None).otherwise(F.col("status"))
    return masked(exog_panel(spark, sf_dir).withColumn("status", status))


_SUM = "CAST(SUM(CAST({v} AS DECIMAL(18,2))) AS DOUBLE)"

LINEITEM_SQL = f"""SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS ds,
 {_SUM.format(v='l_extendedprice')} AS y FROM lineitem GROUP BY 1, 2"""
ORDERS_SQL = f"""SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ds,
 {_SUM.format(v='o_totalprice')} AS y FROM orders GROUP BY 1, 2"""
EVENTS_SQL = f"""SELECT event_type AS series_id, CAST(ts AS DATE) AS ds,
 {_SUM.format(v='value')} AS y FROM events GROUP BY 1, 2"""
WIDE_SQL = f"""SELECT CAST(l_partkey AS VARCHAR) AS series_id, CAST(l_shipdate AS DATE) AS ds,
 {_SUM.format(v='l_extendedprice')} AS y FROM lineitem GROUP BY 1, 2"""
MIXED_SQL = f"{LINEITEM_SQL} UNION ALL {ORDERS_SQL} UNION ALL {EVENTS_SQL}"
EXOG_SQL = f"""SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS ds,
 {_SUM.format(v='l_extendedprice')} AS y,
 {_SUM.format(v='l_discount')} / COUNT(*) AS disc,
 MIN(l_linestatus) AS status,
 string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS labels
 FROM lineitem GROUP BY 1, 2"""


def masked_sql(source):
    return f"""SELECT * EXCLUDE (y), CASE WHEN ds > MAX(ds) OVER (PARTITION BY series_id) - {MASK_DAYS}
 THEN NULL ELSE y END AS y FROM ({source})"""


MASKED_EXOG_SQL = masked_sql(
    f"""SELECT * EXCLUDE (status), CASE WHEN series_id = 'R' AND day(ds) = 1 THEN NULL
 ELSE status END AS status FROM ({EXOG_SQL})""")
