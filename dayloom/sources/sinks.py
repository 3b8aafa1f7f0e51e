"""Result sink: the raw table with its predicted column."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.schema import DAY, KEY


def join_predictions(panel: DataFrame, best: DataFrame, target_name="target",
                     date_name="date") -> DataFrame:
    """Every raw row, with ``predicted_<target>`` filled on the predicted days."""
    predicted = best.select(KEY, DAY, F.col("yhat").alias(f"predicted_{target_name}"))
    joined = panel.join(predicted, [KEY, DAY], "left")
    rest = [c for c in joined.columns if c not in (KEY, DAY)]
    return joined.select(KEY, F.date_format(DAY, "dd/MM/yyyy").alias(date_name), *rest)


def write_predictions(panel: DataFrame, best: DataFrame, path: str, target_name="target",
                      date_name="date") -> None:
    table = join_predictions(panel, best, target_name, date_name)
    table.write.mode("errorifexists").option("header", "true").csv(path)


def csv_line(fields) -> Column:
    """Fields as one comma-separated line, quoted where they must be; null is empty."""
    quoted = lambda f: F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.array_join(F.transform(fields, lambda f: F.when(
        f.rlike('[",\\r\\n]'), quoted(f)).otherwise(F.coalesce(f, F.lit("")))), ",")


def export_tables(rows: DataFrame, path: str, order_col: str) -> None:
    """Write one comma-separated file per series, with its own header and a ``predicted_`` column last.

    In: ``series_id``, ``order_col``, ``names``, ``cells`` (text, as read) and ``predicted``.  The new
    files are written aside and take their series' place when the whole job has been committed; a
    job that fails before leaves the earlier export as it was, and other series stay.
    """
    width = F.size("names")
    cells = F.transform("names", lambda n, i: F.get(F.col("cells"), i))
    target = F.get("names", width - 1)
    body = rows.select(KEY, F.col(order_col).alias("place"), csv_line(F.concat(
        cells, F.array(F.col("predicted").cast("string")))).alias("line"))
    head = rows.groupBy(KEY).agg(F.first("names").alias("names")).select(
        KEY, F.lit(0).cast("bigint").alias("place"), csv_line(F.concat("names", F.array(F.concat(F.lit("predicted_"), target)))).alias("line"))
    lines = body.withColumn("place", F.col("place").cast("bigint")).unionByName(head)
    (lines.repartition(KEY).sortWithinPartitions(KEY, "place").select(KEY, "line")
     .write.partitionBy(KEY).mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path))
