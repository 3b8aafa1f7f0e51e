"""Write a panel once, laid out by series, so later steps neither rescan nor reshuffle."""

import uuid

from pyspark.sql import DataFrame

from dayloom.schema import DAY, KEY
from dayloom.session import note_staged, shared_dir


def stage_by_series(df: DataFrame, sort=(KEY,), buckets=None) -> DataFrame:
    """Save a table bucketed by series in the shared folder and read it back.

    Windows, grouped tasks and joins keyed by series then read co-located buckets
    without an exchange.  The table also ends the lineage: a lost executor re-reads its
    bucket instead of recomputing it from raw data.  It stays until the end of a ``staging`` block.
    """
    spark = df.sparkSession
    buckets = int(buckets or spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"dayloom_{uuid.uuid4().hex}"
    note_staged(f"{shared_dir(spark)}/{name}", name)
    (
        df.repartition(buckets, KEY)
        .write.format("parquet")
        .option("path", f"{shared_dir(spark)}/{name}")
        .bucketBy(buckets, KEY).sortBy(*sort)
        .saveAsTable(name)
    )
    return spark.table(name)


def stage_panel(panel: DataFrame, buckets=None) -> DataFrame:
    """Raw data is scanned and aggregated a single time, then laid out by series and day."""
    return stage_by_series(panel, (KEY, DAY), buckets)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table in the shared folder as it lies and read it back: its lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/dayloom-{label}-{uuid.uuid4().hex}"
    note_staged(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
