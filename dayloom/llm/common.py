"""Helpers shared by the corpus operators."""

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from dayloom.session import note_staged, shared_dir

#: A word is a run of anything but blank and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def stage(df: DataFrame, label: str, outlive: list | None = None) -> DataFrame:
    """Write a table into the cluster's shared checkpoint folder and read it back.

    Ends the lineage: a lost executor re-reads a part instead of recomputing it.  The files
    lie under ``dayloom-llm`` there and go with a ``staging`` block or when that folder is cleaned;
    with the list ``outlive`` of such a block they stay after it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/dayloom-llm/{label}-{uuid.uuid4().hex}"
    note_staged(path)
    if outlive is not None:
        outlive.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_narrow(df: DataFrame, label: str) -> DataFrame:
    """``stage`` for a table of keys and digests: several partitions go into one file, at least four a core are left.

    A local file system without Hadoop's native library starts a few processes for each file, and a
    small file costs a task of its own to whoever reads it.  No rows are moved for this.
    """
    spark = df.sparkSession
    return stage(df.coalesce(max(4 * spark.sparkContext.defaultParallelism, partitions(spark) // 8)), label)


def parts(batches, rows: int = 512):
    """Arrow batches in slices of so many rows, so that a task's Python objects and answers stay small beside long texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def id_key(doc_id="doc_id", names=("key", "unknown")):
    """A nullable id as two columns without nulls, so joins and windows on them share one exchange."""
    return [F.coalesce(doc_id, F.lit(0)).alias(names[0]), F.isnull(doc_id).alias(names[1])]


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
