"""A benchmark that is kept: only series whose content changed since the last run are fitted again.

The store is a table of scores by bucket of series, each row with the content hash of the panel rows
it was made from.  A run compares hashes, benchmarks new and changed series, and overwrites the
buckets they are in, taking the other rows of those buckets along.  Only rows whose hash is that of
the panel count, so a run that is stopped anywhere is made good by the next one.
"""

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.operators.panel import series_fingerprint
from dayloom.plans import benchmark as jobs
from dayloom.plans.stage import stage, stage_by_series
from dayloom.schema import KEY

BUCKETS = 256
SCORES = ("series_id string, model string, n_test bigint, rmse double, mape double, smape double, "
          "accuracy_pct double, rank int, content_hash decimal(38,0), settings string, bucket int")


class Refresh(NamedTuple):
    scores: DataFrame    # the leaderboard of every series of the panel
    changed: DataFrame   # (series_id): series that were benchmarked in this run


def stored(spark, path: str) -> DataFrame:
    """What earlier runs left at ``path``; empty before the first."""
    try:
        return spark.read.schema(SCORES).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCORES)


def _settings(chosen, options):
    return "; ".join([*chosen, *(f"{k}={v}" for k, v in sorted(options.items()))])


def refresh(panel: DataFrame, path: str, chosen=jobs.SERIES_MODELS, buckets=BUCKETS, **options) -> Refresh:
    """Scores of all series of a staged panel, with fits only for those that changed.

    ``options`` go to ``benchmark``.  Models and options are part of what must be equal for a row to
    be kept; whoever adds a series' day, value or exogenous cell changes its hash.  Series that are
    gone leave the result at once and the store with the next write to their bucket.
    """
    spark = panel.sparkSession
    settings = _settings(chosen, options)
    # the coarse numbers are part of the comparison through the hash: a row more is another sum
    prints = stage_by_series(series_fingerprint(panel).select(KEY, F.col("content_hash").cast("decimal(38,0)").alias("content_hash")).withColumns({
        "settings": F.lit(settings), "bucket": F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int")}))
    same = [KEY, "content_hash", "settings"]
    kept = stored(spark, path).join(prints.select(*same), same, "left_semi")
    changed = stage_by_series(prints.join(kept.select(KEY).distinct(), KEY, "left_anti").select(KEY, "content_hash", "settings", "bucket"))
    touched = [r.bucket for r in changed.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
    if touched:
        scores = jobs.benchmark(panel.join(changed.select(KEY), KEY, "left_semi"), chosen, **options).scores
        new = scores.join(changed, KEY)
        columns = [c.split()[0] for c in SCORES.split(", ")]
        rest = kept.filter(F.col("bucket").isin(touched))
        rows = stage(new.select(*columns).unionByName(rest.select(*columns)), "refreshed")
        (rows.repartition("bucket").write.partitionBy("bucket").mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").parquet(path))
    result = stored(spark, path).join(prints.select(*same), same, "left_semi").drop("content_hash", "settings", "bucket")
    return Refresh(result, changed.select(KEY))
