"""Session helpers for tests and the bench; a cluster brings its own session."""

import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cpus="8", app="dayloom", memory="8g"):
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark):
    """Folder every executor can reach, taken from the session's checkpoint setting.

    Only a local-mode session without the setting (tests) gets a temporary folder.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="dayloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_STAGED = []


def note_staged(path, table=None):
    """Remember a table written in the shared folder, for ``staging``."""
    _STAGED.append((path, table))


@contextmanager
def staging(spark):
    """Drop, at the end of the block, what was staged inside it; results must have been written or read by then.

    Paths that the block adds to the list it is given stay, and go with an outer block.
    """
    before, outlive = len(_STAGED), []
    try:
        yield outlive
    finally:
        kept = [x for x in _STAGED[before:] if x[0] in outlive]
        for path, table in _STAGED[before:]:
            if path in outlive:
                continue
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _STAGED[before:] = kept
