"""Delimited files: checks, sniffing over many files at once, reading by each file's own header.

Files are read as undecoded lines with the place of each in its file; dialect and header are one
row per file that the lines meet by path.  No list of files reaches the driver, a large file is
read by many tasks, and files of any widths may stand in one folder.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayloom.functions.text import strip

# Accepted delimiters in order of preference, and how each is shown.
DELIMITERS = (",", ";", "\t", "|")
UTF8, LATIN1 = "utf-8-sig", "latin-1"
SPARK_ENCODING = {UTF8: "UTF-8", LATIN1: "ISO-8859-1"}
CONSISTENT_SHARE = 0.9
MAX_BYTES = 1024 * 1024  # optional threshold of file_checks


def file_checks(spark: SparkSession, folder: str, expected=None, max_bytes=None) -> DataFrame:
    """Presence, size and extension per file, from metadata alone (no content is read).

    ``expected`` is an optional DataFrame with a ``file`` column: names that must exist.
    """
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "path",
                F.col("length").alias("size_bytes"))
    )
    if expected is not None:
        found = expected.select("file").join(found, "file", "full")
    ext = F.lower(F.regexp_extract("file", r"(\.[^.]*)$", 1))
    too_large = F.col("size_bytes") >= max_bytes if max_bytes else F.lit(False)
    status = (
        F.when(F.col("path").isNull(), "error").when(too_large, "error")
        .when(ext != ".csv", "warning").otherwise("ok")
    )
    message = (
        F.when(F.col("path").isNull(), "not found").when(too_large, "too large")
        .when(ext != ".csv", "unexpected format").otherwise("delimited file")
    )
    return found.select("file", "path", "size_bytes", ext.alias("extension"),
                        status.alias("status"), message.alias("message"))


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Undecoded lines with their file: splittable, so one large file uses many tasks."""
    return (
        spark.read.option("recursiveFileLookup", "true").text(folder)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    )


def numbered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, line, value): undecoded lines with any text and the number of each in its file, from 0.

    A task reads the lines of a block in order, so an identifier that grows inside the task
    gives a line's place in its block; the blocks before it add their line counts.  What is
    ordered is blocks, not lines.
    """
    rows = (
        spark.read.option("recursiveFileLookup", "true").text(folder)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
        .filter(strip(F.col("value")) != "")
        .select("path", "block", "value", F.monotonically_increasing_id().alias("id"))
    )
    blocks = rows.groupBy("path", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("lines"))
    before = F.coalesce(F.sum("lines").over(
        Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("path", "block", (before - F.col("first")).alias("shift"))
    return rows.join(starts, ["path", "block"]).select("path", (F.col("id") + F.col("shift")).alias("line"), "value")


def _decoded(encoding="encoding"):
    latin = F.decode(F.col("value").cast("binary"), SPARK_ENCODING[LATIN1])
    text = F.when(F.col(encoding) == LATIN1, latin).otherwise(F.col("value"))
    return F.when(F.col("line") == 0, F.regexp_replace(text, "^\ufeff", "")).otherwise(text)


def split_fields(text, delimiter) -> "F.Column":
    """Fields of a line; a quoted one may hold the delimiter, and two quotes there are one."""
    def fields(d):
        mark = d if d != "|" else "\\|"
        raw = F.regexp_extract_all(F.concat(F.lit(d), text), F.lit(f'{mark}("(?:[^"]|"")*"[^{mark}]*|[^{mark}]*)'), F.lit(1))
        return F.transform(raw, lambda f: F.when(
            f.rlike('^"(?:[^"]|"")*"$'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
        ).otherwise(f))

    out = None
    for d in DELIMITERS:
        out = F.when(delimiter == d, fields(d)) if out is None else out.when(delimiter == d, fields(d))
    return out


def _headers(lines: DataFrame) -> DataFrame:
    """(path, delimiter, encoding, n_lines, names): dialect and header of each file, its first line."""
    heads = sniff_files(lines).join(lines.filter("line = 0"), "path")
    return heads.select("path", "delimiter", "encoding", "n_lines", split_fields(_decoded(), F.col("delimiter")).alias("names"))


def read_tables(spark: SparkSession, folder: str) -> DataFrame:
    """(path, delimiter, encoding, names, row, cells): the rows of all files of a folder.

    The first line of a file with any text is its header: ``names``.  ``row`` numbers the rows below
    it from 1 in file order, ``cells`` are their fields as text, an empty one null.  Blank lines are no
    rows.  A quoted field ends on its line.
    """
    lines = numbered_lines(spark, folder)
    rows = lines.filter("line > 0").join(_headers(lines), "path")
    cells = F.transform(split_fields(_decoded(), F.col("delimiter")), lambda c: F.when(c != "", c))
    return rows.select("path", "delimiter", "encoding", "names", F.col("line").alias("row"), cells.alias("cells"))


def table_report(spark: SparkSession, folder: str, expected=None) -> DataFrame:
    """(path, n_rows, n_columns, header_names, delimiter, encoding, status, message): one row per file.

    Errors: no data rows, one column only, a row with more fields than the header has names.  Spark
    lists no file of zero bytes; ``expected``, a DataFrame of names ``file`` that must exist, brings such
    and missing ones in, under their name as path.
    """
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        .select(F.col("_metadata.file_path").alias("path"))
    )
    if expected is not None:
        named = found.withColumn("file", F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B"))))
        found = expected.select("file").join(named, "file", "full").select(F.coalesce("path", "file").alias("path"), F.col("path").isNull().alias("gone"))
    else:
        found = found.withColumn("gone", F.lit(False))
    header = _headers(numbered_lines(spark, folder))
    widest = read_tables(spark, folder).groupBy("path").agg(F.max(F.size("cells")).alias("widest"))
    n_rows = F.coalesce(F.col("n_lines") - 1, F.lit(0)).cast("bigint")
    n_columns = F.coalesce(F.size("names"), F.lit(0)).cast("bigint")
    message = (
        F.when(F.col("gone"), "not found or empty").when(n_rows == 0, "no data rows")
        .when(n_columns < 2, "a date and a target column are needed")
        .when(F.col("widest") > n_columns, "a row has more fields than the header")
    )
    return found.join(header, "path", "left").join(widest, "path", "left").select(
        "path", n_rows.alias("n_rows"), n_columns.alias("n_columns"), F.col("names").alias("header_names"), "delimiter", "encoding",
        F.when(message.isNull(), "ok").otherwise("error").alias("status"), F.coalesce(message, F.lit("table read")).alias("message"))


def sniff_files(lines: DataFrame) -> DataFrame:
    """Encoding and delimiter per file in one pass over its lines.

    A file is UTF-8 when every line is; anything else is read as Latin-1.  A delimiter
    is consistent when nearly all lines hold it equally often; among consistent ones the
    steadiest wins, else the most frequent, else the comma.
    """
    bare = F.regexp_replace("value", '"[^"]*"', "")
    counts = F.array(*[
        F.struct(F.lit(i).alias("order"), F.lit(d).alias("delimiter"),
                 (F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias("hits"))
        for i, d in enumerate(DELIMITERS)
    ])
    per_count = (
        lines.filter(strip(F.col("value")) != "")
        .select("path", F.is_valid_utf8("value").alias("valid"), F.explode(counts).alias("c"))
        .groupBy("path", "c.order", "c.delimiter", "c.hits")
        .agg(F.count(F.lit(1)).alias("lines"), F.min("valid").alias("valid"))
    )
    per_delimiter = per_count.groupBy("path", "order", "delimiter").agg(
        F.max(F.when(F.col("hits") > 0, F.col("lines"))).alias("steady"),
        F.sum("lines").alias("lines"), F.sum(F.col("hits") * F.col("lines")).alias("total"),
        F.min("valid").alias("valid"),
    )
    share = F.col("steady") / F.col("lines")
    consistent = F.coalesce(share >= CONSISTENT_SHARE, F.lit(False))
    preference = F.struct(
        consistent.cast("int"), F.when(consistent, share).otherwise(0.0),
        F.when(~consistent, F.col("total")).otherwise(0), -F.col("order"),
    )
    return per_delimiter.groupBy("path").agg(
        F.max_by("delimiter", preference).alias("delimiter"),
        F.when(F.min("valid"), UTF8).otherwise(LATIN1).alias("encoding"),
        F.max("lines").alias("n_lines"),
    )


def read_delimited(spark: SparkSession, paths, sep=",", encoding=UTF8, columns=None) -> DataFrame:
    """Header files of one dialect and one column list as text columns, with the file each row came from.

    ``columns`` renames by position; values stay text and are cast by ``standardize``.
    """
    df = (
        spark.read.option("header", "true").option("sep", sep)
        .option("encoding", SPARK_ENCODING[encoding]).option("recursiveFileLookup", "true")
        .csv(paths)
    )
    if columns:
        df = df.toDF(*columns)
    return df.withColumn("path", F.col("_metadata.file_path"))


def read_panel_files(spark: SparkSession, folder: str, columns, order_col=None) -> DataFrame:
    """All files of a folder, each by its own delimiter, encoding and header, with ``path``.

    ``order_col`` names a column for the number of the row in its file, if wanted.

    The first field is the first of ``columns`` and the last named one the last, however many
    there are between; those in the middle are filled from files that have as many as ``columns``.
    A folder without any line gives no rows.
    """
    rows = read_tables(spark, folder)
    width = F.size("names")
    middle = [F.when(width == len(columns), F.get("cells", F.lit(i))).alias(c) for i, c in enumerate(columns[1:-1], 1)]
    return rows.select(F.get("cells", F.lit(0)).alias(columns[0]), *middle, F.get("cells", width - 1).alias(columns[-1]), "path",
                       *([F.col("row").alias(order_col)] if order_col else []))
