"""Files of any widths in one folder, each by its own header, and rows in the order of the file."""

import csv
import datetime as dt
import io

import pytest
from pyspark.sql import functions as F

from dayloom.operators import checks
from dayloom.operators.panel import standardize
from dayloom.schema import KEY
from dayloom.sources import files


def _folder(tmp_path, texts):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in texts.items():
        (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


def _base(path="path"):
    return F.element_at(F.split(path, "/"), -1)


def test_files_of_different_widths(spark, tmp_path):
    folder = _folder(tmp_path, {
        "a.csv": "d,v\n1,5\n2,6\n", "b.csv": "d,promo,v\n1,9,7\n", "c d%.csv": "﻿Tag;Größe;art;Wert\n1;x,y;\"a;b\";8\n\n2;;z;\n".encode(),
        "e.csv": "Tag|Größe\n1|4\n".encode("latin-1"), "f.csv": "\n  \nd\tv\n3\t2\n"})
    rows = files.read_tables(spark, folder).withColumn("file", _base()).collect()
    got = {(r.file, r.row): (r.names, r.cells) for r in rows}
    assert got == {
        ("a.csv", 1): (["d", "v"], ["1", "5"]), ("a.csv", 2): (["d", "v"], ["2", "6"]), ("b.csv", 1): (["d", "promo", "v"], ["1", "9", "7"]),
        ("c%20d%25.csv", 1): (["Tag", "Größe", "art", "Wert"], ["1", "x,y", "a;b", "8"]),
        ("c%20d%25.csv", 2): (["Tag", "Größe", "art", "Wert"], ["2", None, "z", None]),
        ("e.csv", 1): (["Tag", "Größe"], ["1", "4"]), ("f.csv", 1): (["d", "v"], ["3", "2"])}
    panel = files.read_panel_files(spark, folder, ["day", "extra", "value"]).select(_base().alias("f"), "day", "extra", "value").collect()
    assert {(r.f, r.day): (r.extra, r.value) for r in panel} == {
        ("a.csv", "1"): (None, "5"), ("a.csv", "2"): (None, "6"), ("b.csv", "1"): ("9", "7"), ("c%20d%25.csv", "1"): (None, "8"),
        ("c%20d%25.csv", "2"): (None, None), ("e.csv", "1"): (None, "4"), ("f.csv", "3"): (None, "2")}


LINES = ["a,b,c", ",,", "a,,", ",x,", '"a,b",c', '"say ""no""",2', '"",x', 'a"b,c', '"open,b', "é,ü", "one", ",", '" padded ",1']


@pytest.mark.parametrize("delimiter", files.DELIMITERS)
def test_fields_equal_the_csv_reader(spark, delimiter):
    lines = [x.replace(",", delimiter) for x in LINES if "open" not in x]
    df = spark.createDataFrame([(x, delimiter) for x in lines], "text string, d string")
    got = [r[0] for r in df.select(files.split_fields(F.col("text"), F.col("d"))).collect()]
    assert got == [next(csv.reader(io.StringIO(x), delimiter=delimiter)) for x in lines]


def test_rows_are_numbered_over_many_blocks(spark, tmp_path):
    texts = {f"{k}.csv": "i,v\n" + "".join(f"{i},{'x' * (i * 7 % 50)}\n" + "\n" * (i % 5 == 0) for i in range(n))
             for k, n in (("a", 3000), ("b", 7), ("c", 1200))}
    folder = _folder(tmp_path, texts)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("1000", "20000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "10")
            rows = files.read_tables(spark, folder)
            blocks = spark.read.text(folder).select("_metadata.file_block_start").distinct().count()
            assert blocks > 3
            bad = rows.filter(F.col("cells")[0].cast("long") + 1 != F.col("row")).count()
            assert bad == 0 and rows.count() == 4207
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_five_row_file_settles_its_format(spark, tmp_path):
    """01/01 ... 05/01 is five days only if the day stands first, and only in the order of the file."""
    days = [f"{i:02d}/01/2023" for i in range(1, 6)]
    mixed = [days[i] for i in (2, 0, 1, 3, 4)]
    folder = _folder(tmp_path, {n: "Date,Temperature\n" + "".join(f"{d},{20 + i}\n" for i, d in enumerate(own))
                                for n, own in (("in-order.csv", days), ("mixed.csv", mixed))})
    raw = files.read_panel_files(spark, folder, ["Date", "Temperature"], "row").withColumn(KEY, _base()).drop("path")
    found = {r.series_id: r.date_format for r in checks.detect_date_format(raw, "Date", "row").collect()}
    assert found == {"in-order.csv": "d/M/yyyy", "mixed.csv": None}
    panel = standardize(raw.select(KEY, "Date", "row", "Temperature"), fmt="d/M/yyyy")
    daily = {r.series_id: r.status for r in checks.check_daily(checks.check_summary(panel, order_col="row")).collect()}
    assert daily == {"in-order.csv": "ok", "mixed.csv": "error"}
    assert {r.ds for r in panel.collect()} == {dt.date(2023, 1, i) for i in range(1, 6)}


def test_report_has_a_row_for_every_file(spark, tmp_path):
    folder = _folder(tmp_path, {"ok.csv": "d,v\n1,2\n", "empty.csv": "", "head.csv": "d,v\n", "one.csv": "d\n1\n2\n", "blank.csv": "\n\n",
                                "ragged.csv": "d,v\n1,2\n1,2,3\n", "short.csv": "d;p;v\n1;2;3\n4\n"})
    names = spark.createDataFrame([("empty.csv",), ("ok.csv",), ("gone.csv",)], "file string")
    got = {r.f: (r.n_rows, r.n_columns, r.status, r.message) for r in files.table_report(spark, folder, names).withColumn("f", _base()).collect()}
    assert got == {
        "ok.csv": (1, 2, "ok", "table read"), "empty.csv": (0, 0, "error", "not found or empty"), "gone.csv": (0, 0, "error", "not found or empty"), "blank.csv": (0, 0, "error", "no data rows"),
        "head.csv": (0, 2, "error", "no data rows"), "one.csv": (2, 1, "error", "a date and a target column are needed"),
        "ragged.csv": (2, 2, "error", "a row has more fields than the header"), "short.csv": (2, 3, "ok", "table read")}
