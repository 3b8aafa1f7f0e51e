"""Date formats and date parsing expressions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date formats, most preferred first.
DATE_FORMATS = (
    "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "M/d/yyyy", "M-d-yyyy", "M.d.yyyy",
    "yyyy-M-d", "yyyy/M/d", "yyyy.M.d",
    "d/M/yy", "d-M-yy", "d.M.yy", "M/d/yy", "M-d-yy", "M.d.yy",
    "yy-M-d", "yy/M/d", "yy.M.d",
    "d M yyyy", "M d yyyy", "yyyy M d", "d M yy", "M d yy", "yy M d",
    "d MMMM yyyy", "MMMM d yyyy", "d MMM yyyy", "MMM d yyyy", "yyyy MMMM d", "yyyy MMM d",
    "d/MMMM/yyyy", "MMMM/d/yyyy", "d-MMMM-yyyy", "MMMM-d-yyyy", "d.MMMM.yyyy", "MMMM.d.yyyy",
    "d/MMM/yyyy", "MMM/d/yyyy", "d-MMM-yyyy", "MMM-d-yyyy", "d.MMM.yyyy", "MMM.d.yyyy",
)

# Formats tried when only a sample is looked at.
SAMPLE_FORMATS = (
    "yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d",
    "d-M-yyyy", "M-d-yyyy", "yyyy.M.d", "d.M.yyyy",
)

# Spellings taken when no format is known, in the order they are tried.
YEAR_FIRST = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d")
MONTH_FIRST = ("M/d/yyyy", "M-d-yyyy", "M.d.yyyy")
DAY_FIRST = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy")
NAMED_MONTH = ("d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy")


def _two_digit_century(parsed: Column) -> Column:
    """Two-digit years 69-99 belong to the 1900s."""
    return F.when(F.year(parsed) >= 2069, F.add_months(parsed, -1200)).otherwise(parsed)


def parse_with(text: str, fmt: str) -> Column:
    """Parse column ``text`` with the format held in column ``fmt``."""
    parsed = F.expr(f"try_to_date({text}, {fmt})")
    short_year = ~F.contains(F.col(fmt), F.lit("yyyy"))
    return F.when(short_year, _two_digit_century(parsed)).otherwise(parsed)


def parse_fixed(col: Column, fmt: str) -> Column:
    parsed = F.try_to_date(col, fmt)
    return parsed if "yyyy" in fmt else _two_digit_century(parsed)


def parse_mixed(col: Column, day_first: Column = None) -> Column:
    """Parse without a known format: months before days unless ``day_first`` is true."""
    text = F.btrim(col.cast("string"))
    tried = lambda formats: F.coalesce(*[F.try_to_date(text, f) for f in formats])
    slashed = tried(MONTH_FIRST + DAY_FIRST)
    if day_first is not None:
        slashed = F.when(day_first, tried(DAY_FIRST + MONTH_FIRST)).otherwise(slashed)
    return F.coalesce(tried(YEAR_FIRST), slashed, tried(NAMED_MONTH), F.try_to_timestamp(text).cast("date"))


def _shape(fmt: str) -> str:
    """Regex of the texts a format can parse at all."""
    pieces = {"yyyy": r"\d{4}", "yy": r"\d{2}", "d": r"\d{1,2}", "M": r"\d{1,2}",
              "MMM": r"\p{L}+", "MMMM": r"\p{L}+"}
    return "^" + re.sub(r"[a-zA-Z]+|[^a-zA-Z]",
                        lambda m: pieces.get(m[0]) or re.escape(m[0]), fmt) + "$"


def parsed_by(col: Column, formats) -> Column:
    """Array of (priority, fmt, day), one entry per format.

    Formats are literals, so each parser is built once rather than once per row, and
    the shape test spares the parser (and its exceptions) texts it cannot take.
    """
    return F.array(*[
        F.struct(F.lit(i).alias("priority"), F.lit(f).alias("fmt"),
                 F.when(col.rlike(_shape(f)), parse_fixed(col, f)).alias("day"))
        for i, f in enumerate(formats)
    ])
