"""String expressions: numbers, labels and column-name tokens."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))$"
_SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"  # every blank, as Unicode sees it
_OUTER_SPACE = f"^{_SPACE}|{_SPACE}$"
LABEL_SEPARATORS = (",", ";", "|")


def strip(col: Column) -> Column:
    return F.regexp_replace(col, _OUTER_SPACE, "")


def to_number(col: Column) -> Column:
    """Text to double; anything that is not a plain number becomes NULL.

    The pattern guards the cast: on its own it also takes type suffixes (``1d``).
    """
    text = strip(col.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def no_nan(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def sanitize_token(col: Column) -> Column:
    """Letters and digits kept, every other run becomes one inner underscore."""
    cleaned = F.btrim(F.regexp_replace(col, r"[^\p{L}\p{N}]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("unknown"))


def multilabel_parse(col: Column) -> Column:
    """Labels of one cell: the first separator present is the only splitter."""
    text = col.cast("string")

    def split_on(sep):
        parts = F.transform(F.split(text, f"[{sep}]"), strip)
        return F.filter(parts, lambda p: p != "")

    whole = strip(text)
    single = F.when((whole != "") & (F.lower(whole) != "nan"), F.array(whole))
    expr = None
    for sep in LABEL_SEPARATORS:
        hit = F.contains(text, F.lit(sep))
        expr = F.when(hit, split_on(sep)) if expr is None else expr.when(hit, split_on(sep))
    return F.coalesce(expr.otherwise(single), F.array().cast("array<string>"))
