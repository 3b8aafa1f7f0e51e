"""Exogenous columns: kind inference, level tables and encodings.

The level table is a DataFrame with one row per output column, so it can be any size.
``wide_columns`` makes a frame of it, whose schema names every level; ``encode_long`` gives the same
encoding as rows.  Fits use neither: ``Columns`` (or ``Cells``, where columns differ by series) turn a
row's cells into a few doubles and the names of the levels it has, and each series numbers its own.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions.text import multilabel_parse, sanitize_token, to_number
from dayloom.operators.panel import by_day, exog_columns
from dayloom.schema import DAY, KEY, LABEL_SAMPLE, NUMERIC_SHARE

NULL_LEVEL = "nan"


def _present(c):
    return F.col(f"`{c}`").isNotNull()


def _text(cell: Column) -> Column:
    """A cell as text; a boolean is the number 1 or 0."""
    text = cell.cast("string")
    return F.when(F.typeof(cell) == "boolean", F.when(text == "true", "1").when(text == "false", "0")).otherwise(text)


def exog_kinds(panel: DataFrame, columns=None) -> DataFrame:
    """One row per exogenous column: numeric, multilabel or categorical.

    Only the leading non-null cells of each series are looked at for label lists; that
    sample is the rule itself.  The running count is keyed by series, and the result is
    one partial aggregate per task.
    """
    columns = list(columns or exog_columns(panel))
    running = by_day().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = panel.select(
        KEY, DAY, *[_text(F.col(f"`{c}`")).alias(c) for c in columns],
    ).select(
        "*", *[F.count(F.col(f"`{c}`")).over(running).alias(f"{c}__seen") for c in columns]
    )
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        sampled = _present(c) & (F.col(f"`{c}__seen`") <= LABEL_SAMPLE)
        aggs += [
            F.count(to_number(F.col(f"`{c}`"))).alias(f"{c}__numbers"),
            F.max(sampled & (F.size(multilabel_parse(F.col(f"`{c}`"))) >= 2)).alias(f"{c}__lists"),
        ]
    wide = counted.agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("original_name"),
            sanitize_token(F.lit(c)).alias("base"),
            F.when(F.col(f"`{c}__numbers`") >= F.col("rows") * NUMERIC_SHARE, "numeric")
            .when(F.col(f"`{c}__lists`"), "multilabel").otherwise("categorical").alias("kind"),
        )
        for c in columns
    ])
    return wide.select(F.explode(rows).alias("k")).select("k.*")


def _known_kinds(kinds):
    """Kinds as rows: one per source column, so always small."""
    return kinds.collect() if isinstance(kinds, DataFrame) else list(kinds)


def _level_array(kind) -> Column:
    """Levels present in one cell; empty for numbers and for missing categories."""
    cell = _text(F.col(f"`{kind['original_name']}`"))
    if kind["kind"] == "multilabel":
        return multilabel_parse(cell)
    return F.when(cell.isNotNull(), F.array(cell))


def exog_levels(panel: DataFrame, kinds, columns=None) -> DataFrame:
    """Training schema in long form: one row per encoded column.

    One pass over the panel: distinct (column, level) pairs, merged inside each task
    before they move.  ``kinds`` is the table of ``exog_kinds`` or its rows.
    """
    columns = list(columns or exog_columns(panel))
    known = [k for k in _known_kinds(kinds) if k["original_name"] in columns]
    coded = [k for k in known if k["kind"] != "numeric"]
    # Numbers have one column and no level; every categorical has a null level.
    plain = panel.sparkSession.createDataFrame(
        [(k["original_name"], k["base"], k["kind"], None)
         for k in known if k["kind"] != "multilabel"],
        "original_name string, base string, kind string, level string")
    levels = plain
    if coded:
        entries = F.array(*[
            F.struct(F.lit(k["original_name"]).alias("original_name"),
                     F.lit(k["base"]).alias("base"), F.lit(k["kind"]).alias("kind"),
                     _level_array(k).alias("levels"))
            for k in coded
        ])
        found = (
            panel.select(F.explode(entries).alias("e"))
            .select("e.original_name", "e.base", "e.kind", F.explode("e.levels").alias("level"))
            .distinct()
        )
        levels = found.unionByName(plain)
    suffix = F.when(F.col("level").isNull(), NULL_LEVEL).otherwise(sanitize_token(F.col("level")))
    name = (
        F.when(F.col("kind") == "numeric", F.concat(F.lit("x_"), F.col("base")))
        .when(F.col("kind") == "multilabel", F.concat(F.lit("m_"), F.col("base"), F.lit("_"), suffix))
        .otherwise(F.concat(F.lit("x_"), F.col("base"), F.lit("_"), suffix))
    )
    # Different raw values may share a token: later ones get a running number, set off by a mark no token holds.
    same = Window.partitionBy("column_base").orderBy(F.col("level").asc_nulls_last())
    return (
        levels.withColumn("column_base", name)
        .withColumn("dup", F.row_number().over(same))
        .select("original_name", "base", "kind", "level",
                F.when(F.col("dup") == 1, F.col("column_base"))
                .otherwise(F.concat_ws("__", "column_base", "dup")).alias("column_name"))
    )


def collect_levels(levels: DataFrame, source_order, max_columns=None):
    """The level table as column plans, for a frame that names every level in its schema.

    A caller who expects a narrow frame may set ``max_columns``; more is an error then.
    """
    rows = (levels if max_columns is None else levels.limit(max_columns + 1)).collect()
    if max_columns is not None and len(rows) > max_columns:
        raise ValueError(
            f"more than {max_columns} encoded columns; use encode_long for this panel"
        )
    rank = {c: i for i, c in enumerate(source_order)}
    return sorted(rows, key=lambda r: (rank[r["original_name"]], r["level"] is None,
                                       r["level"] or "", r["column_name"]))


def wide_columns(plan, fill_missing=False):
    """Projections of the training schema over any rows holding the source columns.

    ``fill_missing`` is the forecasting rule: a missing number becomes 0.  A category
    never seen in training hits no column; a NULL hits the null column.
    """
    out = []
    for r in plan:
        cell = _text(F.col(f"`{r['original_name']}`"))
        if r["kind"] == "numeric":
            value = to_number(cell)
            value = F.coalesce(value, F.lit(0.0)) if fill_missing else value
        elif r["kind"] == "multilabel":
            value = F.array_contains(multilabel_parse(cell), r["level"]).cast("double")
        elif r["level"] is None:
            value = cell.isNull().cast("double")
        else:
            value = F.coalesce(cell == r["level"], F.lit(False)).cast("double")
        out.append(value.alias(r["column_name"]))
    return out


def missing_day_vector(plan):
    """Encoding of a day without any exogenous row."""
    return [1.0 if r["kind"] == "categorical" and r["level"] is None else 0.0 for r in plan]


def encode_long(panel: DataFrame, kinds, levels: DataFrame, columns=None) -> DataFrame:
    """Non-zero encoded cells as ``(series_id, ds, column_name, value)`` for any level count.

    Levels join by value; whether they are broadcast is left to their measured size.  Cells
    without a level, numbers and missing categories, take their column's one name by
    projection: as join keys they would all meet in one task.
    """
    columns = list(columns or exog_columns(panel))
    known = [k for k in _known_kinds(kinds) if k["original_name"] in columns]
    no_level = F.array(F.lit(None).cast("string"))
    plain = {r["original_name"]: r["column_name"]  # one row a source column
             for r in levels.filter("level IS NULL").select("original_name", "column_name").collect()}
    entries = []
    for k in known:
        if k["kind"] == "numeric":
            number = to_number(_text(F.col(f"`{k['original_name']}`")))
            hit = F.when(number.isNotNull() & (number != 0), no_level)
        else:
            number = F.lit(1.0)
            hit = F.array_distinct(_level_array(k))
            hit = F.coalesce(hit, no_level) if k["kind"] == "categorical" else hit
        entries.append(F.struct(F.lit(k["original_name"]).alias("original_name"),
                                F.lit(plain.get(k["original_name"])).cast("string").alias("plain"),
                                number.alias("value"), hit.alias("hit")))
    hits = (
        panel.select(KEY, DAY, F.explode(F.array(*entries)).alias("e"))
        .select(KEY, DAY, "e.original_name", "e.plain", "e.value", F.explode("e.hit").alias("level"))
    )
    named = hits.filter("level IS NOT NULL").alias("h").join(
        levels.alias("l"),
        (F.col("h.original_name") == F.col("l.original_name")) & (F.col("h.level") == F.col("l.level")),
    ).select(KEY, DAY, "l.column_name", "h.value")
    return named.union(hits.filter("level IS NULL AND plain IS NOT NULL").select(KEY, DAY, "plain", "value"))


def future_exog(future: DataFrame, plan) -> DataFrame:
    return future.select(KEY, DAY, *wide_columns(plan, fill_missing=True))


def _number(cell, fill):
    number = to_number(_text(cell))
    return F.coalesce(number, F.lit(0.0)) if fill else number


def _names_in(cell, kind, place):
    """Names of the levels in a cell: the column's place, and ``=value`` unless a category is missing."""
    cell = _text(cell)
    of = lambda v: F.concat(place, F.lit("="), v)
    labels = F.coalesce(F.transform(multilabel_parse(cell), of), F.array().cast("array<string>"))
    single = F.array(F.when(cell.isNull(), place).otherwise(of(cell)))
    return F.when(kind == "multilabel", labels).when(kind == "categorical", single).otherwise(
        F.array().cast("array<string>"))


class Columns:
    """Exogenous columns of a panel: each has one kind, the same for all series."""

    def __init__(self, kinds=()):
        self.kinds = [(F.col(f"`{k['original_name']}`"), k["kind"]) for k in kinds]
        self.has_numbers = any(k == "numeric" for _, k in self.kinds)
        self.has_levels = any(k != "numeric" for _, k in self.kinds)

    def numbers(self, fill_missing=False) -> Column:
        """The numeric columns as one array; ``fill_missing`` is the forecasting rule, 0 for a missing one."""
        return F.array(*[_number(c, fill_missing) for c, k in self.kinds if k == "numeric"]).cast("array<double>")

    def levels(self) -> Column:
        """Names of all levels in a row, each once."""
        parts = [_names_in(c, F.lit(k), F.lit(str(i))) for i, (c, k) in enumerate(self.kinds) if k != "numeric"]
        return F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<string>")

    def missing_day(self) -> Column:
        """Levels of a day without any exogenous row."""
        return F.array(*[F.lit(str(i)) for i, (_, k) in enumerate(self.kinds) if k == "categorical"]).cast("array<string>")


class Cells:
    """Exogenous cells in an array column whose width and kinds differ by series (``with_cell_kinds``)."""

    has_numbers = has_levels = True

    def numbers(self, fill_missing=False) -> Column:
        numeric = F.filter(F.arrays_zip(F.col(KINDS).alias("k"), F.col(CELLS).alias("c")), lambda z: z["k"] == "numeric")
        return F.transform(numeric, lambda z: _number(z["c"], fill_missing))

    def levels(self) -> Column:
        parts = F.transform(F.col(KINDS), lambda k, i: _names_in(F.get(F.col(CELLS), i), k, i.cast("string")))
        return F.array_distinct(F.flatten(parts))

    def missing_day(self) -> Column:
        places = F.transform(F.col(KINDS), lambda k, i: F.when(k == "categorical", i.cast("string")))
        return F.filter(places, lambda p: p.isNotNull())


CELLS, KINDS = "cells", "cell_kinds"


def with_cell_kinds(panel: DataFrame, train: DataFrame) -> DataFrame:
    """``panel`` with the kinds of its series' cells, judged on the rows of ``train`` as ``exog_kinds`` judges columns."""
    place = Window.partitionBy(KEY, "pos").orderBy(DAY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = train.select(KEY, DAY, F.posexplode(CELLS).alias("pos", "cell")).withColumn("seen", F.count("cell").over(place))
    sampled = F.col("cell").isNotNull() & (F.col("seen") <= LABEL_SAMPLE)
    lists = F.max(sampled & (F.size(multilabel_parse(F.col("cell"))) >= 2))
    kind = F.when(F.count(to_number(F.col("cell"))) >= F.count(F.lit(1)) * NUMERIC_SHARE, "numeric").when(
        lists, "multilabel").otherwise("categorical")
    per = cells.groupBy(KEY, "pos").agg(kind.alias("kind"))
    kinds = per.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "kind")))["kind"].alias(KINDS))
    return panel.join(kinds, KEY, "left").withColumn(KINDS, F.coalesce(KINDS, F.array().cast("array<string>")))


def known_kinds(panel: DataFrame, columns=None):
    """Kinds of the exogenous columns as rows, in column order: one per source column."""
    columns = list(columns or exog_columns(panel))
    if not columns:
        return []
    found = {r["original_name"]: r for r in exog_kinds(panel, columns).collect()}
    return [found[c] for c in columns]


def level_column_name(kinds) -> Column:
    """The source column of a level name, from its number: a map with one entry per source column."""
    names = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (str(i), k["original_name"])])
    return names[F.substring_index("level_name", "=", 1)]


def level_value() -> Column:
    """The cell's value in a level name; null for a missing category."""
    return F.when(F.instr("level_name", "=") > 0, F.expr("substring(level_name, instr(level_name, '=') + 1)"))
