"""Exogenous-column queries."""

from pyspark.sql import functions as F

from dayloom.functions.text import multilabel_parse, sanitize_token
from dayloom.operators import exog, panel as panel_ops
from dayloom.plans.catalog.base import (
    MASKED_EXOG_SQL, exog_panel, masked_exog_panel, query, r, rnd, table, EXOG_SQL,
)
from dayloom.plans.stage import stage_panel
from dayloom.schema import DAY, KEY

_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
SOURCES = ("disc", "status", "labels")


def staged(spark, sf_dir):
    """Kinds, levels and encodings each read the panel: aggregate the raw rows once."""
    return stage_panel(masked_exog_panel(spark, sf_dir))


def _with_texts(panel):
    """Near-numeric columns: numbers on four, respectively five, days of a week."""
    day = F.weekday(DAY)
    number = F.dayofmonth(DAY).cast("string")
    return panel.withColumns({
        "near": F.when(day < 4, number).otherwise("word"),
        "mostly": F.when(day < 5, number).otherwise("word"),
    })


def _kind_sql(c, text=True):
    number = (f"COUNT(*) FILTER (regexp_full_match(CAST({c} AS VARCHAR), "
              r"'[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?'))")
    listed = (f"BOOL_OR(seen_{c} <= 200 AND (contains({c}, ',') OR contains({c}, ';') "
              f"OR contains({c}, '|')))") if text else "FALSE"
    return f"""SELECT 'x' AS side, '{c}' AS original_name, '{c}' AS base,
 CASE WHEN {number} >= 0.6 * COUNT(*) THEN 'numeric'
 WHEN {listed} THEN 'multilabel' ELSE 'categorical' END AS kind FROM counted"""


_TEXT_COLUMNS = ("status", "labels", "near", "mostly")
_KINDS = f"""WITH panel AS ({EXOG_SQL}), texts AS (SELECT *,
 CASE WHEN isodow(ds) < 5 THEN CAST(day(ds) AS VARCHAR) ELSE 'word' END AS near,
 CASE WHEN isodow(ds) < 6 THEN CAST(day(ds) AS VARCHAR) ELSE 'word' END AS mostly FROM panel),
 counted AS (SELECT *, {', '.join(
     f"COUNT({c}) OVER (PARTITION BY series_id ORDER BY ds) AS seen_{c}" for c in _TEXT_COLUMNS)}
 FROM texts)
 SELECT original_name, base, kind FROM ({_kind_sql('disc', False)} UNION ALL
 {' UNION ALL '.join(_kind_sql(c) for c in _TEXT_COLUMNS)})"""


@query("exog_kinds", _KINDS)
def exog_kinds(spark, sf_dir):
    return exog.exog_kinds(_with_texts(exog_panel(spark, sf_dir)))


@query("exog_numeric", f"""WITH panel AS ({MASKED_EXOG_SQL})
 SELECT series_id, ds, {r('disc')} AS x_disc FROM panel""")
def exog_numeric(spark, sf_dir):
    return _encoded(staged(spark, sf_dir), ("disc",))


def _plan(panel, columns):
    kinds = exog.exog_kinds(panel, columns)
    return exog.collect_levels(exog.exog_levels(panel, kinds, columns), columns)


def _encoded(panel, columns):
    cols = exog.wide_columns(_plan(panel, columns))
    out = panel.select(KEY, DAY, *cols)
    return out.select(KEY, DAY, *[rnd(c).alias(c) for c in out.columns[2:]])


def _flag(cond, name):
    return f"CAST(CASE WHEN {cond} THEN 1 ELSE 0 END AS DOUBLE) AS {name}"


_STATUS = ", ".join([_flag("status = 'F'", "x_status_F"), _flag("status = 'O'", "x_status_O"),
                     _flag("status IS NULL", "x_status_nan")])
_LABELS = ", ".join(_flag(f"list_contains(string_split(labels, ','), '{v}')", f"m_labels_{v}")
                    for v in ("F", "O"))


@query("exog_categorical", f"""WITH panel AS ({MASKED_EXOG_SQL})
 SELECT series_id, ds, {_STATUS} FROM panel""")
def exog_categorical(spark, sf_dir):
    return _encoded(staged(spark, sf_dir), ("status",))


@query("exog_multilabel", f"""WITH panel AS ({MASKED_EXOG_SQL})
 SELECT series_id, ds, {_LABELS} FROM panel""")
def exog_multilabel(spark, sf_dir):
    return _encoded(staged(spark, sf_dir), ("labels",))


@query("exog_long", f"""WITH panel AS ({MASKED_EXOG_SQL})
 SELECT series_id, ds, 'x_disc' AS column_name, {r('disc')} AS value FROM panel WHERE disc <> 0
 UNION ALL SELECT series_id, ds, 'x_status_' || COALESCE(status, 'nan'), 1.0 FROM panel
 UNION ALL SELECT series_id, ds, 'm_labels_' || UNNEST(string_split(labels, ',')), 1.0 FROM panel""")
def exog_long(spark, sf_dir):
    panel = staged(spark, sf_dir)
    kinds = exog.exog_kinds(panel, SOURCES).collect()
    levels = exog.exog_levels(panel, kinds, SOURCES)
    return exog.encode_long(panel, kinds, levels, SOURCES).withColumn("value", rnd("value"))


def _trim(x):
    return f"regexp_replace(regexp_replace({x}, '^{_SPACE}', ''), '{_SPACE}$', '')"


def _split(sep):
    return (f"list_filter(list_transform(string_split(text, '{sep}'), lambda p: {_trim('p')}), "
            "lambda p: p <> '')")


@query("multilabel_parse", f"""WITH parsed AS (SELECT doc_id,
 CASE WHEN contains(text, ',') THEN {_split(',')}
 WHEN contains(text, ';') THEN {_split(';')}
 WHEN contains(text, '|') THEN {_split('|')}
 WHEN {_trim('text')} IN ('') OR lower({_trim('text')}) = 'nan'
  THEN CAST([] AS VARCHAR[])
 ELSE [{_trim('text')}] END AS labels FROM documents)
 SELECT doc_id, CAST(len(labels) AS BIGINT) AS n_labels,
 md5(array_to_string(labels, '|')) AS labels_md5 FROM parsed""")
def multilabel_parse_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = multilabel_parse(F.col("text"))
    return docs.select("doc_id", labels.alias("labels")).select(
        "doc_id", F.size("labels").cast("bigint").alias("n_labels"),
        F.md5(F.array_join("labels", "|")).alias("labels_md5"))


@query("sanitize_token", r"""SELECT doc_id, md5(COALESCE(NULLIF(
 regexp_replace(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}]+', '_', 'g'), '^_+', ''),
 '_+$', ''), ''), 'unknown')) AS token_md5 FROM documents""")
def sanitize_token_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(sanitize_token(F.col("text"))).alias("token_md5"))


@query("future_exog", f"""WITH panel AS ({MASKED_EXOG_SQL}), seen AS (SELECT *,
 MAX(CASE WHEN y IS NOT NULL THEN ds END) OVER (PARTITION BY series_id) AS lo FROM panel),
 blanked AS (SELECT * EXCLUDE (disc, status), CASE WHEN isodow(ds) = 7 THEN NULL ELSE disc END AS disc,
  CASE WHEN isodow(ds) = 1 THEN 'new' WHEN isodow(ds) = 2 THEN NULL ELSE status END AS status
  FROM seen WHERE ds > lo)
 SELECT series_id, ds, {r('COALESCE(disc, 0.0)')} AS x_disc, {_STATUS}, {_LABELS} FROM blanked""")
def future_exog(spark, sf_dir):
    panel = staged(spark, sf_dir)
    plan = _plan(panel_ops.known_rows(panel), SOURCES)
    day = F.weekday(DAY)
    future = panel_ops.future_rows(panel).withColumns({
        "disc": F.when(day != 6, F.col("disc")),
        "status": F.when(day == 0, F.lit("new")).when(day != 1, F.col("status")),
    })
    out = exog.future_exog(future, plan)
    return out.withColumn("x_disc", rnd("x_disc"))


