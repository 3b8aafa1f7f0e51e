"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key -ln(u) / quality, u from a digest of its id, so reruns
agree.  A source's target is first met by complete epochs; the rest goes to its documents in key
order while the prefix sum of sizes stays within the budget.  The outcome of a source is one row:
its epochs and the last key taken.  Documents compare themselves with that row, so texts are
never sorted or moved.  Prefix sums run over key buckets that are summed before they meet, so a
source with a third of all rows is no single task.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from dayloom.llm.common import WORD, stage, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SYMBOLS = "#*$%&|<>"
#: Key buckets for each unit of the exponential key, and the last bucket.
BUCKETS, LAST = 1024, 65535
NO_ID = -(2**63)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Weight in [0.05, 1] that falls with the share of symbols; 1 for a null or empty text."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * symbols / F.nullif(F.length(text), F.lit(0))), F.lit(1.0))


def sized(docs: DataFrame, seed: int = 42) -> DataFrame:
    """``docs`` with ``size`` (words), ``draw`` (exponential key) and ``tie`` (id, nulls first)."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1) / float(2**48)
    return (docs.withColumn("size", n_words(F.col("text")))
            .withColumn("draw", -F.ln(u) / quality(F.col("text")))
            .withColumn("tie", F.coalesce("doc_id", F.lit(NO_ID))))


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size, target): words each source gets, by water-filling over its weight.

    Sources take ``weights`` in turn by code point, null last.  No target exceeds ``most`` times
    its source; what is above is shared again by weight.  One row for each source is all that
    meets in the window.
    """
    by_name, by_room = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("room", "rank")
    rows = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
            .withColumn("rank", F.row_number().over(by_name))
            .withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights)).cast("double"))
            .withColumn("room", F.lit(float(most)) * F.col("source_size") / F.col("weight")))
    whole = rows.withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    level = (F.lit(float(share)) * F.col("all") - F.coalesce(
        F.sum(F.lit(float(most)) * F.col("source_size")).over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ) / F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    steps = whole.withColumn("level", level)
    reached = F.min_by("level", F.when(F.col("level") <= F.col("room"), F.struct("room", "rank"))).over(Window.partitionBy())
    return steps.withColumn("reached", reached).select(
        "source", "source_size",
        F.least(F.lit(float(most)) * F.col("source_size"), F.coalesce(F.col("reached") * F.col("weight"), F.lit(float("inf")))).alias("target"))


def mixing_plan(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """One row a source: ``source_size, target, epochs`` and ``cut``, the last (draw, tie, size) taken once more.

    In: (source, size, draw, tie).  A document is taken once more if the middle of its words lies
    within the budget, so a source misses its target by half a document at most.  Rows equal in
    draw, id and size go together.
    """
    goal = stage(targets(sizes, weights, share, most)
                 .withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
                 .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    bucket = F.least(F.floor(F.col("draw") * BUCKETS), F.lit(LAST)).cast("int")
    peers = sizes.groupBy("source", bucket.alias("bucket"), "draw", "tie", "size").agg(F.sum("size").alias("total"))
    sums = peers.groupBy("source", "bucket").agg(F.sum("total").alias("held"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0)))
    near = base.join(goal, base.source.eqNullSafe(goal.source)).where(
        "base <= budget").select(base.source.alias("s"), F.col("bucket").alias("b"), "base", "budget")
    earlier = Window.partitionBy("source", "bucket").orderBy("draw", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = peers.join(near, peers.source.eqNullSafe(near.s) & (peers.bucket == near.b)).withColumn(
        "start", F.col("base") + F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    cuts = placed.where(F.col("start") + F.col("total") / 2 <= F.col("budget")).groupBy("source").agg(
        F.max(F.struct("draw", "tie", "size")).alias("cut")).withColumnRenamed("source", "s")
    return stage(goal.join(cuts, goal.source.eqNullSafe(cuts.s), "left").select(
        F.col("source").alias("plan_source"), "source_size", "target", "epochs", "cut"), "mix")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, size, draw, tie, ...) with ``source_size``, ``target`` and ``copies``."""
    more = F.coalesce(F.struct("draw", "tie", "size") <= F.col("cut"), F.lit(False)).cast("long")
    return rows.join(plan, rows.source.eqNullSafe(plan.plan_source)).select(
        *[rows[c] for c in rows.columns], "source_size", "target", (F.col("epochs") + more).alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, seed=42) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; rows not taken go.

    In: ``doc_id``, ``text``, ``source`` and any further columns, which are kept; columns named
    like the helper columns are kept too.  A null or blank text has no words.  A null source is a
    source, last in order.  Null ids share one draw.  Documents without words come once an epoch.
    An empty table gives an empty table.
    """
    narrow = stage(sized(docs.select("doc_id", "text", "source"), seed).drop("text"), "sizes")
    plan = mixing_plan(narrow, weights, share, most)
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", "text", "source")
    taken = with_copies(sized(own, seed).select("row", "source", "size", "draw", "tie"), plan)
    return taken.where("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def op9_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    narrow = stage(sized(docs).drop("text"), "sizes")
    return with_copies(narrow, mixing_plan(narrow)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    coalesce(greatest(0.05::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (length(text) - length(translate(text, '{SYMBOLS}', '')))
      / nullif(length(text), 0)), 1.0::DOUBLE) AS q,
    (('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 1)::DOUBLE / 281474976710656.0::DOUBLE AS u
  FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / q AS draw, coalesce(doc_id, -9223372036854775808) AS tie FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE C ASC NULLS LAST) AS rank FROM k GROUP BY source),
w AS (SELECT *, [3, 1, 2][(rank - 1) % 3 + 1]::DOUBLE AS weight FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size / weight AS room FROM w),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM r) - coalesce(sum(2.0::DOUBLE * source_size) OVER (
    ORDER BY room, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY room, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(
    (SELECT level FROM l WHERE level <= room ORDER BY room, rank LIMIT 1) * weight, 'inf'::DOUBLE)) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS epochs FROM t),
p AS (SELECT k.*, g.source_size, g.target, g.epochs, target - epochs * source_size AS budget,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY draw, tie, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto,
    sum(size) OVER (PARTITION BY k.source, draw, tie, size) AS peers
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (epochs + CASE WHEN upto - peers + peers / 2.0 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
