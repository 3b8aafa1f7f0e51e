"""Ranked lexical search with the roles turned round: items are indexed, documents stream past.

The terms of the items form an inverted index that is broadcast; a document needs no index, no
shuffle and no second look.  One pass cuts every text into terms and writes, per document, its
length and the counts of the terms that some item has.  Corpus statistics are sums over that narrow
table.  A second pass sends each document's counts through the index, adds up its scores and keeps
the best ``k`` documents of every item; a task hands on ``k`` rows an item at most, and these lists
are merged by rank.  Items whose index would exceed ``POSTINGS`` entries are searched in blocks,
each with an index of its own.
"""

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from dayloom.llm.common import stage, table

BEST = 10
#: Entries of an inverted index that are broadcast at once; an item with more terms is a block of its own.
POSTINGS = 1 << 18
#: Scores that a task holds at once.
SCORES = 1 << 21
#: Digits, lower-cased Latin letters and the bytes of everything beyond ASCII; the rest separates.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def terms(text: bytes) -> list:
    return text.translate(TERM_BYTES).split()


@dataclass
class Index:
    """Term numbers, and for each term the items that have it: ``items[first[t]:first[t + 1]]``."""

    number: dict
    first: np.ndarray
    items: np.ndarray
    keys: np.ndarray

    @classmethod
    def of(cls, rows):
        number, own, item = {}, [], []
        for k, row in enumerate(rows):
            own += [number.setdefault(t, len(number)) for t in row.terms]
            item += [k] * len(row.terms)
        own, item = np.array(own, np.int64), np.array(item, np.int64)
        order = np.argsort(own, kind="stable")
        first = np.r_[0, np.cumsum(np.bincount(own, minlength=len(number)))].astype(np.int64)
        return cls(number, first, item[order], np.array([r.key for r in rows], np.int64))


def _item_terms(batches):
    for batch in batches:
        own = [sorted(set(terms(t or b""))) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.binary()))], ["row", "terms"])


def _count_hits(index):
    def run(batches):
        for batch in batches:
            number, n, first, own, tf = index.value.number, [], [0], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = terms(text or b"")
                n.append(len(found))
                for term, count in Counter(found).items():
                    t = number.get(term)
                    if t is not None:
                        own.append(t)
                        tf.append(count)
                first.append(len(own))
            first = pa.array(first, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(first, pa.array(own, pa.int32())),
                                              pa.ListArray.from_arrays(first, pa.array(tf, pa.int64()))], ["doc_id", "n", "terms", "tf"])

    return run


def _best(item, score, doc, missing, k):
    """The ``k`` first entries of each item by score, then doc_id, a missing id last."""
    order = np.lexsort((doc, missing, -score, item))
    item, score, doc, missing = item[order], score[order], doc[order], missing[order]
    start = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
    nth = np.arange(len(item)) - np.repeat(start, np.diff(np.r_[start, len(item)]))
    keep = nth < k
    return item[keep], score[keep], doc[keep], missing[keep]


def scores_of(index: Index, weight, docs: int, own, tf, row, length):
    """Scores (items x docs) of a block: ``own``, ``tf`` and ``row`` list its terms, ``length`` is m by document."""
    worth = weight[own] * ((1_000_000_000 * tf) // (1000 * tf + 8 * length[row]))
    many = index.first[own + 1] - index.first[own]
    at = np.repeat(index.first[own] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
    out = np.zeros(len(index.keys) * docs, np.int64)
    np.add.at(out, index.items[at] * docs + np.repeat(row, many), np.repeat(worth, many))
    return out.reshape(len(index.keys), docs)


def _rank(index, stats, k):
    """Stream documents through the index; each task yields its best ``k`` documents of every item."""
    def run(batches):
        idx, (weight, n_docs, n_terms) = index.value, stats.value
        held = tuple(np.zeros(0, np.int64) for _ in range(4))
        floor = np.ones(len(idx.keys), np.int64)
        width = max(1, SCORES // max(1, len(idx.keys)))
        for batch in batches:
            for at in range(0, batch.num_rows, width):
                part = batch.slice(at, width)
                docs, size = part.num_rows, part.column(1).to_numpy()
                length = 10 + (90 * size * n_docs) // max(1, n_terms)
                many = np.diff(part.column(2).offsets.to_numpy()).astype(np.int64)
                row = np.repeat(np.arange(docs), many)
                own, tf = part.column(2).flatten().to_numpy().astype(np.int64), part.column(3).flatten().to_numpy()
                score = scores_of(idx, weight, docs, own, tf, row, length)
                if docs > k:
                    floor = np.maximum(floor, np.partition(score, docs - k, axis=1)[:, docs - k])
                item, doc = np.nonzero(score >= floor[:, None])
                ids = part.column(0)
                known = (ids.fill_null(0).to_numpy()[doc], ids.is_null().to_numpy(zero_copy_only=False)[doc].astype(np.int64))
                held = _best(*(np.r_[a, b] for a, b in zip(held, (item, score[item, doc], *known))), k)
                full = np.bincount(held[0], minlength=len(floor)) == k
                last = np.zeros(len(floor), np.int64)
                last[held[0]] = held[1]
                floor[full] = np.maximum(floor, last)[full]
        item, score, doc, missing = held
        yield pa.RecordBatch.from_arrays([pa.array(idx.keys[item]), pa.array(doc, mask=missing.astype(bool)), pa.array(score)],
                                         ["key", "doc_id", "score"])

    return run


def _blocks(items: DataFrame, limit: int):
    """Items with a block number such that a block has ``limit`` postings at most, or one item."""
    total = items.agg(F.sum(F.size("terms")).alias("n")).first().n or 0
    count = max(1, math.ceil(total / limit))
    while True:
        numbered = items.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(count)))
        if count == 1 or numbered.groupBy("block").agg(F.sum(F.size("terms")).alias("n"), F.count("*").alias("items")).where(
                (F.col("n") > limit) & (F.col("items") > 1)).isEmpty():
            return numbered, count
        count *= 2


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST, limit: int = POSTINGS) -> DataFrame:
    """(row, rank, doc_id, score): for each item the ``k`` documents with the highest score above 0.

    In: ``docs`` with ``doc_id`` (long) and ``text``, ``items`` with ``text``; further columns are
    ignored in ``docs``, and ``row`` is a struct of all of ``items`` but the text.  Terms, weights and
    scores are those of ``op13_search``; statistics are over all documents.  Ranks count from 1; equal
    scores go by ascending doc_id, a null id last.  Every row is a document and every row of
    ``items`` an item of its own, so repeated rows are ranked, and answered, one by one.  A null or
    blank text has no terms: such a document is no document of the statistics, such an item has no rows.
    Empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = items.select(F.struct(*[items[c] for c in items.columns if c != "text"]).alias("row"), "text")
    kind = rows.schema["row"].dataType
    items = stage(rows.mapInArrow(_item_terms, f"row {kind.simpleString()}, terms array<binary>").withColumn(
        "key", F.monotonically_increasing_id()), "items")
    numbered, blocks = _blocks(items, limit)
    out = []
    for block in range(blocks):
        index = Index.of(numbered.where(F.col("block") == block).select("key", "terms").collect())
        shared = spark.sparkContext.broadcast(index)
        hits = stage(docs.select("doc_id", "text").mapInArrow(
            _count_hits(shared), "doc_id long, n long, terms array<int>, tf array<long>"), "hits")
        total = hits.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        held = np.zeros(len(index.number), np.int64)
        for r in hits.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            held[r.t] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * int(df) + 1))) for df in held], np.int64)
        stats = spark.sparkContext.broadcast((weight, total.docs, total.terms))
        out.append(hits.mapInArrow(_rank(shared, stats, k), "key long, doc_id long, score long"))
    best = out[0]
    for more in out[1:]:
        best = best.union(more)
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = best.withColumn("rank", nth).where(F.col("rank") <= k)
    return items.select("key", "row").join(best, "key").select("row", "rank", "doc_id", "score")


def op13_search(spark, sf_dir):
    """The ten best documents of every benchmark item.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))) over N documents with a term; a document of
    n terms among L has m = 10 + 90 n N div L; the score sums weight * (10^9 tf div (1000 tf + 8 m)).
    """
    found = ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("row.item_id", "rank", "doc_id", "score")


_TERMS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")

OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
q AS (SELECT key, item_id, unnest(list_distinct(terms)) AS term FROM (SELECT row_number() OVER () AS key, item_id, {_TERMS} AS terms FROM benchmark)),
s AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS words FROM d WHERE len(terms) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) SEMI JOIN q USING (term) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS weight
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
m AS (SELECT r, doc_id, 10 + (90 * len(terms) * docs) // words AS m FROM d, s WHERE len(terms) > 0),
x AS (SELECT key, item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY key, item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {BEST}
"""
