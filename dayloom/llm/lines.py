"""Line dedup: normalised lines are hashed, grouped globally, and kept where they rank first.

Every later line goes, however short.  A caller may ask with ``min_words`` that only runs of consecutive
lines, each seen earlier, with as many words in all go.  Offsets refer to the original text.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from dayloom.llm.common import id_key, stage, table

#: Least words of a run of later lines that is removed: every later line goes.
MIN_WORDS = 1


def _normal(line: str) -> list[str]:
    return line.lower().translate(_SPACES).split()


_SPACES = {c: " " for c in range(9, 14)}


def _strings(column):
    return [x or "" for x in column.to_pylist()]


def _units(batches):
    """(u1, u2, doc_id, digest, at) of each line with a word; u1 and u2 are the normalised line's digest."""
    for batch in batches:
        texts = _strings(batch.column(2))
        digests, row, at = [], [], []
        for k, text in enumerate(texts):
            for i, line in enumerate(text.split("\n")):
                if words := _normal(line):
                    digests.append(xxhash.xxh3_128_digest(" ".join(words)))
                    row.append(k)
                    at.append(i)
        if row:
            u = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1]), batch.column(0).take(take), batch.column(1).take(take),
                                              pa.array(at, pa.int32())], ["u1", "u2", "doc_id", "digest", "at"])


def repeated_spans(text: str, seen: set, min_words: int):
    """(spans, lines, removed): code point ranges of runs of seen lines; a run's line ends go with it."""
    spans, start, at, n, removed = [], 0, [], 0, 0
    lines = text.split("\n")

    def close():
        nonlocal removed
        if n >= min_words:
            spans.append({"start": at[0][0], "end": at[-1][1]})
            removed += len(at)

    for i, line in enumerate(lines):
        words = len(_normal(line))
        if words and i in seen:
            at.append((start, min(start + len(line) + 1, len(text))))
            n += words
        elif words:
            close()
            at, n = [], 0
        start += len(line) + 1
    close()
    return spans, sum(1 for x in lines if _normal(x)), removed


def _cut(min_words, keep_text):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            out = []
            for text, later, first in zip(_strings(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                spans, n, removed = repeated_spans(text, set(later or ()) if first else range(len(text) + 1), min_words)
                edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(text)]
                left = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((n, removed, spans, hashlib.sha256(left.encode()).hexdigest(), left if keep_text else None))
            kinds = (pa.int64(), pa.int64(), span, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))],
                                             ["row", "n_lines", "n_removed", "spans", "kept_sha256", "kept_text"])

    return run


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, keep_text=True) -> DataFrame:
    """(row, n_lines, n_removed, spans, kept_sha256, kept_text): each document without lines that stand earlier.

    In: ``doc_id``, ``text`` and any further columns; ``row`` is a struct of all but the text.  Lines
    are split at \\n, lower-cased and their white space evened out; lines without a word neither
    count nor end a run.  Rank is doc_id (nulls last), then the text's digest, then the line's
    place, so a line repeated inside one document is later too.  Of equal rows one ranks first
    and the others are repeats throughout.  ``spans`` are removed code point ranges of the
    original; a null text counts as empty.  An empty table gives an empty table.
    """
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    units = stage(docs.select("doc_id", digest.alias("digest"), "text").mapInArrow(
        _units, "u1 long, u2 long, doc_id long, digest long, at int"), "units")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "at")
    first = units.groupBy("u1", "u2").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = units.join(first, ["u1", "u2"]).where(~rank.eqNullSafe(F.col("first")))
    later = stage(later.groupBy(*id_key(), "digest").agg(F.collect_set("at").alias("later")), "later")
    rest = F.struct(*[docs[c] for c in docs.columns if c != "text"])
    own = docs.select(rest.alias("row"), *id_key(), digest.alias("digest"), "text")
    nth = F.row_number().over(Window.partitionBy("key", "unknown", "digest").orderBy("digest"))
    joined = own.withColumn("first", nth == 1).join(later, ["key", "unknown", "digest"], "left").select("row", "text", "later", "first")
    return joined.mapInArrow(_cut(min_words, keep_text), f"row {joined.schema['row'].dataType.simpleString()}, n_lines long, n_removed long, "
                             "spans array<struct<start: long, end: long>>, kept_sha256 string, kept_text string")


def op10_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = without_repeated_lines(docs)
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.select("row.doc_id", "n_lines", "n_removed", text.alias("removed_spans"), "kept_sha256", "kept_text")


OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
w AS (SELECT *, regexp_extract_all(lower(line), '[^\\x20\\x09-\\x0D]+') AS word,
  coalesce(sum(length(line) + 1) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
u AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY r, i) > 1 AS seen FROM w WHERE len(word) > 0),
g AS (SELECT *, sum(CASE WHEN seen THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM u),
s AS (SELECT r, run, min(i) AS a, max(i) AS b, min(start) AS x, max(start + length(line) + 1) AS y, count(*) AS n
  FROM g WHERE seen GROUP BY r, run HAVING sum(len(word)) >= {MIN_WORDS}),
e AS (SELECT r, sum(n)::BIGINT AS n_removed, string_agg(x::BIGINT || '-' || least(y::BIGINT, length(text)), ',' ORDER BY x) AS removed_spans
  FROM s JOIN d USING (r) GROUP BY r),
k AS (SELECT w.r, w.i, w.line, max(w.i) OVER (PARTITION BY w.r) AS last, s.r IS NULL AS stays FROM w LEFT JOIN s ON w.r = s.r AND w.i BETWEEN s.a AND s.b),
t AS (SELECT r, string_agg(line || CASE WHEN i < last THEN chr(10) ELSE '' END, '' ORDER BY i) FILTER (WHERE stays) AS left_text FROM k GROUP BY r),
n AS (SELECT r, count(*) AS n_lines FROM u GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed_spans, '') AS removed_spans,
  sha256(coalesce(left_text, '')) AS kept_sha256, coalesce(left_text, '') AS kept_text
FROM d LEFT JOIN e USING (r) LEFT JOIN t USING (r) LEFT JOIN n USING (r)
"""
