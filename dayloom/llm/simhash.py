"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are computed once per text.  Equal ones are one node.  A pair within 3 bits of 64
agrees on one of four 16-bit parts, so each node goes to four buckets; a bucket above ``limit``
nodes is dealt out again by four parts of its remaining bits (12, then 9, then 7), which loses no
pair and leaves buckets of at most 2^20 possible nodes.  Inside a task the nodes of a bucket are
sorted by Gray rank; upper tree nodes hold the bits that all their members share, children only
the bits shared beyond their parent, and a search adds up differing bits on its way down and
drops whole groups above the bound.  Tasks hand on a spanning star of each linked group, never
all its pairs.
"""

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from dayloom.llm.common import id_key, stage, table
from dayloom.llm.graph import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42
#: Bits taken for a bucket at each level of splitting.
WIDTHS = (16, 12, 9, 7)
LIMIT = 4096
FANOUT = 8
#: Candidate entries a search holds at once.
FRONTIER = 1 << 21


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64 majority bits over the XXH64 of all word shingles; 0 without words."""
    parts = text.translate(LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = list(accumulate(map(len, parts), lambda a, b: a + 1 + b))
    starts = [0, *(e + 1 for e in ends[:-1])]
    hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:])] or [
        xxhash.xxh64_intdigest(joined, SEED)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(most, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, digest, fp): one row per document; fp is the fingerprint, digest the text's XXH64, as signed longs."""
    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            out = [np.array([of(t) for t in texts], np.uint64).view(np.int64)
                   for of in (lambda t: xxhash.xxh64_intdigest(t, SEED), lambda t: fingerprint(t, shingle))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], ["doc_id", "digest", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, digest bigint, fp bigint")


def gray_rank(code: np.ndarray) -> np.ndarray:
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchy over fingerprints sorted by (bucket, Gray rank); built and searched level by level."""

    def __init__(self, bucket: np.ndarray, fp: np.ndarray):
        order = np.lexsort((gray_rank(fp), bucket))
        self.order, self.fp, bucket = order, fp[order], bucket[order]
        ones = np.full(len(fp), ~np.uint64(0))
        #: levels from single entries up: first child, children, shared mask, pattern, last entry
        self.levels = [(None, None, ones, self.fp, np.arange(len(fp)))]
        every, some, last = self.fp, self.fp, np.arange(len(fp))
        while True:
            new = np.r_[True, bucket[1:] != bucket[:-1]]
            start = np.flatnonzero(new)
            if len(start) == len(bucket):
                break
            inside = np.arange(len(bucket)) - np.repeat(start, np.diff(np.r_[start, len(bucket)]))
            first = np.flatnonzero(inside % FANOUT == 0)
            every, some = np.bitwise_and.reduceat(every, first), np.bitwise_or.reduceat(some, first)
            size = np.diff(np.r_[first, len(bucket)])
            last = last[first + size - 1]
            bucket = bucket[first]
            self.levels.append((first, size, ~(every ^ some), every, last))
        #: the root of each entry's bucket
        self.root = np.searchsorted(self.levels[-1][4], np.arange(len(fp)))

    def pairs(self, reach: int):
        """Blocks (i, j), i < j, of entries in one bucket that differ in ``reach`` bits at most."""
        roots = self.levels[-1][4]
        size = np.diff(np.r_[-1, roots])[self.root] if len(roots) else np.zeros(0, np.int64)
        block = np.cumsum(size) // FRONTIER
        for part in np.split(np.arange(len(self.fp)), np.flatnonzero(np.diff(block)) + 1):
            yield self._search(part[size[part] > 1], reach)

    def _search(self, query, reach):
        node, mask_above = self.root[query], None
        _, _, mask, pattern, last = self.levels[-1]
        diff = np.bitwise_count((self.fp[query] ^ pattern[node]) & mask[node]).astype(np.int64)
        for (first, size, mask, _, _), (_, _, below, pattern, last) in zip(self.levels[:0:-1], self.levels[-2::-1]):
            n = size[node]
            child = np.repeat(first[node] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            query, diff, mask_above = np.repeat(query, n), np.repeat(diff, n), np.repeat(mask[node], n)
            diff = diff + np.bitwise_count((self.fp[query] ^ pattern[child]) & below[child] & ~mask_above)
            keep = (diff <= reach) & (last[child] > query)
            query, node, diff = query[keep], child[keep], diff[keep]
        return (query, node) if len(self.levels) > 1 else (query[:0], query[:0])


def spanning_stars(bucket: np.ndarray, fp: np.ndarray, reach: int):
    """Edges (fp, fp of its group's first) that connect what the index links in each bucket."""
    index = GrayIndex(bucket, fp)
    label = np.arange(len(fp))
    for i, j in index.pairs(reach):
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label = up
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return index.fp[moved], index.fp[label[moved]]


def _search_partition(reach: int, rows: int = 1 << 16):
    def run(batches):
        held = []

        def flush(table):
            u, v = spanning_stars(table.column(0).to_numpy(), table.column(1).to_numpy().view(np.uint64), reach)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                table = pa.Table.from_batches(held)
                key = table.column(0).to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield flush(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                n -= cut
        if n:
            yield flush(pa.Table.from_batches(held))

    return run


def _parts(df: DataFrame, width: int) -> DataFrame:
    """Four bucket rows for each row (key, rest, fp): one part of ``rest`` joins the key."""
    rows = [F.struct(
        F.expr(f"(key << {width + 2}) | ({p}L << {width}) | ((rest >>> {p * width}) & {(1 << width) - 1}L)").alias("key"),
        F.expr(f"(rest & {(1 << p * width) - 1}L) | " + (
            f"((rest >>> {(p + 1) * width}) << {p * width})" if (p + 1) * width < 64 else "0L")).alias("rest"))
        for p in range(4)]
    return df.select("fp", F.explode(F.array(*rows)).alias("r")).select("r.key", "r.rest", "fp")


def links(nodes: DataFrame, reach: int = 3, limit: int = LIMIT) -> DataFrame:
    """Edges (u, v) that connect distinct fingerprints ``nodes(fp)`` as all links within ``reach`` would."""
    if reach > 3:
        raise ValueError("four parts find pairs within 3 bits only")
    level, ready = nodes.select(F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), "fp"), []
    for depth, width in enumerate(WIDTHS):
        level = _parts(level, width)
        hot = level.groupBy("key").count().where(F.col("count") > limit).select("key")
        if depth == len(WIDTHS) - 1 or hot.isEmpty():
            ready.append(level)
            break
        level, hot = stage(level, "parts"), stage(hot, "hot")
        ready.append(level.join(hot, "key", "left_anti"))
        level = level.join(hot, "key", "left_semi")
    rows = ready[0].select("key", "fp")
    for more in ready[1:]:
        rows = rows.union(more.select("key", "fp"))
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_search_partition(reach), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, shingle: int = 3, reach: int = 3, limit: int = LIMIT) -> DataFrame:
    """Component of every document under links of at most ``reach`` differing bits.

    In: ``doc_id`` (long), ``text``; further columns are ignored.  Out, one row per input row:
    ``doc_id``, ``digest``, ``fp`` (longs), ``root`` (a fingerprint that names the component) and
    ``component_id`` (smallest doc_id reachable, itself included).
    A null or blank text has fingerprint 0 and links like any other.  Rows with a null doc_id take
    part and get their component's smallest id, null where it has none.  Repeated rows stay
    repeated; ties do not arise.  An empty table gives an empty table.
    """
    prints = stage(fingerprints(docs, shingle), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    root = components(stage(links(nodes, reach, limit), "links"))
    named = nodes.join(root.withColumnRenamed("u", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("v", "fp").alias("root"))
    named = stage(named, "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = stage(named.join(least, "root").select("fp", "root", "component_id"), "component-of")
    return prints.join(of, "fp").select("doc_id", "digest", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id's, and of rows with that id the one with the least digest.

    Columns are kept, null ids come last, one of several equal rows stays.
    """
    return first_rows(docs, near_duplicates(docs, **options))


def first_rows(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of ``docs`` that come first in their group of ``groups(doc_id, digest, root)``."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest"))
    keep = stage(groups.groupBy("root").agg(first.alias("k")).select(*id_key("k.doc_id"), F.col("k.digest").alias("digest")), "kept")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *id_key(),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    kept = rows.join(keep, ["key", "unknown", "digest"])
    nth = F.row_number().over(Window.partitionBy("key", "unknown", "digest").orderBy("digest"))
    return kept.select("row", nth.alias("nth")).where("nth = 1").select("row.*")


def op5_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
