"""Contiguous shards of near equal bytes: the smallest capacity that still fits.

Equal texts form an atomic group.  Groups are ordered by digest; their sizes are summed up in
digest blocks, so a group's place in the order is its block's base plus a sum inside the block.
The smallest feasible capacity is found by bisection with greedy checks.  The driver holds only
some group ends: those of the blocks, and, where a cut may fall between known ends, those of
finer parts of that gap.  A check takes a gap once as if a cut could fall anywhere in it and once
as if it could not; where both bisections agree, the capacity is exact.
"""

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from dayloom.llm.common import stage, table

BLOCKS = 4096
#: Parts of a large group that are numbered apart.
PARTS = 4096
FINER = 256
#: Gaps refined in one job.
GAPS = 256


def grouped_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, group, block, part); a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.md5(text).alias("group"))
    return rows.withColumns({
        "block": F.conv(F.substring("group", 1, 3), 16, 10).cast("int"),
        "part": F.pmod(F.xxhash64("doc_id", "group"), F.lit(PARTS)).cast("int")})


class GroupEnds:
    """Known ends of groups in the summed order; more are fetched where a question needs them."""

    def __init__(self, placed: DataFrame, blocks):
        self.placed, self.spark = placed, placed.sparkSession
        self.ends = np.cumsum([b.bytes for b in blocks])
        #: gap i lies before ends[i]; a single one holds one group, so no end is hidden in it
        self.single = np.array([b.groups == 1 for b in blocks])
        self.block_ends, self.block_ids = self.ends.copy(), [b.block for b in blocks]
        self.total = int(self.ends[-1])

    def gap(self, x):
        """Index of the gap that holds x, which lies before the total; x on an end is in the next gap."""
        return int(np.searchsorted(self.ends, x, side="right"))

    def start(self, gap):
        return int(self.ends[gap - 1]) if gap else 0

    def refine(self, gaps):
        rows = [(int(g), self.start(g), int(self.ends[g]), self.block_ids[int(np.searchsorted(self.block_ends, self.ends[g]))])
                for g in gaps]
        wanted = F.broadcast(self.spark.createDataFrame(rows, "gap int, lo long, hi long, block int"))  # GAPS rows at most
        found = (self.placed.join(wanted, "block").where("end > lo AND end <= hi")
                 .groupBy("gap", F.expr(f"((end - lo - 1) * {FINER}) div (hi - lo)").alias("part"))
                 .agg(F.min("end").alias("least"), F.max("end").alias("most"), F.count("*").alias("n")).collect())
        more = [(r.least, True) for r in found] + [(r.most, r.n == 2) for r in found if r.n > 1]
        keep = np.ones(len(self.ends), bool)
        keep[list(gaps)] = False
        ends = np.r_[self.ends[keep], [end for end, _ in more]].astype(np.int64)
        single = np.r_[self.single[keep], [one for _, one in more]].astype(bool)
        order = np.argsort(ends)
        self.ends, self.single = ends[order], single[order]

    def floor(self, x):
        """Last group end at x or before, 0 if none."""
        while x < self.total and not self.single[g := self.gap(x)] and self.start(g) < x:
            self.refine([g])
        return self.start(self.gap(x)) if x < self.total else self.total

    def ceil(self, x):
        low = self.floor(x)
        return low if low >= x else int(self.ends[self.gap(x)])

    def fill(self, capacity, shards, anywhere):
        """(fits, gaps): whether greedy filling fits, and the open gaps it met.

        ``anywhere``: an end hidden in a gap is taken to be wherever it is needed, else nowhere.
        """
        at, met = 0, set()
        for _ in range(shards):
            if at + capacity >= self.total:
                return True, met
            g = self.gap(at + capacity)
            step = self.start(g)
            if not self.single[g] and step < at + capacity:
                met.add(g)
                step = at + capacity if anywhere else step
            if step <= at:
                break
            at = step
        return False, met

    def least_capacity(self, shards):
        def bisect(anywhere, low, high):
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if self.fill(mid, shards, anywhere)[0] else (mid + 1, high)
            return low

        while True:
            low = bisect(True, -(-self.total // shards), self.total)
            high = bisect(False, low, self.total)
            if low == high:
                return low
            # at ``low`` the two kinds of filling part ways, so an open gap is met
            met = [self.fill(c, shards, kind)[1] for c in (low, high, (low + high) // 2) for kind in (False, True)]
            self.refine(list(dict.fromkeys(g for gaps in met for g in sorted(gaps)))[:GAPS])


def cuts_of(ends: GroupEnds, shards: int):
    """(capacity, cuts): as even as the least capacity allows, so that no shard starves beside a large group."""
    capacity = ends.least_capacity(shards)
    must = [ends.total]  # from each of these ends on, the rest still fits
    for _ in range(shards - 1):
        must.insert(0, ends.ceil(max(0, must[0] - capacity)))
    cuts, at = [], 0
    for j in range(shards - 1):
        even = at + (ends.total - at) // (shards - j)
        at = ends.floor(min(at + capacity, max(even, must[j])))
        cuts.append(at)
    return capacity, cuts


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard and slot of every row under the least largest shard; equal texts stay together.

    In: ``doc_id``, ``text``; further columns are ignored.  Out, one row per input row: ``doc_id,
    size`` (UTF-8 bytes plus 1), ``text_crc32, shard, slot`` (gapless from 0 in each shard).
    A null text counts as empty.  Repeated rows and null ids get slots of their own; which of two
    equal rows comes first does not show.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = stage(grouped_rows(docs), "rows")
    parts = stage(rows.groupBy("block", "group", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "parts")
    groups = parts.groupBy("block", "group").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = groups.groupBy("block").agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).orderBy("block").collect()
    out = "doc_id", "size", "text_crc32", "shard", "slot"
    if not blocks:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    bases = zip([b.block for b in blocks], np.cumsum([0, *(b.n for b in blocks[:-1])]).tolist(),
                np.cumsum([0, *(b.bytes for b in blocks[:-1])]).tolist())
    base = F.broadcast(spark.createDataFrame(list(bases), "block int, rows_before long, bytes_before long"))  # BLOCKS rows at most
    inside = Window.partitionBy("block").orderBy("group").rowsBetween(Window.unboundedPreceding, 0)
    placed = stage(groups.join(base, "block").select(
        "block", "group", (F.col("rows_before") + F.sum("n").over(inside) - F.col("n")).alias("first"),
        (F.col("bytes_before") + F.sum("bytes").over(inside)).alias("end"), "bytes"), "placed")
    _, cuts = cuts_of(GroupEnds(placed, blocks), shards)
    start = F.col("end") - F.col("bytes")
    shard = sum(((start >= c).cast("int") for c in cuts), F.lit(0))
    placed = placed.select("block", "group", "first", shard.alias("shard"))
    zero = {r.shard: r.zero for r in placed.groupBy("shard").agg(F.min("first").alias("zero")).collect()}
    zero = F.element_at(F.create_map(*[F.lit(x) for pair in zero.items() for x in pair]), F.col("shard"))
    earlier = Window.partitionBy("block", "group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part = parts.withColumn("skip", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(placed, ["block", "group"]).select(
        "group", "part", "shard", (F.col("first") - zero + F.col("skip")).alias("slot0"))
    own = Window.partitionBy("group", "part").orderBy("doc_id", "size", "text_crc32")
    return rows.join(part, ["group", "part"]).withColumn(
        "slot", F.col("slot0") + F.row_number().over(own) - 1).select(*out)


def op8_sharding(spark, sf_dir):
    return shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
