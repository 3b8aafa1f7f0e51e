"""One document of each near-duplicate group, where a group is linked by SimHash and by word shingles.

SimHash links texts within 3 of 64 bits (``simhash``).  Texts with 0.8 of their five-word shingles in
common differ in up to a dozen bits, which no exact search over 64 bits can reach at a large scale,
so the shingle hashes also give a one-permutation MinHash of 256 bins in 32 bands.  Texts that share a
band are candidates, and a pair counts if its exact similarity is high enough.  Each is first paired with
the first text of its band, then in every band with two texts drawn anew, so a family seldom needs a pair of
all its members.  Whatever two texts of a band are in different groups after that are compared too, all of
them, in tiles.  A pair at 0.8 shares no band in 3 cases of 1,000; recall is given in the README.

Equal texts are one node.  What moves is a key and a digest per band, and the shingle hashes of
texts that share a band with another.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from dayloom.llm import simhash
from dayloom.llm.common import id_key, parts, partitions, stage, stage_narrow
from dayloom.llm.graph import components

SHINGLE, LIKENESS = 5, 0.8
BINS, BANDS = 256, 32
#: Texts on a side of a tile; a band with more is dealt over several.
TILE = 128
_ODD = np.array([2 * xxhash.xxh64_intdigest(bytes([k]), 1) % 2**64 | 1 for k in range(BINS // BANDS)], np.uint64)
#: For each bin the bins that lend it a value, in order; an empty bin takes the first that has one.
_LENDERS = np.array([np.random.default_rng(k).permutation(BINS) for k in range(BINS)])


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 of all word shingles of a lower-cased text; of all its words if they are fewer; none without words."""
    words = text.translate(simhash.LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = (words[k:k + shingle] for k in range(max(1, len(words) - shingle + 1)))
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(r), simhash.SEED) for r in runs], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band: equal where all bins of the band have equal minima."""
    least = np.full(BINS, ~np.uint64(0))
    np.minimum.at(least, (hashes >> np.uint64(56)).astype(np.intp), hashes & np.uint64(2**56 - 1))
    some = least != ~np.uint64(0)
    if not some.all():
        lender = _LENDERS[np.arange(BINS), some[_LENDERS].argmax(axis=1)]
        least = np.where(some, least, least[lender])
    return (least.reshape(BANDS, -1) * _ODD).sum(axis=1, dtype=np.uint64) * _ODD[0] ^ np.arange(BANDS, dtype=np.uint64)


def _prints(batches):
    for batch in parts(batches):
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        digest = np.array([xxhash.xxh64_intdigest(t, simhash.SEED) for t in texts], np.uint64).view(np.int64)
        fp = np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
        bands = []
        for t in texts:
            hashes = shingle_hashes(t)
            bands.append(band_keys(hashes).view(np.int64) if len(hashes) else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest), pa.array(fp), pa.array(bands, pa.list_(pa.int64()))],
                                         ["doc_id", "digest", "fp", "bands"])


def _sets(batches):
    for batch in parts(batches):
        rows = [(shingle_hashes(t) >> np.uint64(32)).astype(np.uint32).view(np.int32) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["digest", "shingles"])


def shared_bands(prints: DataFrame) -> DataFrame:
    """(digest, band, key) of the bands that different texts have in common."""
    bands = prints.select("digest", F.posexplode("bands").alias("band", "key")).distinct()
    several = bands.groupBy("band", "key").agg(F.min("digest").alias("v"), F.max("digest").alias("w")).where("v <> w").select("band", "key")
    return stage_narrow(bands.join(several, ["band", "key"], "left_semi"), "bands")


def pairs_with(shared: DataFrame, *hubs) -> DataFrame:
    """(u, v): every text with the texts that ``hubs`` name among those of a band; ``links_between`` has the other pairs."""
    named = shared.groupBy("band", "key").agg(F.array_distinct(F.array(*hubs)).alias("hubs")).select("band", "key", F.explode("hubs").alias("v"))
    return shared.join(named, ["band", "key"]).where("digest <> v").select(F.col("digest").alias("u"), "v").distinct()


def shingle_sets(asked: DataFrame, docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(digest, shingles) of the texts whose ``digest`` is asked for."""
    asked = stage_narrow(asked.distinct(), "asked")
    owner = prints.join(asked, "digest", "left_semi").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("id"))
    owner = owner.select("digest", *id_key("id.doc_id"))
    texts = docs.select(_digest().alias("digest"), *id_key(), "text").join(owner, ["digest", "key", "unknown"], "left_semi")
    sets = texts.select("digest", "text").mapInArrow(_sets, "digest long, shingles array<int>")
    return stage(sets.groupBy("digest").agg(F.first("shingles").alias("shingles")), "shingles")  # an owner may be repeated


def alike(pairs: DataFrame, docs: DataFrame, prints: DataFrame, likeness=LIKENESS) -> DataFrame:
    """The pairs of digests whose texts have ``likeness`` of their shingles in common, counted exactly."""
    sets = shingle_sets(pairs.select(F.col("u").alias("digest")).union(pairs.select("v")), docs, prints)
    both = pairs.join(sets.select(F.col("digest").alias("u"), F.col("shingles").alias("a")), "u").join(
        sets.select(F.col("digest").alias("v"), F.col("shingles").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common >= F.lit(likeness) * (F.size("a") + F.size("b") - common)).select("u", "v")


def _compare_tiles(likeness):
    """(u, v) of alike texts in rows that come sorted by tile, those that ask first; one for any two groups that meet in a tile."""
    def run(batches):
        tile, asks, index, met, found = None, [], None, set(), []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            rest, digests, roots = (batch.column(i).to_pylist() for i in (4, 5, 6))
            ends, values = batch.column(7).offsets.to_numpy(), batch.column(7).values.to_numpy()
            for k, key in enumerate(keys):
                own = values[ends[k]:ends[k + 1]]
                if key != tile:
                    tile, asks, index, met = key, [], None, set()
                if not rest[k]:
                    asks.append((digests[k], roots[k], np.sort(own)))
                    continue
                if index is None:
                    sizes = np.array([len(x) for _, _, x in asks])
                    every = np.concatenate([x for _, _, x in asks])
                    order = np.argsort(every, kind="stable")
                    index = every[order], np.repeat(np.arange(len(asks)), sizes)[order]
                first, last = (np.searchsorted(index[0], own, side) for side in ("left", "right"))
                n = last - first
                at = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                common = np.bincount(index[1][at], minlength=len(asks))
                for i in np.flatnonzero(common >= likeness * (sizes + len(own) - common)).tolist():
                    u, root, _ = asks[i]
                    if root != roots[k] and (root, roots[k]) not in met:
                        met.add((root, roots[k]))
                        found.append((u, digests[k]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["u", "v"])
                found = []

    return run


def links_between(shared: DataFrame, root: DataFrame, docs: DataFrame, prints: DataFrame, likeness=LIKENESS, tile: int = TILE) -> DataFrame:
    """(u, v): alike texts of a band that ``root`` has in different groups; of several between two groups in a tile one.

    Of two such texts one at least is outside the band's largest group.  Those texts ask, in blocks of
    about ``tile``, all texts of the band, in blocks too; every two blocks meet in a tile of their own.
    """
    named = shared.join(root.toDF("digest", "root"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    sizes = named.groupBy("band", "key", "root").count().groupBy("band", "key").agg(
        F.sum("count").alias("n"), F.max(F.struct("count", "root")).alias("most")).where("n > most.count")
    blocks = [F.ceil(n / F.lit(tile)).cast("long") for n in (F.col("n") - F.col("most.count"), F.col("n"))]
    sizes = sizes.select("band", "key", F.col("most.root").alias("most"), blocks[0].alias("p"), blocks[1].alias("q"))
    apart = stage_narrow(named.join(sizes, ["band", "key"]), "apart")
    asks = apart.where("root <> most").select(
        "band", "key", F.expr("pmod(digest, p)").alias("i"), F.explode(F.expr("sequence(0, q - 1)")).alias("j"), F.lit(False).alias("rest"), "digest", "root")
    rest = apart.select(
        "band", "key", F.explode(F.expr("sequence(0, p - 1)")).alias("i"), F.expr("pmod(digest, q)").alias("j"), F.lit(True).alias("rest"), "digest", "root")
    tiles = asks.union(rest).join(shingle_sets(apart.select("digest"), docs, prints), "digest").select(*asks.columns, "shingles")
    placed = ["band", "key", "i", "j"]
    tiles = tiles.repartition(partitions(docs.sparkSession), *placed).sortWithinPartitions(*placed, "rest")
    return tiles.mapInArrow(_compare_tiles(likeness), "u long, v long").distinct()


def joined(root: DataFrame, links: DataFrame) -> DataFrame:
    """``root`` (u, v) after further links between texts of different groups."""
    ends = links.join(root.toDF("u", "a"), "u", "left").join(root.toDF("v", "b"), "v", "left").select(
        F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v"))
    top = components(stage_narrow(ends, "links"), stage_narrow)
    return stage_narrow(root.join(top.toDF("v", "w"), "v", "left").select("u", F.coalesce("w", "v").alias("v")).union(top), "roots")


def _digest():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def groups(docs: DataFrame, reach: int = 3, likeness=LIKENESS) -> DataFrame:
    """(doc_id, digest, root): each document with a digest that names its group of near duplicates.

    In: ``doc_id`` (long), ``text``; further columns are ignored.  A null or blank text has fingerprint
    zero and no shingles, and links like any other.  Null ids and repeated rows take part.  An empty
    table gives an empty table.
    """
    prints = stage(docs.select("doc_id", "text").mapInArrow(_prints, "doc_id long, digest long, fp long, bands array<long>"), "prints")
    nodes = stage_narrow(prints.groupBy("fp").agg(F.min("digest").alias("node")), "nodes")
    near = simhash.links(nodes.select("fp"), reach)
    named = near.join(nodes.select(F.col("fp").alias("u"), F.col("node").alias("a")), "u").join(
        nodes.select(F.col("fp").alias("v"), F.col("node").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    same = prints.select("digest", "fp").distinct().join(nodes, "fp").where("digest <> node").select(F.col("digest").alias("u"), F.col("node").alias("v"))
    shared = shared_bands(prints)
    first = stage_narrow(pairs_with(shared, F.min("digest")), "candidates")
    root = stage_narrow(components(stage_narrow(
        named.union(same).union(alike(first, docs, prints, likeness)), "links"), stage_narrow), "roots")
    # what is not linked yet is held against other texts of its bands, a different one in each
    own = F.xxhash64("digest", "band")
    more = pairs_with(shared, F.min_by("digest", own), F.max_by("digest", own))
    apart = more.join(root.toDF("u", "a"), "u", "left").join(root.toDF("v", "b"), "v", "left").where("coalesce(a, u) <> coalesce(b, v)")
    root = joined(root, alike(stage_narrow(apart.select("u", "v"), "candidates"), docs, prints, likeness))
    # and then against all that are in other groups still
    root = joined(root, links_between(shared, root, docs, prints, likeness))
    return prints.join(root.toDF("digest", "root"), "digest", "left").select("doc_id", "digest", F.coalesce("root", "digest").alias("root"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id's, null ids last; one of several equal rows stays."""
    return simhash.first_rows(docs, groups(docs, **options))
