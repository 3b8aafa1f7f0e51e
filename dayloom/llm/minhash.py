"""One-permutation MinHash fingerprints with optimal densification and packed low bits.

Each shingle is hashed once; the top bits name its bin, the bin keeps its least hash.  An empty
bin draws other bins by a hash of (bin, attempt) until it meets a filled one, so each empty bin
draws on its own; after ``DRAWS`` attempts it takes the filled bin that comes first in the bin's
hashed order of all filled ones.  Only the low 8 bits of each bin are kept.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from dayloom.llm.common import id_key, let, partitions, stage, table, words

SHINGLE = 5
BINS_LOG2 = 8
BINS = 1 << BINS_LOG2
BITS = 8
DRAWS = 8


def _bin(h: Column) -> Column:
    return (F.shiftright(h, 64 - BINS_LOG2) + BINS // 2).cast("int")


def _shingles(word: Column) -> Column:
    """One hash a shingle; one for the whole sequence if it is shorter; none without words."""
    def of(h):
        n = F.size(h)
        return F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(
            *[F.get(h, i + k) for k in range(SHINGLE)]))).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(word, lambda w: F.xxhash64(w)), of)


def _least_by_bin(hashes: Column) -> Column:
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))
    return let(F.sort_array(hashes), first)


def _with_gaps(least: Column) -> Column:
    """One entry a bin, null where the bin is empty."""
    nothing = F.lit(None).cast("bigint")
    runs = F.transform(least, lambda x, i: F.concat(
        F.array_repeat(nothing, _bin(x) - F.coalesce(_bin(F.get(least, i - 1)), F.lit(-1)) - 1), F.array(x)))
    return F.concat(F.flatten(runs), F.array_repeat(nothing, BINS - 1 - _bin(F.element_at(least, -1))))


def _densified(least: Column) -> Column:
    def fill(bins):
        drawn = lambda i, a: F.get(bins, F.pmod(F.xxhash64(i, F.lit(a)), F.lit(BINS)).cast("int"))
        last = lambda i: F.array_min(F.transform(least, lambda m: F.struct(
            F.xxhash64(i, _bin(m)).alias("o"), m.alias("m"))))["m"]
        return F.transform(bins, lambda v, i: F.coalesce(v, *[drawn(i, a) for a in range(DRAWS)], last(i)))

    return let(_with_gaps(least), fill)


def sketch(text: Column) -> Column:
    """Low bits of every bin as tinyints; empty for a text without words."""
    low = lambda v: (F.pmod(v, F.lit(1 << BITS)) - (1 << BITS - 1)).cast("tinyint")
    packed = lambda m: F.when(F.size(m) > 0, F.transform(_densified(m), low)).otherwise(F.array().cast("array<tinyint>"))
    return let(_least_by_bin(_shingles(words(text))), packed)


def packed_hex(low: Column) -> Column:
    digits = F.array(*[F.lit(f"{b:02x}") for b in range(1 << BITS)])
    return F.array_join(F.transform(low, lambda b: F.get(digits, b.cast("int") + (1 << BITS - 1))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of shingles in common, from 0 to 1, freed of the chance that low bits agree.

    Two texts without words are alike, one with and one without are not.
    """
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(
        F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance)))


def successors(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_chars, next_id, next_digest, copies): which text follows in ascending doc_id.

    Rows of one id follow each other by digest; of ``m`` equal rows, ``m - 1`` are followed by an
    equal one.  After the last comes the first.  Ids are sorted in ranges; only the first of each
    range meets the others.
    """
    keys = docs.groupBy("doc_id", "digest", "n_chars").agg(F.count("*").alias("m"))
    n = partitions(docs.sparkSession)
    keys = stage(keys.repartitionByRange(n, "doc_id", "digest").withColumn("range", F.spark_partition_id()), "keys")
    me = F.struct("doc_id", "digest")
    heads = keys.groupBy("range").agg(F.min(me).alias("head"))  # one row a range
    following = F.coalesce(F.lead("head").over(Window.orderBy("range")), F.first("head").over(Window.orderBy("range")))
    heads = heads.withColumn("head", following)
    inside = Window.partitionBy("range").orderBy("doc_id", "digest")
    after = keys.withColumn("after", F.lead(me).over(inside)).join(F.broadcast(heads), "range")
    after = after.withColumn("after", F.coalesce("after", "head"))
    step = F.array(F.struct(F.col("after").alias("after"), F.lit(1).cast("long").alias("copies")),
                   F.struct(me.alias("after"), (F.col("m") - 1).alias("copies")))
    return after.withColumn("s", F.explode(F.filter(step, lambda s: s["copies"] > 0))).select(
        "doc_id", "digest", "n_chars", F.col("s.after.doc_id").alias("next_id"), F.col("s.after.digest").alias("next_digest"), "s.copies")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they and the next are.

    In: ``doc_id``, ``text``; further columns are ignored.  Out, one row per input row: ``doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.  The edited
    text has its last floor(n_chars / 2) code points replaced by the first as many of the next
    document.  A null text counts as empty; a text without words has the fingerprint ``''``.
    Null ids come first in the order; for ties and repeated rows see ``successors``.  An empty
    table gives an empty table.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("digest"))
    order = stage(successors(docs.select("doc_id", "digest", F.length("text").cast("long").alias("n_chars"))), "successors")
    once = Window.partitionBy("key", "unknown", "digest").orderBy("digest")
    texts = docs.select(*id_key(), "digest", "text").withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    asked = order.select(*id_key("next_id"), F.col("next_digest").alias("digest"), "next_id", "next_digest", "n_chars", "copies",
                         *id_key("doc_id", ("i", "z")), F.col("digest").alias("d"), "doc_id")
    heads = texts.join(asked, ["key", "unknown", "digest"]).select(
        F.col("i").alias("key"), F.col("z").alias("unknown"), F.col("d").alias("digest"),
        "doc_id", "next_id", "next_digest", "n_chars", "copies", F.substring("text", F.lit(1), half).alias("head"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.col("head"))
    both = texts.join(heads, ["key", "unknown", "digest"]).select(
        "doc_id", "digest", "next_id", "next_digest", "n_chars", "copies", "text", edited.alias("edited"))
    prints = stage(both.select("doc_id", "digest", "next_id", "next_digest", "n_chars", "copies", F.sha2("edited", 256).alias("edited_sha256"),
                               sketch(F.col("text")).alias("own"), sketch(F.col("edited")).alias("other")), "prints")
    following = prints.groupBy("doc_id", "digest").agg(F.first("own").alias("follower")).withColumnsRenamed({"doc_id": "i", "digest": "d"})
    return prints.join(following, prints.next_id.eqNullSafe(following.i) & (prints.next_digest == following.d)).select(
        "doc_id", "n_chars", "edited_sha256", packed_hex(F.col("own")).alias("fingerprint"),
        packed_hex(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("follower")).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")


def op3_fingerprints(spark, sf_dir):
    return fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
