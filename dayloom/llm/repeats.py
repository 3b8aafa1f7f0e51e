"""Suffix-array dedup: remove every byte that a repeated 400-byte string covers.

Equal strings must meet in one task without moving every suffix.  Each 400-byte string is filed
under its anchor, the least of its 96-byte hashes, so equal strings have equal anchors; the
starts that share one anchor form a run.  Only the runs of anchors seen twice go on.  Runs with
equal bytes are settled by their digest.  What differs under one anchor is fetched, once for each
distinct run, and searched in ``bwt`` for strings that repeat.  An anchor with more than ``limit``
distinct runs is filed anew under the digests of its single strings, which are counted; so no
group is unbounded and nothing is left out.

The same search runs over words: each word is then one symbol, a 64-bit hash, and strings are
passages of a number of words, however many bytes they have.
"""

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from dayloom.llm.bwt import repeated_starts
from dayloom.llm.common import partitions, stage, table
from dayloom.session import staging

LENGTH = 400
GRAM = 96
LIMIT = 2048
#: A passage has as many words; its anchor is a hash of so many.
PASSAGE_WORDS = 50
PASSAGE_GRAM = 8
#: Bytes hashed or transformed at once inside a task.
CHUNK = 1 << 18
_PRIME = 0x9E3779B97F4A7C15
_MIX = 0xBF58476D1CE4E5B9
_LOW = np.uint64(0xFFFFFFFF)
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_IS_GAP = np.isin(np.arange(256), [32, *range(9, 14)])
#: Bytes of a word's code.
CODE = 8

ANCHORS = "key long, c1 long, c2 long, doc_id long, digest long, s1 int, s2 int"
PIECES = "key long, other long, doc_id long, digest long, s int, n long, piece binary, owner long"
RUNS = "doc_id long, digest long, s1 int, s2 int"


def _powers(n):
    base, back = np.full(n, _PRIME, np.uint64), np.full(n, pow(_PRIME, -1, 2**64), np.uint64)
    base[0] = back[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(back)


def anchor_runs(data: np.ndarray, owner: np.ndarray, tables, length=LENGTH, gram=GRAM):
    """(s1, s2, key) of each run of starts whose strings lie in one piece and share an anchor."""
    n, width = len(data), length - gram + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    power, back = tables
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)]
    h = (sums[gram:] - sums[:-gram]) * back[:n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(_MIX)
    h ^= h >> np.uint64(29)
    value = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equals
    blocks = np.full(-(-len(h) // width) * width, ~np.uint64(0))
    blocks[:len(h)] = value
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    anchor = (np.minimum(behind[:starts], ahead[width - 1:width - 1 + starts]) & _LOW).astype(np.int64)
    start = np.flatnonzero(owner[:starts] == owner[length - 1:])
    if not len(start):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    anchor = anchor[start]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    return start[first], start[last], h[anchor[first]]


def _slices(texts, length, unit=1):
    """(row, offset, bytes): texts in slices of CHUNK bytes of starts at most, gathered to about CHUNK bytes; offsets in symbols of ``unit`` bytes."""
    held, size, step = [], 0, max(CHUNK // unit, 1)
    for row, text in enumerate(texts):
        for at in range(0, max(len(text) // unit - length + 1, 0), step):
            piece = text[at * unit:(at + step + length - 1) * unit]
            if held and size + len(piece) > CHUNK + length * unit:
                yield held
                held, size = [], 0
            held.append((row, at, piece))
            size += len(piece)
    if held:
        yield held


def _bytes(column):
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def word_ranges(data: np.ndarray):
    """Where each word starts and ends."""
    edges = np.flatnonzero(np.diff(_IS_GAP[data], prepend=True, append=True))
    return edges[::2], edges[1::2]


def word_codes(data: np.ndarray):
    """Where each word starts, and its code: a polynomial of its bytes, mixed."""
    start, end = word_ranges(data)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    size = end - start
    power, _ = _powers(int(size.max()))
    first = np.cumsum(size) - size
    nth = np.arange(int(size.sum())) - np.repeat(first, size)
    h = np.add.reduceat((data[~_IS_GAP[data]].astype(np.uint64) + np.uint64(1)) * power[nth], first)
    h ^= h >> np.uint64(31)
    h *= np.uint64(_MIX)
    return start, h ^ (h >> np.uint64(29))


def _coded(texts):
    """The codes of a few texts' words, worked out for about CHUNK bytes at once."""
    joined, at, starts, codes = b" ".join(texts), 0, [], []
    while at < len(joined):
        gap = _GAP.search(joined, at + CHUNK)
        to = gap.start() if gap else len(joined)
        start, code = word_codes(np.frombuffer(joined, np.uint8, to - at, at))
        starts.append(start + at)
        codes.append(code)
        at = to
    if not starts:
        return [b""] * len(texts)
    ends = CODE * np.searchsorted(np.concatenate(starts), np.cumsum([len(t) + 1 for t in texts]))
    codes = np.concatenate(codes).astype("<u8").tobytes()
    return [codes[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def _symbols(column, words):
    """The bytes of each text, or with ``words`` the codes of its words, CODE bytes each."""
    texts = _bytes(column)
    if not words:
        yield from texts
        return
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > CHUNK:
            yield from _coded(held)
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield from _coded(held)


def _find_anchors(length, gram, columns=ANCHORS, words=False):
    unit, kind = (CODE, "<u8") if words else (1, np.uint8)

    def run(batches):
        tables = _powers(CHUNK + 2 * length)
        schema = pa.schema([(c.split()[0], pa.int64() if "long" in c else pa.int32()) for c in columns.split(", ")])
        for batch in batches:
            ids, digests = batch.column(0), batch.column(1)
            for held in _slices(_symbols(batch.column(2), words), length, unit):
                joined = b"".join(p for _, _, p in held)
                sizes = np.array([len(p) // unit for _, _, p in held])
                owner = np.repeat(np.arange(len(held)), sizes)
                s1, s2, key = anchor_runs(np.frombuffer(joined, kind), owner, tables, length, gram)
                if not len(s1):
                    continue
                content = np.frombuffer(b"".join(xxhash.xxh3_128_digest(joined[a:b]) for a, b in zip(
                    (s1 * unit).tolist(), ((s2 + length) * unit).tolist())), "<i8").reshape(-1, 2)
                of = owner[s1]
                row = pa.array(np.array([r for r, _, _ in held])[of])
                owners = ()
                if batch.num_columns > 3:  # equal strings of two scopes do not meet
                    scopes, owners = batch.column(3).to_pylist(), (batch.column(4).take(row),)
                    scope = np.array([xxhash.xxh64_intdigest((scopes[r] or "").encode()) for r, _, _ in held], np.uint64)[of]
                    key, content = key ^ scope, content ^ np.c_[scope, np.zeros_like(scope)].view(np.int64)
                shift = (np.array([at for _, at, _ in held]) - (np.cumsum(sizes) - sizes))[of]
                yield pa.RecordBatch.from_arrays([
                    pa.array(key.view(np.int64)), pa.array(content[:, 0]), pa.array(content[:, 1]), ids.take(row), digests.take(row),
                    pa.array((s1 + shift).astype(np.int32)), pa.array((s2 + shift).astype(np.int32)), *owners], schema=schema)

    return run


def _cut_pieces(length, scoped, words=False):
    """Symbols of the runs asked for; for runs of a hot anchor one digest a start instead.

    ``scoped``: a piece stands for all runs of its content, so it is named by that and counted from its own start.
    """
    unit = CODE if words else 1

    def run(batches):
        schema = pa.schema([("key", pa.int64()), ("other", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()),
                            ("s", pa.int32()), ("n", pa.int64()), ("piece", pa.binary()), ("owner", pa.int64())])
        for batch in batches:
            rows = []
            for doc, digest, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                _symbols(batch.column(2), words), batch.column(3).to_pylist()):
                for q in asked:
                    name = (q["c1"], q["c2"]) if scoped else (doc, digest)
                    base = q["s1"] if scoped else 0
                    if q["hot"]:
                        starts = range(q["s1"], q["s2"] + 1)
                        both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[s * unit:(s + length) * unit]) for s in starts), "<i8").reshape(-1, 2)
                        rows += zip((both[:, 0] ^ q["key"]).tolist(), both[:, 1].tolist(), repeat(name[0]), repeat(name[1]),
                                    range(q["s1"] - base, q["s2"] + 1 - base), repeat(q["n"]), repeat(None), repeat(q["owner"]))
                    else:
                        piece = text[q["s1"] * unit:(q["s2"] + length) * unit]
                        rows.append((q["key"], None, *name, q["s1"] - base, q["n"], piece, q["owner"]))
                    if len(rows) >= 1 << 14:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _search_pieces(length, scoped, words=False):
    """Repeated starts in pieces that come sorted by anchor; whole anchors are put together up to CHUNK.

    ``scoped``: anchors stay apart, and a string counts if two owners have it; a run seen twice has several, so it is one of its own.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("s1", pa.int32()), ("s2", pa.int32())])
    unit = CODE if words else 1

    def search(rows):
        names = {}
        owners = [names.setdefault(r[6] if r[4] == 1 else (i,), len(names)) for i, r in enumerate(rows)] if scoped else None
        found = repeated_starts([r[5] for r in rows], length, owners, words)
        ends = np.cumsum([len(r[5]) // unit for r in rows])
        at = np.flatnonzero(found)
        of = np.searchsorted(ends, at, side="right")
        keep = np.array([r[4] for r in rows])[of] == 1  # runs seen twice are settled already
        at, of = at[keep], of[keep]
        if not len(at):
            return None
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])])
        last = np.r_[new[1:], len(at)] - 1
        of, shift = of[new], np.array([r[3] for r in rows])[of[new]] - np.r_[0, ends][of[new]]
        pick = lambda k: [rows[i][k] for i in of.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(pick(1), pa.int64()), pa.array(pick(2), pa.int64()),
                                           pa.array((at[new] + shift).astype(np.int32)), pa.array((at[last] + shift).astype(np.int32))], schema=schema)

    def run(batches):
        held, size, cut = [], 0, 0  # cut: rows before the last anchor
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if held and row[0] != held[-1][0]:
                    if scoped or size >= CHUNK or len(held) > 60000:
                        if (out := search(held)) is not None:
                            yield out
                        held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held and (out := search(held)) is not None:
            yield out

    return run


def repeated_runs(docs: DataFrame, length=LENGTH, gram=GRAM, limit=LIMIT, words=False) -> DataFrame:
    """(doc_id, digest, s1, s2): runs of starts, strings of ``length`` bytes from which occur twice or more.

    In: (doc_id, digest, text), and with a fourth column ``scope`` a string counts if it occurs in
    two documents of one scope.  With a fifth, ``owner`` (long), documents of one owner count as one.
    With ``words`` length, gram and starts are counted in words instead.
    """
    scoped = len(docs.columns) > 3
    plain = docs.select("doc_id", "digest", "text")
    if scoped:
        owner = F.col("owner") if "owner" in docs.columns else F.xxhash64("doc_id", "digest")
        docs = docs.select("doc_id", "digest", "text", "scope", owner.alias("owner"))
    several_owners = F.when(F.min("owner") < F.max("owner"), 2).otherwise(1).cast("long")
    number = several_owners if scoped else F.count("*")
    columns = f"{ANCHORS}, owner long" if scoped else ANCHORS
    anchors = stage(docs.mapInArrow(_find_anchors(length, gram, columns, words), columns), "anchors")
    seen = stage(anchors.groupBy("key").count().where("count > 1").select("key"), "seen")
    shared = stage(anchors.join(seen, "key", "left_semi"), "shared")
    one = F.min(F.struct("doc_id", "digest", "s1", "s2", *(["owner"] if scoped else [])))
    distinct = stage(shared.groupBy("key", "c1", "c2").agg(number.alias("n"), one.alias("one")), "distinct")
    again = distinct.where("n > 1").select("key", "c1", "c2")
    whole = shared.join(again, ["key", "c1", "c2"], "left_semi").select("doc_id", "digest", "s1", "s2")

    several = stage(distinct.groupBy("key").agg(F.count("*").alias("runs")).where("runs > 1").select(
        "key", (F.col("runs") > limit).alias("hot")), "several")
    own = ["c1", "c2", F.col("one.owner").alias("owner")] if scoped else [F.lit(0).cast("long").alias("owner")]
    asked = distinct.join(several, "key").select(
        F.col("one.doc_id").alias("i"), F.col("one.digest").alias("d"),
        F.struct("key", "hot", "n", F.col("one.s1").alias("s1"), F.col("one.s2").alias("s2"), *own).alias("q")).groupBy("i", "d").agg(
        F.collect_list("q").alias("asked"))
    pieces = stage(plain.join(asked, plain.doc_id.eqNullSafe(asked.i) & (plain.digest == asked.d)).select(
        "doc_id", "digest", "text", "asked").mapInArrow(_cut_pieces(length, scoped, words), PIECES), "pieces")
    found = pieces.where("piece IS NOT NULL").select("key", "doc_id", "digest", "s", "n", "piece", "owner").repartition(
        partitions(docs.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_search_pieces(length, scoped, words), RUNS)
    if not several.where("hot").isEmpty():
        single = pieces.where("piece IS NULL")
        # a run seen twice is shared already, so what it has is shared by all
        number = F.greatest(F.max("n"), several_owners) if scoped else F.count("*")
        twice = stage(single.groupBy("key", "other").agg(number.alias("m")).where("m > 1").select("key", "other"), "twice")
        found = found.union(single.join(twice, ["key", "other"], "left_semi").where("n = 1").select(
            "doc_id", "digest", "s", F.col("s").alias("e")))
    if scoped:  # what a run shares holds wherever its content stands
        found = found.toDF("c1", "c2", "a", "b")
        found = shared.select("c1", "c2", "doc_id", "digest", "s1").join(found, ["c1", "c2"]).select(
            "doc_id", "digest", F.col("s1") + F.col("a"), F.col("s1") + F.col("b"))
    return whole.union(found)


def _pairs(column):
    """(s1, s2) of all runs of each row."""
    flat = column.flatten()
    s1, s2 = (flat.field(k).to_numpy().tolist() for k in ("s1", "s2"))
    to = np.cumsum(column.value_lengths().fill_null(0).to_numpy()).tolist()
    return [list(zip(s1[a:b], s2[a:b])) for a, b in zip([0, *to], to)]


def _merged(runs, length):
    """Ranges that the strings of the runs cover, touching ones as one."""
    spans = []
    for s, e in sorted(runs):
        e += length
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(e, spans[-1][1])
        else:
            spans.append([s, e])
    return spans


def _left(text, spans):
    edges = [0, *(x for span in spans for x in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _remove(length, keep_bytes, keep_text, min_words, enough, passage_words):
    def long_enough(text, span):
        return span[1] - span[0] >= enough or len(text[span[0]:span[1]].split()) >= min_words

    def passages(text, runs):
        if not runs:
            return []
        start, end = word_ranges(np.frombuffer(text, np.uint8))
        return [[int(start[s]), int(end[e - 1])] for s, e in _merged(runs, passage_words)]

    def listed(spans):
        return [{"start": a, "end": b} for a, b in spans]

    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), ranges, pa.binary(), pa.string(), ranges, pa.string())

    def run(batches):
        for batch in batches:
            out = []
            for text, runs, in_words in zip(_bytes(batch.column(1)), _pairs(batch.column(2)), _pairs(batch.column(3))):
                spans = _merged(runs, length)
                if min_words:
                    spans = [span for span in spans if long_enough(text, span)]
                left = _left(text, spans)
                row = (len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), listed(spans))
                row += (left if keep_bytes else None, left.decode(errors="ignore") if keep_text else None)
                if passage_words:
                    spans = passages(text, in_words)
                    row += (listed(spans), _left(text, spans).decode())
                else:
                    row += (None, None)
                out.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))],
                                             ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "kept_text", "passages", "passage_free_text"])

    return run


def without_repeats(docs: DataFrame, length=LENGTH, gram=GRAM, limit=LIMIT, keep_bytes=True, keep_text=True, min_words=0, enough=LENGTH,
                    passage_words=0, passage_gram=PASSAGE_GRAM) -> DataFrame:
    """Each document with what repeats removed: (row, n_bytes, n_removed, n_spans, kept_sha256, spans, kept, kept_text, passages, passage_free_text).

    In: ``doc_id``, ``text`` and any further columns; ``row`` is a struct of all but the text, so no
    name can clash.  Every byte covered by a string of ``length`` bytes that also starts elsewhere,
    in the same or another document, goes; strings are judged on the input.  With ``min_words`` a
    removed range must have as many words, or ``enough`` bytes.  ``spans`` has the
    removed byte ranges, ``kept`` the remaining bytes and ``kept_text`` their whole characters (null
    without ``keep_bytes``, ``keep_text``).

    With ``passage_words`` passages are looked for too: every word in so many consecutive words that
    also start elsewhere, however few bytes they have.  ``passages`` has their byte ranges, first to
    last word, ``passage_free_text`` the whole text without them (both null otherwise).

    A null text counts as empty.  Repeated rows are documents of their own, so each copy goes; null ids are
    kept apart by their text.  An empty table gives an empty table.
    """
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    with staging(docs.sparkSession) as outlive:
        runs = stage(repeated_runs(texts, length, gram, limit).withColumn("words", F.lit(False)), "runs", outlive)
    if passage_words:
        with staging(docs.sparkSession) as outlive:
            passages = repeated_runs(texts, passage_words, passage_gram, limit, words=True)
            runs = runs.union(stage(passages.withColumn("words", F.lit(True)), "passages", outlive))
    run = F.struct("s1", "s2")
    runs = runs.groupBy("doc_id", "digest").agg(
        F.collect_set(F.when(~F.col("words"), run)).alias("runs"), F.collect_set(F.when(F.col("words"), run)).alias("in_words"))
    runs = runs.withColumnsRenamed({"doc_id": "i", "digest": "d"})
    rest = F.struct(*[docs[c] for c in docs.columns if c != "text"])
    own = docs.select(rest.alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    joined = own.join(runs, own.doc_id.eqNullSafe(runs.i) & (own.digest == runs.d), "left").select("row", "text", "runs", "in_words")
    schema = (f"row {joined.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
              "spans array<struct<start: long, end: long>>, kept binary, kept_text string, "
              "passages array<struct<start: long, end: long>>, passage_free_text string")
    return joined.mapInArrow(_remove(length, keep_bytes, keep_text, min_words, enough, passage_words), schema)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with what remains as text and ``n_chars`` counted anew; a character cut in two goes."""
    rows = without_repeats(docs, **options)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return rows.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def op7_repeats(spark, sf_dir):
    """Bytes of repeated 400-byte strings, and beside them the text without passages of 50 words that repeat."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs, keep_bytes=False, passage_words=PASSAGE_WORDS).select(
        "row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("text"),
        F.size("passages").cast("long").alias("n_passages"), "passage_free_text")
