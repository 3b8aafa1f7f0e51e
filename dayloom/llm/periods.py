"""Periodic runs of words, found by minimizers at several scales.

A run is a maximal stretch of words with smallest period q and at least ``copies`` periods.  Periods up
to ``SHORT`` are found by direct scans, one lag at a time.  Longer ones are searched by scale: the
scale of periods lo < q <= w looks at strings of w words and keeps the least hash of every window.
A run of three periods holds two such windows q words apart with equal content, so their minima are
q apart as well, and as the string is no shorter than the period the next equal one is exactly q
away.  Neighbouring equal minimizers at a distance of the scale seed an extension in both
directions that compares the words themselves, so a false seed can't make a run.

A document is searched inside one task; nothing is shuffled.  Several short texts are searched
together, apart from each other by elements that equal nothing.
"""

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dayloom.llm.common import let, table, words

LEAST = 24
COPIES = 3
#: Longest period that is scanned for directly.
SHORT = 16
#: Words searched together; a longer text is searched alone.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15

RUN = "struct<start: long, length: long, period: long>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, ~np.uint64(0))
    blocks[:len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def _lag_stretches(ids: np.ndarray, lag: int, least: int):
    """(start, end) of stretches of ``least`` words or more in which words ``lag`` apart are equal."""
    if len(ids) <= lag:
        return
    breaks = np.r_[-1, np.flatnonzero(ids[lag:] != ids[:-lag]), len(ids) - lag]
    for k in np.flatnonzero(np.diff(breaks) - 1 + lag >= least):
        yield int(breaks[k]) + 1, int(breaks[k + 1]) + lag


def _extended(ids: np.ndarray, at: int, lag: int):
    """The maximal stretch around ``at`` in which words ``lag`` apart are equal."""
    def reach(step, room):
        done, block = 0, 64
        while done < room:
            n = min(block, room - done)
            a = ids[at + done:at + done + n] if step > 0 else ids[at - done - n:at - done][::-1]
            b = ids[at + lag + done:at + lag + done + n] if step > 0 else ids[at + lag - done - n:at + lag - done][::-1]
            differ = a != b
            if differ.any():
                return done + int(differ.argmax())
            done, block = done + n, block * 4
        return done

    return at - reach(-1, at), at + lag + reach(1, len(ids) - at - lag)


def scales(longest: int, short: int = SHORT):
    """(lo, w, window): strings of w words and windows that find every period lo < q <= w of ``COPIES`` copies."""
    lo = short
    while COPIES * (lo + 1) <= longest:
        w = max(lo + 1, lo * 3 // 2)
        yield lo, w, 2 * (lo + 1) - w + 1
        lo = w


def _seeds(sums, back, lo, w, window):
    """(at, lag) of neighbouring equal minimizers whose distance belongs to the scale."""
    n = len(sums) - w
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = (sums[w:w + n] - sums[:n]) * back[:n]
    low = np.uint64((1 << n.bit_length()) - 1)
    least = _window_minima(_mixed(grams) & ~low | np.arange(n, dtype=np.uint64), window)
    place = (least & low).astype(np.int64)
    place = place[np.r_[True, place[1:] != place[:-1]]]
    place = place[np.argsort(grams[place], kind="stable")]
    lag = place[1:] - place[:-1]
    seed = (grams[place[1:]] == grams[place[:-1]]) & (lag > lo) & (lag <= w)
    return place[:-1][seed], lag[seed]


def find_runs(texts: list, least: int = LEAST, short: int = SHORT) -> list:
    """For each array of word ids, its runs as sorted (start, length, period)."""
    size = np.array([len(t) for t in texts], np.int64)
    longest, top = int(size.max(initial=0)), int(max((t.max(initial=-1) for t in texts), default=-1))
    found = [{} for _ in texts]

    def joined(members):
        """Ids of the members end to end, each followed by an element of its own."""
        parts = [x for k, m in enumerate(members) for x in (texts[m], np.array([top + 1 + k]))]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.r_[0, np.cumsum(size[members] + 1)]

    def keep(members, starts, a, b, lag):
        if b - a >= max(least, COPIES * lag):
            k = int(np.searchsorted(starts, a, "right")) - 1
            own, at = found[members[k]], (a - int(starts[k]), b - int(starts[k]))
            own[at] = min(lag, own.get(at, lag))

    members = np.flatnonzero(size >= least)
    ids, starts = joined(members)
    for lag in range(1, short + 1):
        for a, b in _lag_stretches(ids, lag, max(least, COPIES * lag)):
            keep(members, starts, a, b, lag)
    for lo, w, window in scales(longest, short):
        enough = np.flatnonzero(size >= max(least, COPIES * (lo + 1)))
        if not len(enough):
            break
        if len(enough) != len(members) or lo == short:
            members = enough
            ids, starts = joined(members)
            sums = np.r_[np.uint64(0), np.cumsum(_mixed(ids.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(ids)))]
            back = _powers(pow(_BASE, -1, 2**64), len(ids))
        at, lag = _seeds(sums, back, lo, w, window)
        covered = {}
        for x, q in sorted(zip(at.tolist(), lag.tolist())):
            if covered.get(q, -1) >= x + q:
                continue
            if ids[x] == ids[x + q]:
                a, b = _extended(ids, x, q)
                covered[q] = b
                keep(members, starts, a, b, q)
    return [sorted((a, b - a, q) for (a, b), q in own.items()) for own in found]


def without_runs(n: int, runs) -> np.ndarray:
    """Mask of the words that stay: those in no run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def _chunks(texts):
    """Consecutive texts of at most ``CHUNK`` words in all, or one longer text."""
    held, n = [], 0
    for text in texts:
        parts = (text or b"").split()
        if held and n + len(parts) > CHUNK:
            yield held
            held, n = [], 0
        held.append(parts)
        n += len(parts)
    if held:
        yield held


def _search(least, keep_text):
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kinds = (pa.int64(), pa.list_(run), run, pa.string(), pa.string(), pa.string())
    names = ["row", "n_words", "runs", "strongest", "runs_sha256", "collapsed_sha256", "collapsed_text"]

    def one(parts, runs):
        left = b" ".join(w for w, stays in zip(parts, without_runs(len(parts), runs)) if stays) if runs else b" ".join(parts)
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        as_struct = [dict(zip(("start", "length", "period"), r)) for r in runs]
        best = max(as_struct, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default=None)
        return (len(parts), as_struct, best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest(),
                left.decode() if keep_text else None)

    def task(batches):
        for batch in batches:
            done = 0
            for chunk in _chunks(x.as_py() for x in batch.column(1).cast(pa.binary())):
                known = {}
                ids = [np.array([known.setdefault(w, len(known)) for w in parts], np.int64) for parts in chunk]
                out = [one(parts, runs) for parts, runs in zip(chunk, find_runs(ids, least))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(out)), *(
                    pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names)
                done += len(out)

    return task


def periodic_runs(docs: DataFrame, least: int = LEAST, keep_text=True) -> DataFrame:
    """(row, n_words, runs, strongest, runs_sha256, collapsed_sha256, collapsed_text), one row per document.

    In: ``text`` and any further columns; ``row`` is a struct of all but the text.  Words are runs of
    anything but blank and the controls 9 to 13.  ``runs`` are (start, length, period) in words, by
    start and period, of every stretch with three periods and ``least`` words at least that no
    neighbouring word extends; a stretch is listed under its smallest period.  ``strongest`` is the one
    with the greatest length by period, ties by smallest start, then period; null without runs.
    ``collapsed_text`` joins by one space the words in no run after its first period;
    ``runs_sha256`` digests a line ``start,length,period`` per run.  A null or blank text has no
    words and the digests of the empty string.  Repeated rows stay repeated; an empty table gives an
    empty table.  A long text is searched whole; memory is some 100 bytes per word of it.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"), "text")
    return rows.mapInArrow(_search(least, keep_text), f"row {rows.schema['row'].dataType.simpleString()}, n_words long, runs array<{RUN}>, "
                           f"strongest {RUN}, runs_sha256 string, collapsed_sha256 string, collapsed_text string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with every tenth text, by the CRC-32 of its id, repeating its own words from one place on.

    With h the CRC-32, g = h div 10 and n words, word i from a = g % n on becomes word a + (i - a) % p,
    where p = 1 + (n - a) div (3 + g % 8).  Other texts, those without words and rows without an id stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(own):
        n = F.greatest(F.size(own), F.lit(1))
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(own, lambda word, i: F.when(i < a, word).otherwise(
            F.get(own, (a + (i - a) % p).cast("int")))), " ")

    return docs.withColumn("text", F.when(h % 10 == 0, let(words(F.col("text")), repeated)).otherwise(F.col("text")))


def op11_periods(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    best = F.col("strongest")
    return periodic_runs(with_repeats(docs), keep_text=False).select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")
