"""Periodic runs against a scan of every lag."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest

from dayloom.llm import periods

SCHEMA = "doc_id long, text string, row string, runs string, strongest string"


def slow_runs(ids, least=periods.LEAST):
    """Every stretch with smallest period q, by comparing all words at every lag."""
    found, n = {}, len(ids)
    for q in range(1, n // 3 + 1):
        a = 0
        while a + q < n:
            b = a
            while b + q < n and ids[b] == ids[b + q]:
                b += 1
            if b + q - a >= max(least, 3 * q):
                found.setdefault((a, b + q), q)
            a = b + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def slow_row(doc_id, words):
    runs = slow_runs(words)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{a},{n},{q}\n" for a, n, q in runs)),
            digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def samples(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        parts = []
        for _ in range(rng.integers(1, 5)):
            letters = rng.integers(1, 6) if rng.random() < 0.6 else 10**6
            block = rng.integers(0, letters, rng.integers(1, [8, 30, 90, 200][rng.integers(4)]))
            parts.append(np.tile(block, rng.integers(1, 7))[:rng.integers(1, 700)])
        yield np.concatenate(parts)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("short", [periods.SHORT, 2])
def test_equals_scan_of_every_lag(seed, short):
    texts = list(samples(seed)) + [np.zeros(0, np.int64), np.zeros(50, np.int64), np.zeros(23, np.int64)]
    assert periods.find_runs(texts, short=short) == [slow_runs(t.tolist()) for t in texts]
    assert any(r[2] > 50 for own in periods.find_runs(texts) for r in own)


def test_every_period_is_found():
    """Exactly three periods, the least that counts, at every length up to the largest."""
    rng = np.random.default_rng(5)
    for q in [*range(8, 200), 1000, 4321]:
        block = rng.permutation(q) + 10
        text = np.concatenate([[1, 2, 3], np.tile(block, 3), [4, 5]])
        assert periods.find_runs([text]) == [[(3, 3 * q, q)]], q
        assert periods.find_runs([text[:-3]]) == [[]], q


def test_scales_leave_no_period_out():
    at = periods.SHORT
    for lo, w, window in periods.scales(10**7):
        assert lo == at and window >= 1 and w + window - 1 <= 2 * (lo + 1)
        at = w
    assert 3 * at >= 10**7


def test_rows(spark):
    words = [f"w{i}" for i in range(40)]
    long = [f"x{i % 997}" for i in range(120_000)]
    texts = [None, "", " \n\t", "one", " ".join(words), "é " * 30, "a\x0bb\x1cc " * 12, "lead " + " ".join(words * 3) + " Z z z",
             " ".join(words[:9] * 4 + words[:20] * 5), " ".join(long), "  x" * 24, " ".join("x y".split() * 20 + "y x".split() * 20)]
    rows = [(i, t, "r", "s", None) for i, t in enumerate(texts)]
    rows += [(8, texts[8], "r", "s", None), (None, texts[5], None, None, None)]
    out = periods.periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows) and out[0].row.asDict().keys() == {"doc_id", "row", "runs", "strongest"}
    got = {(r.row.doc_id, r.n_words, tuple(map(tuple, r.runs))): r for r in out}
    for i, text, *_ in rows:
        split = (text or "").encode().split()
        runs = [(0, 120_000, 997)] if i == 9 else slow_runs(split)
        r = got[i, len(split), tuple(runs)]
        assert (r.strongest is None) == (not runs)
        assert hashlib.sha256(r.collapsed_text.encode()).hexdigest() == r.collapsed_sha256
    assert got[9, 120_000, ((0, 120_000, 997),)].collapsed_text == " ".join(long[:997])
    assert periods.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def planted(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return [w.decode() for w in words]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = [slow_row(r.doc_id, planted(r.doc_id, r.text)) for r in docs]
    got = [tuple(r) for r in periods.op11_periods(spark, sf).collect()]
    assert sorted(got) == sorted(want, key=lambda r: r[0]) or sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(r[1] > 0 for r in got) > 5


def test_repeats_of_odd_rows(spark):
    rows = [(i, t) for i in range(60) for t in (None, "", "a b c d e f g")] + [(None, "a b")]
    out = periods.with_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), " ".join((r.text or "").split())) for r in out) == sorted((str(i), " ".join(planted(i, t))) for i, t in rows)
