"""One-permutation MinHash against a plain loop, and its likeness against true Jaccard."""

import hashlib
import re
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from dayloom.llm import minhash

SCHEMA = "doc_id long, text string, digest string, copies string, own string"


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def h64(*values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v.v) if isinstance(v, Int) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


class Int:
    def __init__(self, v):
        self.v = v


def shingles(text):
    w = [h64(x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return [h64(*w[i:i + 5]) for i in range(len(w) - 4)] or ([h64(*w)] if w else [])


def slow(text):
    least = {}
    for h in shingles(text):
        b = (h >> 56) + 128
        least[b] = min(h, least.get(b, h))
    if not least:
        return ""
    out = []
    for i in range(256):
        draws = [i] + [h64(Int(i), Int(a)) % 256 for a in range(8)]
        found = next((least[d] for d in draws if d in least), None)
        if found is None:
            found = least[min(least, key=lambda b: (h64(Int(i), Int(b)), least[b]))]
        out.append(found & 255)
    return bytes(out).hex()


def rows():
    rng = np.random.default_rng(3)
    make = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    texts = [make(n) for n in (2000, 300, 40, 7, 5, 4, 1)] + [None, "", "   ", "É è\x0bü"]
    out = [(i * 3, t, "a", "b", "c") for i, t in enumerate(texts)]
    return out + [(None, "null id text", "a", "b", "c"), out[1], out[1], (3, "same id, other text", None, None, None)]


def test_equals_plain_loop(spark):
    data = rows()
    out = minhash.fingerprint_edits(spark.createDataFrame(data, SCHEMA)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))
    order = sorted(((*key(r), r[1] or "") for r in data))
    want = []
    for i, (known, doc, _, text) in enumerate(order):
        follow = order[(i + 1) % len(order)][3]
        k = len(text) // 2
        edited = text[:len(text) - k] + follow[:k]
        want.append((doc if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest(), slow(text), slow(edited)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in out]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)


def test_likeness_is_near_jaccard(spark):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 1200)]
    pairs = [(" ".join(base), " ".join(base[:n] + [f"v{x}" for x in range(1200 - n)])) for n in (1200, 1100, 800, 400, 0)]
    out = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", minhash.likeness(minhash.sketch(F.col("a")), minhash.sketch(F.col("b"))).alias("s")).collect()
    for r in out:
        a, b = set(shingles(r.a)), set(shingles(r.b))
        assert abs(r.s - len(a & b) / len(a | b)) < 0.12


def test_one_row_and_none(spark):
    assert minhash.fingerprint_edits(spark.createDataFrame([], SCHEMA)).count() == 0
    row = minhash.fingerprint_edits(spark.createDataFrame([(1, "a b c d e f", "", "", "")], SCHEMA)).collect()
    assert len(row) == 1 and row[0].near_next == 1.0
