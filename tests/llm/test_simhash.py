"""SimHash against all pairs by brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from dayloom.llm import simhash

SCHEMA = "doc_id long, text string, lang string, fp string"


def slow_print(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", words)]
    if not words:
        return 0
    runs = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, prints, reach=3):
    label = list(range(len(ids)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= reach:
                label[find(i)] = find(j)
    roots = [find(i) for i in range(len(ids))]
    return [min((ids[j] for j in range(len(ids)) if roots[j] == r and ids[j] is not None), default=None) for r in roots]


def rows():
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, n)) for n in (400, 300, 80, 40)]
    out = [(i, t, "en", "x") for i, t in enumerate([None, "", "  \t\n", "One", "one two", "ONE TWO", *base, *base[:2]])]
    for i in range(60):
        w = base[i % 3].split()
        w[int(rng.integers(0, len(w)))] = "changed"
        out.append((100 + i, "\x0b".join(w), "de", None))
    out += [(None, base[0], None, None), (3, "One", "en", "x"), (None, "alone here now", None, None), (7, "É É", None, None), (8, "é é", None, None)]
    return out


@pytest.mark.parametrize("limit", [4096, 2])
def test_equals_all_pairs(spark, limit):
    data = rows()
    got = simhash.near_duplicates(spark.createDataFrame(data, SCHEMA), limit=limit).collect()
    prints = [slow_print(r[1]) for r in data]
    want = list(zip([r[0] for r in data], prints, slow_components([r[0] for r in data], prints)))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=key) == sorted(want, key=key)


def test_chain_of_small_steps(spark):
    """A chain of prints, each three bits from the next, is one component in few rounds."""
    fps, x = [0], 0
    for i in range(0, 60, 3):
        x |= 7 << i
        fps.append(x)
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    from dayloom.llm.graph import components
    got = components(simhash.links(nodes)).collect()
    assert len(got) == len(fps) - 1 and len({r.v for r in got}) == 1


@pytest.mark.parametrize("spread", [4, 12, 64])
def test_index_equals_all_pairs(spread):
    rng = np.random.default_rng(spread)
    fp = np.unique(rng.integers(0, 2**spread, 700, dtype=np.uint64, endpoint=False) if spread < 64 else
                   np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64)))
    bucket = (np.arange(len(fp)) % 3).astype(np.int64)
    index = simhash.GrayIndex(bucket, fp)
    found = {tuple(sorted((int(index.order[a]), int(index.order[b])))) for i, j in index.pairs(3) for a, b in zip(i, j)}
    want = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp))
            if bucket[a] == bucket[b] and int(fp[a] ^ fp[b]).bit_count() <= 3}
    assert found == want


def test_long_texts(spark):
    """Texts of a million characters have the fingerprint of all their shingles."""
    rng = np.random.default_rng(21)
    long = " ".join(f"w{i}" for i in rng.integers(0, 5000, 200_000))
    docs = [(1, long, "x"), (2, long + " end", "x"), (3, "w " * 300_000, "x"), (4, "w w w", "x")]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string, fp string")).collect()}
    assert all(got[i].fp % 2**64 == slow_print(t) for i, t, _ in docs)
    assert got[1].component_id == got[2].component_id == 1 and got[3].component_id == got[4].component_id == 3


def test_empty_table(spark):
    got = simhash.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "digest", "fp", "root", "component_id"] and got.count() == 0
    assert isinstance(got.schema["component_id"].dataType, T.LongType)


def test_one_row_of_each_component(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    prints = [slow_print(r[1]) for r in data]
    groups = slow_components(list(range(len(data))), prints)
    want = [min((data[j][0] for j in range(len(data)) if groups[j] == g and data[j][0] is not None), default=None) for g in set(groups)]
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    key = lambda x: (x is None, x)
    assert sorted((r.doc_id for r in out.collect()), key=key) == sorted(want, key=key)
