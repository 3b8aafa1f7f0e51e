"""Near copies by SimHash and by shared shingles, against all pairs."""

import os
import sys

import numpy as np
import pytest
import xxhash

from dayloom.llm import nearcopies, simhash

sys.path.insert(0, os.path.dirname(__file__))

SCHEMA = "doc_id long, text string, root string, digest string, key string"


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b)


def slow_groups(rows):
    """The smallest id reachable from each row, over all pairs: equal, within 3 bits, or 0.8 alike."""
    prints = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 or alike(rows[i][1], rows[j][1]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        g = find(i)
        least[g] = min(least.get(g, (True, 0)), (doc is None, doc or 0))
    return [None if least[find(i)][0] else least[find(i)][1] for i in range(len(rows))]


def digest(text):
    return np.array(xxhash.xxh64_intdigest((text or "").encode(), 42), np.uint64).view(np.int64).item()


def data():
    rng = np.random.default_rng(12)
    word = lambda: "".join(map(chr, rng.integers(97, 123, rng.integers(2, 8))))
    base = [[word() for _ in range(rng.integers(30, 400))] for _ in range(25)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for k, b in enumerate(base):
        for n in (1, 2, 3, 5, 9, 20):
            own = list(b)
            for at in rng.choice(len(own), min(n, len(own)), replace=False):
                own[at] = word()
            rows.append((100 + 10 * k + n % 10, " ".join(own).upper() if n == 2 else " ".join(own)))
    rows += [(1000 + k, " ".join(b[:-2]) + "\n") for k, b in enumerate(base[:5])] + [(2000, "one two"), (2001, "One  two"), (2002, "one"), (2003, None), (2004, " \t"), (2005, "")]
    # a family: each differs from the next a little, and from the last a lot
    chain = [word() for _ in range(200)]
    for k in range(40):
        chain[5 * k % 200] = word()
        rows.append((3000 + k, " ".join(chain)))
    return rows + [(None, rows[0][1]), (None, "word " * 50_000), (4000, "word " * 50_000), rows[3], rows[3]]


def test_groups_equal_all_pairs(spark):
    rows = data()
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    want = slow_groups(rows)
    got = nearcopies.groups(df).collect()
    assert len(got) == len(rows)
    # no group goes beyond what all pairs link, and hardly a pair is lost
    roots = {}
    for r, (doc, text) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.digest)), sorted(rows, key=lambda r: (str(r[0]), digest(r[1])))):
        roots.setdefault(r.root, set()).add(want[rows.index((doc, text))])
    assert all(len(g) == 1 for g in roots.values())
    of = {(r.doc_id, r.digest): r.root for r in got}
    links = [(a, b) for i, a in enumerate(rows) for b in rows[:i] if a[1] != b[1] and alike(a[1], b[1])]
    met = sum(of[a[0], digest(a[1])] == of[b[0], digest(b[1])] for a, b in links)
    assert len(links) > 100 and met >= 0.99 * len(links), (met, len(links))
    lost = len(roots) - len(set(want))
    assert lost <= 2, lost
    kept = nearcopies.one_of_each(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {str(g) for g in want} <= set(map(str, ids)) and len(ids) == len(set(want)) + lost


def template(pairs=150, seed=5):
    """Texts of one template, many in a band and few alike but the two of a pair; each repeats a word of its own, so SimHash tells all apart."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(map(chr, rng.integers(97, 123, rng.integers(3, 9))))
    base = [word() for _ in range(400)]

    def change(words, n):
        words = list(words)
        for at in rng.choice(len(words), n, replace=False):
            words[at] = word()
        return words

    rows = []
    for k in range(pairs):
        one = change(base, 5)
        rows += [(2 * k + i, " ".join([*words, *[word()] * 2000])) for i, words in enumerate((one, change(one, 7)))]
    return rows


@pytest.mark.parametrize("tile", [nearcopies.TILE, 7])
def test_no_pair_of_a_band_is_left_out(spark, monkeypatch, tile):
    """Pairs that share bands with many texts unlike them, whoever comes first there, are found."""
    monkeypatch.setattr(nearcopies.links_between, "__defaults__", (nearcopies.LIKENESS, tile))
    rows = template()
    bands = [nearcopies.band_keys(nearcopies.shingle_hashes(t.encode())) for _, t in rows]
    sets = [shingles(t) for _, t in rows]
    met = [(a, b) for b in range(len(rows)) for a in range(b) if (bands[a] == bands[b]).any()]
    want = [(a, b) for a, b in met if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(want) >= 150 and len(met) > 20 * len(want)
    root = {r.doc_id: r.root for r in nearcopies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(a, b) for a, b in want if root[a] != root[b]] == []
    assert len(set(root.values())) > 20


def test_alike_texts_share_a_band():
    """At 0.8 a pair is a candidate in nearly all cases; unlike texts are none."""
    rng = np.random.default_rng(3)
    found = unlike = 0
    for _ in range(300):
        n = int(rng.integers(100, 2000))
        both, own = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 2**63, (2, n // 8)).astype(np.uint64)
        a, b = (nearcopies.band_keys(np.r_[both, own[k]] * np.uint64(0x9E3779B97F4A7C15)) for k in range(2))
        found += (a == b).any()
        unlike += (nearcopies.band_keys(own[0] * np.uint64(7919)) == a).any()
    assert found >= 290 and unlike == 0


def test_empty(spark):
    assert nearcopies.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("text", ["a b c d e f g", "one", "é é ü", ""])
def test_shingles(text):
    assert len(nearcopies.shingle_hashes(text.encode())) == len(shingles(text))


def test_narrow_tables_get_few_files(spark):
    """The tables of keys between the steps have at most four files a core, or one for eight partitions, and all rows."""
    from dayloom.llm import common, graph

    most = max(4 * spark.sparkContext.defaultParallelism, common.partitions(spark) // 8)
    written = []

    def write(df, label):
        written.append(common.stage_narrow(df, label))
        return written[-1]

    edges = spark.range(0, 3000, 1, 3 * most).selectExpr("id + 1 AS u", "id - id % 10 AS v").where("u % 10 <> 0")
    assert len(common.stage(edges, "wide").inputFiles()) > most
    top = graph.components(edges, write)
    assert len(written) > 1 and all(1 <= len(t.inputFiles()) <= most for t in written)
    assert sorted(map(tuple, top.collect())) == [(u, u - u % 10) for u in range(3000) if u % 10]
    assert common.stage_narrow(edges.limit(0), "none").count() == 0
