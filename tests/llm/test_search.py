"""Reversed search against scoring every document for every item, and SQL."""

import math
import re

import numpy as np
import pytest

from dayloom.llm import search

DOCS = "doc_id long, text string, row string, key string, score string"
ITEMS = "item_id long, text string, row string, terms string, block string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, k=10):
    parts = [cut(t) for _, t, *_ in docs]
    n_docs, n_terms = sum(map(bool, parts)), sum(map(len, parts))
    out = []
    for item_id, text, *_ in items:
        total = [0] * len(docs)
        for term in set(cut(text)):
            df = sum(term in p for p in parts)
            weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
            for d, p in enumerate(parts):
                if tf := p.count(term):
                    m = 100 - 90 + 90 * len(p) * n_docs // n_terms
                    total[d] += weight * (1000000000 * tf // (1000 * tf + 8 * m))
        order = sorted((d for d in range(len(docs)) if total[d] > 0), key=lambda d: (-total[d], docs[d][0] is None, docs[d][0] or 0))
        out += [(item_id, r + 1, docs[d][0], total[d]) for r, d in enumerate(order[:k])]
    return out


def data(seed=1):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{int(rng.zipf(1.4)) % 300}"
    docs = [(i, " ".join(word() for _ in range(rng.integers(1, 80))), "r", "k", "s") for i in range(150)]
    docs += [(200 + i, docs[3][1], "r", "k", "s") for i in range(30)] + [(3, docs[3][1], "r", "k", "s")] * 2
    docs += [(None, docs[3][1], None, None, None), (None, None, None, None, None), (300, "", "r", None, None), (301, " \n.,", None, None, None),
             (302, "long " * 50_000 + "w1", "r", "k", "s"), (303, "É É é Ab_aB\x7fab w1", "r", "k", "s")]
    items = [(i, " ".join(word() for _ in range(rng.integers(1, 30))), "r", "t", "b") for i in range(40)]
    items += [(0, items[0][1], "r", "t", "b"), (None, docs[3][1], None, None, None), (50, None, "r", None, None), (51, "...", None, None, None),
              (52, "nowhere to befound", None, None, None), (53, "É AB", "r", "t", "b"), (54, docs[5][1] + " long", "r", "t", "b")]
    return docs, items


@pytest.mark.parametrize("limit", [search.POSTINGS, 200])
def test_equals_scoring_everything(spark, limit):
    docs, items = data()
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    out = search.ranked(df, spark.createDataFrame(items, ITEMS), limit=limit)
    assert out.columns == ["row", "rank", "doc_id", "score"]
    got = [(r.row.item_id, r["rank"], r.doc_id, r.score) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, slow(docs, items)))
    assert {r[1] for r in got} == set(range(1, 11))


def test_small_blocks_of_scores(spark, monkeypatch):
    docs, items = data(7)
    monkeypatch.setattr(search, "SCORES", 400)
    index = search.Index.of([type("Row", (), {"key": k, "terms": sorted({t.encode() for t in cut(x[1])})}) for k, x in enumerate(items)])
    stats = [cut(x[1]) for x in docs]
    n, length = sum(map(bool, stats)), sum(map(len, stats))
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t.decode() in p for p in stats) + 1))) for t in index.number], np.int64)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in docs], pa.int64()), pa.array([x[1] for x in docs])], ["doc_id", "text"])
    value = lambda v: type("Held", (), {"value": v})
    hits = search._count_hits(value(index))([batch.slice(0, 90), batch.slice(90)])
    (best,) = search._rank(value(index), value((weight, n, length)), 10)(hits)
    got = [(items[r["key"]][0], r["doc_id"], r["score"]) for r in best.to_pylist()]
    assert sorted(map(repr, got)) == sorted(repr((i, d, s)) for i, _, d, s in slow(docs, items))


def test_empty_tables(spark):
    docs, items = data()
    some, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], DOCS)
    assert search.ranked(none, spark.createDataFrame(items, ITEMS)).count() == 0
    assert search.ranked(some, spark.createDataFrame([], ITEMS)).count() == 0


def test_terms():
    text = "Ab-ÉÀ_x9 \x7f\x00z z ﬁ"
    assert [t.decode() for t in search.terms(text.encode())] == cut(text) == ["ab", "ÉÀ", "x9", "z z", "ﬁ"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    from compare import compare, oracle
    problem = compare(search.op13_search(spark, f"/root/testdata/{sf}"), oracle(f"/root/testdata/{sf}"), search.OP13_SQL)
    assert not problem, problem
