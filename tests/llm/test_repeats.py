"""Repeats against a plain index of every string."""

import hashlib
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from dayloom.llm import bwt, repeats

SCHEMA = "doc_id long, text string, row string, runs string, n_bytes string"


def slow(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = True
        left = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), len(d) - len(left), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
    return out


def data():
    rng = np.random.default_rng(2)
    word = lambda n: " ".join("".join(map(chr, rng.integers(97, 103, rng.integers(1, 5)))) for _ in range(n))
    passage, other = word(60), "é" * 30 + word(90)
    base = word(400)
    texts = [base, base, base[:700] + "X" + base[701:], word(300), None, "", "short", "a" * 900, "a" * 399, "a" * 400, "ab" * 500]
    texts += [word(50) + passage + word(30) for _ in range(25)]
    texts += [word(5) + other for _ in range(4)] + [other + word(3) + other]
    rows = [(i, t, "r", "s", "t") for i, t in enumerate(texts)]
    return rows + [(None, passage + " x" + word(200), None, None, None), (None, None, None, None, None), rows[3], (3, base, "r", "s", "t")]


@pytest.mark.parametrize("length,gram,limit,chunk", [(400, 96, 2048, 1 << 20), (150, 40, 3, 1000), (100, 100, 2048, 5000)])
def test_equals_plain_index(spark, monkeypatch, length, gram, limit, chunk):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    rows = data()
    out = repeats.without_repeats(spark.createDataFrame(rows, SCHEMA), length, gram, limit).collect()
    want = [(r[0], *w) for r, w in zip(rows, slow([r[1] for r in rows], length))]
    got = [(r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in out)


def test_short_ranges_stay_with_a_least_number_of_words(spark):
    few, many = "x" * 30 + " " + "y" * 200, " ".join(f"w{i}" for i in range(60))
    own = lambda k: " ".join(f"{k}{j}" for j in range(80))
    rows = [(1, f"{own('a')} {few} {own('b')}"), (2, f"{own('c')} {few} {own('d')}"), (3, f"{own('e')} {many}"), (4, f"{many} {own('f')}"),
            (5, own("g") + "z" * 500), (6, "z" * 500 + own("h"))]
    out = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 150, 48, min_words=50)
    got = {r.row.doc_id: r.kept_text.strip() for r in out.collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: own("e"), 4: own("f"), 5: own("g"), 6: own("h")}


def test_transform_equals_plain_index():
    rng = np.random.default_rng(4)
    for trial in range(30):
        length = int(rng.integers(1, 12))
        pieces = [bytes(rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(0, 60))).astype(np.uint8)) for _ in range(int(rng.integers(1, 9)))]
        seen = Counter(p[i:i + length] for p in pieces for i in range(len(p) - length + 1))
        want = [i + length <= len(p) and seen[p[i:i + length]] > 1 for p in pieces for i in range(len(p))]
        assert bwt.repeated_starts(pieces, length).tolist() == want, (length, pieces)


def test_columns_and_empty(spark):
    docs = spark.createDataFrame(data(), SCHEMA)
    out = repeats.deduplicated(docs, length=150, gram=40)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert repeats.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_returns_the_remaining_text(spark):
    """Under the column name of its input: the remaining bytes, but for characters cut in two."""
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = repeats.op7_repeats(spark, sf_dir).collect()
    assert len(out) == len(texts) and any(r.n_removed for r in out)
    for r in out:
        left = r.n_bytes - r.n_removed
        assert left - 6 * r.n_spans <= len(r.text.encode()) <= left
        assert r.n_removed or r.text == texts[r.doc_id]
        if len(r.text.encode()) == left:
            assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256


def slow_passages(texts, least):
    """(byte ranges of words in ``least`` consecutive words that also start elsewhere, text without them) of each text."""
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    words = [[(t or "").encode()[a:b] for a, b in s] for t, s in zip(texts, spans)]
    seen = Counter(tuple(w[i:i + least]) for w in words for i in range(len(w) - least + 1))
    out = []
    for t, s, w in zip(texts, spans, words):
        gone = {i + k for i in range(len(w) - least + 1) if seen[tuple(w[i:i + least])] > 1 for k in range(least)}
        ranges = [[s[i][0], s[i][1]] for i in sorted(gone) if i - 1 not in gone]
        for r, i in zip(ranges, [i for i in sorted(gone) if i + 1 not in gone]):
            r[1] = s[i][1]
        data, edges = (t or "").encode(), [0, *(x for r in ranges for x in r), None]
        out.append(([tuple(r) for r in ranges], b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()))
    return out


@pytest.mark.parametrize("least,gram,limit,chunk", [(50, 8, 2048, 1 << 18), (50, 8, 3, 1000), (12, 3, 2, 300)])
def test_passages_equal_plain_index(spark, monkeypatch, least, gram, limit, chunk):
    """Passages by words, of any number of bytes, white space between the words aside; the other columns stay as they are."""
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    rows = data()
    few = [f"w{i}" for i in range(49)]
    rows += [(100 + i, t, None, None, None) for i, t in enumerate([
        " ".join(few) + " own", " ".join(few) + " other", "x " + "\t ".join([*few, "é"]) + "\n", " ".join([*few, "é", "y"]), "z " * 200, "字" * 300, "字" * 300])]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = repeats.without_repeats(docs, limit=limit, passage_words=least, passage_gram=gram).collect()
    got = [(r.row.doc_id, [(p.start, p.end) for p in r.passages], r.passage_free_text) for r in out]
    want = [(r[0], *w) for r, w in zip(rows, slow_passages([r[1] for r in rows], least))]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    same = lambda rows: sorted(repr((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.kept_text)) for r in rows)
    assert same(out) == same(repeats.without_repeats(docs, limit=limit).collect())


def test_query_finds_passages_under_400_bytes(spark, tmp_path):
    """The contract's columns leave a repeated passage of 60 short words; passage_free_text doesn't."""
    own, passage = lambda k: " ".join(f"{k}{j}" for j in range(80)), " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{own('a')}\n{passage}\n{own('b')}"), (2, f"{passage} {own('c')}"), (3, own("d"))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in repeats.op7_repeats(spark, str(tmp_path)).collect()}
    assert {k: (r.n_removed, r.text) for k, r in out.items()} == {k: (0, t) for k, t in rows}
    assert {k: (r.n_passages, r.passage_free_text) for k, r in out.items()} == {
        1: (1, f"{own('a')}\n\n{own('b')}"), 2: (1, " " + own("c")), 3: (0, own("d"))}


def test_transform_of_words_equals_plain_index():
    """More distinct words than 16 bits hold, too."""
    rng = np.random.default_rng(5)
    for n, kinds in ((40, 3), (90000, 1 << 62)):
        pieces = [rng.integers(0, kinds, n).astype("<u8") for _ in range(3)]
        pieces[2][5:30] = pieces[0][7:32]
        words = [p.tolist() for p in pieces]
        seen = Counter(tuple(w[i:i + 9]) for w in words for i in range(n - 8))
        want = [i + 9 <= n and seen[tuple(w[i:i + 9])] > 1 for w in words for i in range(n)]
        assert any(want) and bwt.repeated_starts([p.tobytes() for p in pieces], 9, words=True).tolist() == want


def test_memory_of_a_task():
    """What anchors and the search hold at once stays small, however much text a task has."""
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 123, 3000, np.uint8)) for _ in range(700)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array(range(700)), pa.array(texts)], ["doc_id", "digest", "text"])
    pieces = [(k // 2, k, k, 0, 1, texts[k % 350][:2900 + k], 0) for k in range(700)]
    tasks = [lambda: repeats._find_anchors(150, 48)([batch]),
             lambda: repeats._search_pieces(150, False)([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pieces)], list("abcdefg"))])]
    for task in tasks:
        tracemalloc.start()
        for _ in task():
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 60 << 20, most
