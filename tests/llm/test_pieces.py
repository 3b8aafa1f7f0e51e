"""Encoding against the library's own best path on the same pieces, and exact round trips."""

from types import SimpleNamespace

import pyarrow as pa
import pytest

from dayloom.llm import pieces
from dayloom.llm.common import parts

SCHEMA = "doc_id long, text string, row string, ids string"


def _varint(data, at):
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def _as_unigram(data):
    """The serialised model with its type set to unigram: field 3 of message field 2."""
    at, out = 0, bytearray(data)
    while at < len(data):
        tag, at = _varint(data, at)
        assert tag & 7 == 2
        size, at = _varint(data, at)
        if tag >> 3 == 2:
            p, end = at, at + size
            while p < end:
                inner, p = _varint(data, p)
                if inner == 3 << 3:
                    out[p] = 1
                if inner & 7 == 0:
                    _, p = _varint(data, p)
                elif inner & 7 == 2:
                    n, p = _varint(data, p)
                    p += n
                else:
                    p += {1: 8, 5: 4}[inner & 7]
        at += size
    return bytes(out)


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    with open(pieces.MODEL, "rb") as f:
        return sentencepiece.SentencePieceProcessor(model_proto=_as_unigram(f.read()))


def test_equals_library_best_path(spark, library):
    """Word by word, the score is that of the first of the library's n best paths over the same pieces."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    table = pieces.read_pieces()
    model = pieces.Pieces(table)
    words = sorted({w for r in rows for w in r.text.split() if all(c in model.single for c in w)})[::7]
    assert len(words) > 1000
    for w in words:
        ids = memoryview(model.encode(w)).cast("i")
        assert sum(table[i][1] for i in ids) == sum(table[i][1] for i in library.nbest_encode(w, nbest_size=2)[0]), w


def test_words_join_up(spark):
    """A text's ids are those of one pass over all of it."""
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").first().text
    model = pieces.Pieces(pieces.read_pieces())
    whole = model.best_path("▁" + text.replace(" ", "▁"))
    assert list(memoryview(model.encode(text)).cast("i")) == whole


def test_best_score_by_brute_force():
    rows = [("<unk>", 0.0, "unknown"), *[(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)],
            *[(p, s, "normal") for p, s in (("▁", -2.0), ("a", -1.5), ("b", -1.0), ("ab", -2.2), ("▁a", -3.1), ("ba", -2.6), ("aba", -3.3), ("▁▁", -2.5))]]
    model = pieces.Pieces(rows)
    score = {p: s for p, s, k in rows if k == "normal"}

    def best(t):
        table = [0.0]
        for e in range(1, len(t) + 1):
            options = [table[e - len(p)] + s for p, s in score.items() if t[:e].endswith(p)]
            if t[e - 1] not in model.single:
                options.append(table[e - 1] + model.unknown_score)
            table.append(max(options))
        return table[-1]

    for text in ("abab", "ba ab", "  aba", "abaaabba b", "zaz ab", "é", " "):
        ids = list(memoryview(model.encode(text)).cast("i"))
        mine = sum(rows[i][1] for i in ids if rows[i][2] == "normal") + model.unknown_score * sum(c not in model.single for c in text.replace(" ", "▁"))
        assert abs(mine - best("▁" + text.replace(" ", "▁"))) < 1e-9
        assert model.decode(ids) == text


def test_round_trip(spark):
    texts = [None, "", " ", "  two  spaces ", "tab\tand\nline", "漢字 é 😀 \x00", "a" * 5000, "word " * 3000, "�", " x"]
    docs = spark.createDataFrame([(i, t, "r", "s") for i, t in enumerate(texts)] + [(None, "x", None, None)] * 2, SCHEMA)
    out = pieces.decode(pieces.encode(docs)).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        assert r.text == ("x" if r.row.doc_id is None else texts[r.row.doc_id] or "")
    assert pieces.decode(pieces.encode(spark.createDataFrame([], SCHEMA))).count() == 0


def test_one_worker_codes_both_ways(spark):
    """As encode and decode one after the other, in one Python step."""
    texts = [None, "", "  two  spaces ", "漢字 é 😀", "word " * 300, "x"]
    docs = spark.createDataFrame([(i, t, "r", "s") for i, t in enumerate(texts)] + [(None, "x", None, None)] * 2, SCHEMA)
    both, apart = pieces.there_and_back(docs), pieces.decode(pieces.encode(docs))
    assert both.schema == apart.schema and both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(str, both.collect())) == sorted(map(str, apart.collect()))
    assert pieces.there_and_back(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_task_holds_little_and_leaves_nothing():
    """A large batch comes back in slices, in order, and the words met are forgotten when the task ends."""
    texts = [f"text {i} of a large batch, é" if i % 7 else None for i in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200), pa.int64()), pa.array(texts, pa.string())], ["row", "text"])
    rows = SimpleNamespace(value=pieces.read_pieces())
    out = list(pieces._both_ways(rows)(iter([batch.slice(0, 0), batch])))
    assert [b.num_rows for b in out] == [b.num_rows for b in parts([batch])] == [512, 512, 176]
    assert pieces._model(rows.value).known == {}
    back = pa.Table.from_batches(out)
    assert back["row"].to_pylist() == list(range(1200)) and back["text"].to_pylist() == [t or "" for t in texts]
    model = pieces.Pieces(rows.value)
    assert back["ids"].to_pylist() == [list(memoryview(model.encode(t or "")).cast("i")) for t in texts]


def test_decode_equals_library(library):
    model = pieces.Pieces(pieces.read_pieces())
    for text in ("Hello  world", "漢 é\n", " x"):
        ids = list(memoryview(model.encode(text)).cast("i"))
        assert model.decode(ids) == library.decode(ids) == text
