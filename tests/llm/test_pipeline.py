"""The pipeline against the plain versions of its stages."""

import hashlib
import os
import sys
from collections import Counter

import numpy as np

import corpus_pipeline
from dayloom.llm import pieces, quality

sys.path.insert(0, os.path.dirname(__file__))
import test_nearcopies as near_test  # noqa: E402


def documents():
    rng = np.random.default_rng(9)
    line = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 8)))) for _ in range(n)) + "."
    prose = ["\n".join(line(12) for _ in range(8)) for _ in range(40)]
    passage = line(80)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(prose)]
    rows += [(100 + i, prose[i], "en", "s0", 1) for i in range(5)]
    rows += [(200 + i, prose[10 + i] + "\n" + passage, "en", "s1", 1) for i in range(6)]
    words = ["".join(map(chr, rng.integers(97, 123, 3))) for _ in range(60)]
    short, brief = " ".join(words) + ".", " ".join(w * 2 for w in words[:40]) + "."
    rows += [(220 + i, line(90) + "\n" + part, "en", "s1", 1) for i, part in enumerate((short, short, brief, brief))]
    change = lambda t, n: " ".join(w if k % (97 // n) else f"changed{k}" for k, w in enumerate(t.split(" "), 1))
    rows += [(400 + i, change(prose[30 + i], n), "en", "s2", 1) for i, n in enumerate((1, 2, 12))]
    rows += [(500, "\n".join(line(15) for _ in range(1500)), "en", "s0", 1), rows[7], (None, line(120), "en", "s1", 1)]
    rows += [(300, "too short", "en", "s2", 9), (301, None, None, None, None), (302, prose[20] + "\nRead more", "en", None, 1)]
    return rows


def test_run_equals_plain_stages(spark, tmp_path):
    rows = documents()
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, digest string, key string"
    spark.createDataFrame([(*r, "r", None, "k") for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [(i, "\n".join(x for x in t.split("\n") if x != "Read more"), s) for i, t, _, s, _ in dict.fromkeys(rows) if t and len(t.split()) >= 50]
    ids = near_test.slow_groups([(i, t) for i, t, _ in kept])
    kept = [r for r, g in zip(kept, ids) if r[0] == g]
    assert {400, 401}.isdisjoint(r[0] for r in kept) and 402 in {r[0] for r in kept}
    seen = Counter(t.encode()[k:k + 150] for _, t, _ in kept for k in range(len(t.encode()) - 149))
    texts = {}
    for i, t, s in kept:
        data, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for k in range(len(data) - 149):
            if seen[data[k:k + 150]] > 1:
                gone[k:k + 150] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
        for a, b in zip(edges[::2], edges[1::2]):
            gone[a:b] = b - a >= 400 or len(data[a:b].split()) >= 50
        texts[i] = (bytes(np.frombuffer(data, np.uint8)[~gone]).decode(errors="ignore"), s)

    model = pieces.Pieces(pieces.read_pieces())
    for r in out:
        text, source = texts[r.doc_id]
        assert r.source == source and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.ids == list(memoryview(model.encode(text)).cast("i")) and r.n_ids == len(r.ids)
    short, brief = (next(r[1] for r in rows if r[0] == i).split("\n")[-1] for i in (220, 222))
    assert short not in texts[220][0] + texts[221][0] and brief in texts[222][0] and brief in texts[223][0]
    assert {500, 7, None} <= texts.keys() and len(texts[500][0].split()) == 22_500
    size = {i: len(t.split()) for i, (t, _) in texts.items()}
    assert any(len(t) < 700 for t, _ in texts.values()) and max(Counter(r.doc_id for r in out).values()) <= 2
    assert abs(sum(size[r.doc_id] for r in out) - 1.5 * sum(size.values())) <= 4 * sorted(size.values())[-2] + size[500]


def test_stages_return_the_columns_of_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, empty, "")
        assert out.columns == empty.columns and [f.dataType for f in out.schema] == [f.dataType for f in empty.schema], name
        assert out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, "").count() == 0
    assert quality.MIN_WORDS == 50
