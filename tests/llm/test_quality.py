"""Line-first cleaning against plain loops and SQL."""

import re

import pytest

from dayloom.llm import quality

SCHEMA = "doc_id long, text string, quality string, row string, word string, line string"
WORD = r"[^\x20\x09-\x0D]+"


def slow(text):
    words = re.findall(WORD, text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


PROSE = "\n".join(f"The river{i} says{i} a thing{i} about{i} its banks{i} and stones{i * 3} too{i}." for i in range(12))
TEXTS = [None, "", " \n\t\n", "one two three", "a b c a b c", "a a a a a", "x\x0by\x85z w", PROSE, PROSE + "\nHome\nAbout us",
         "\n".join("Home | News | Sport | Item" + str(i) for i in range(40)), ("w&& " * 5 + "z" + "\n") * 20, "LOUD!! " * 80,
         "\n".join(f"We use cookies to make text number {i} better for you in all {i} ways." for i in range(9)),
         PROSE.replace(".", ""), "one two three four " * 60, "É. " * 70, PROSE + "\nAll rights reserved.\n" + PROSE]


def test_counts_and_verdicts(spark):
    rows = [(i, t, "q", "r", "w", "l") for i, t in enumerate(TEXTS)] + [(None, PROSE, None, None, None, None), (7, PROSE, None, None, None, None)]
    out = quality.line_quality(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    kept = {}
    for r in out:
        q = r.quality
        text = PROSE if r.doc_id is None else TEXTS[r.doc_id]
        got = (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words)
        assert got == slow(text), text
        assert q.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        kept[r.doc_id] = q.kept
        if r.doc_id == 8:
            assert q.clean == PROSE
    assert kept[7] and kept[8] and kept[None]
    assert not any(kept[i] for i in (0, 1, 2, 3, 9, 10, 11, 12, 14))


def test_cleaned_keeps_columns(spark):
    docs = spark.createDataFrame([(1, PROSE + "\nRead more", "q", "r", "w", "l"), (2, "x", "q", "r", "w", "l")], SCHEMA)
    out = quality.cleaned(docs).collect()
    assert [(r.doc_id, r.text, r.quality, r.line) for r in out] == [(1, PROSE, "q", "l")]
    assert quality.cleaned(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text(spark):
    text = " ".join(f"w{i % 9000}" for i in range(60000))
    row = quality.line_quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().quality
    assert row.n_repeat_words == 60000 == row.n_words


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    from compare import compare, oracle
    problem = compare(quality.op4_quality(spark, f"/root/testdata/{sf}"), oracle(f"/root/testdata/{sf}"), quality.OP4_SQL)
    assert not problem, problem
