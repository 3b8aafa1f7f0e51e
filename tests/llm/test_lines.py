"""Line dedup against a plain loop and SQL."""

import hashlib

import pytest

from dayloom.llm import lines

SCHEMA = "doc_id long, text string, row string, later string, first string"


def slow(rows, min_words):
    ranked = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1] or ""))
    seen, out = set(), {}
    for k in ranked:
        text = rows[k][1] or ""
        parts = text.split("\n")
        words = [p.lower().split() for p in parts]
        run, gone = [], set()
        for i, w in enumerate([*words, ["end"]]):
            if i < len(words) and w and tuple(w) in seen:
                run.append(i)
            elif w:
                if sum(len(words[j]) for j in run) >= min_words:
                    gone |= set(range(run[0], run[-1] + 1))
                run = []
            seen.add(tuple(w)) if i < len(words) else None
        ends = [p + ("\n" if i < len(parts) - 1 else "") for i, p in enumerate(parts)]
        left = "".join(e for i, e in enumerate(ends) if i not in gone)
        out[k] = (sum(map(bool, words)), sum(bool(words[i]) for i in gone), hashlib.sha256(left.encode()).hexdigest())
    return [(rows[k][0], *out[k]) for k in range(len(rows))]


def data():
    passage = " ".join(f"p{i}" for i in range(60))
    many = "\n".join(f"line {i} of the shared part here" for i in range(10))
    texts = [None, "", "\n\n", f"a b\n{passage}\nc", f"x\n{passage.upper()}", f"{passage}\ttail", f"{many}\nown words one", f"é é\n{many}\n\n{passage}\nend",
             f"{passage}\n{passage}", "short line\nshort line"]
    rows = [(i, t, "r", "l", "f") for i, t in enumerate(texts)]
    return rows + [(3, rows[3][1], "r", "l", "f"), (None, passage, None, None, None), (None, None, None, None, None)]


@pytest.mark.parametrize("least", [50, 1])
def test_equals_plain_loop(spark, least):
    rows = data()
    out = lines.without_repeated_lines(spark.createDataFrame(rows, SCHEMA), least).collect()
    got = [(r.row.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in out]
    assert sorted(map(repr, got)) == sorted(map(repr, slow(rows, least)))
    for r in out:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_every_later_line_goes_by_default(spark):
    """A short copy goes whole, a short line on its own goes, also inside one document."""
    rows = [(1, "a short text\nof two lines"), (2, "A  short text\nof two lines"), (3, "own words\na short text\nmore own words\nown words")]
    out = lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.row.doc_id: r.kept_text for r in out} == {1: rows[0][1], 2: "", 3: "own words\nmore own words\n"}


def test_empty(spark):
    assert lines.without_repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    from compare import compare, oracle
    problem = compare(lines.op10_lines(spark, f"/root/testdata/{sf}"), oracle(f"/root/testdata/{sf}"), lines.OP10_SQL)
    assert not problem, problem
