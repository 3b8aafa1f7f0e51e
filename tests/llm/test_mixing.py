"""Mixing against a plain loop and against SQL."""

import math
import re

import pytest

from dayloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, row string, plan_source string, target string, copies string"


def slow(rows, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by repeated resharing, then one pass over each source in key order."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({r[2] for r in rows if r[2] is not None}) + ([None] if any(r[2] is None for r in rows) else [])
    total = {n: sum(size(r[1]) for r in rows if r[2] == n) for n in names}
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    goal, free, left = {}, set(names), share * sum(total.values())
    while free:
        each = left / sum(w[n] for n in free)
        over = {n for n in free if each * w[n] > most * total[n]}
        goal |= {n: most * total[n] for n in over} if over else {n: each * w[n] for n in free}
        left -= sum(most * total[n] for n in over)
        free = free - over if over else set()
    return names, total, goal


def data():
    rows = [(i, " ".join(["w"] * (i % 50 + 1)), ["b", "a", None, "é", "z"][i % 5], *"abcde"[:5]) for i in range(400)]
    rows += [(i, "hot " * 30, "hot", *"abcde") for i in range(400, 800)]
    return rows + [(1, None, "b", *"abcde"), (2, "", "empty", *"abcde"), (3, " \t", None, *"abcde"),
                   (None, "x y", "a", *"abcde"), (None, "x y", "a", *"abcde"), rows[0], rows[0], (9000, "long " * 5000, "z", *"abcde")]


def test_targets_and_nearness(spark):
    rows = data()
    docs = spark.createDataFrame(rows, SCHEMA)
    names, total, goal = slow(rows)
    narrow = mixing.sized(docs.drop("size", "row", "plan_source", "target", "copies")).drop("text")
    out = mixing.with_copies(narrow, mixing.mixing_plan(narrow)).collect()
    assert len(out) == len(rows)
    for n in names:
        mine = [r for r in out if r.source == n]
        assert all(r.source_size == total[n] and math.isclose(r.target, goal[n], rel_tol=1e-12) for r in mine)
        assert all(0 <= r.copies <= 2 for r in mine)
        taken = sum(r.copies * r["size"] for r in mine)
        assert abs(taken - goal[n]) <= max(r["size"] for r in mine) * 1.5
        if total[n]:
            assert {r.copies for r in mine} <= {math.floor(goal[n] / total[n]), math.floor(goal[n] / total[n]) + 1}


def test_order_is_by_key(spark):
    docs = spark.createDataFrame([(i, "a b c", "s") for i in range(300)] + [(i, "d " * 900, "t") for i in range(300, 320)],
                                 "doc_id long, text string, source string")
    narrow = mixing.sized(docs).drop("text")
    out = [r for r in mixing.with_copies(narrow, mixing.mixing_plan(narrow, share=0.01)).collect() if r.source == "s"]
    last = max((r.draw for r in out if r.copies), default=-1)
    assert all(r.copies == 1 for r in out if r.draw <= last) and 0 < sum(r.copies for r in out) < 300


def test_mix_keeps_columns_and_repeats(spark):
    docs = spark.createDataFrame(data(), SCHEMA)
    once, again = mixing.mix(docs), mixing.mix(docs)
    assert once.columns == docs.columns
    assert sorted(map(repr, once.collect())) == sorted(map(repr, again.collect()))


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_weights_favour_quality(spark):
    docs = spark.createDataFrame([(i, ("a# " if i % 2 else "ab ") * 10, "s") for i in range(2000)],
                                 "doc_id long, text string, source string")
    narrow = mixing.sized(docs).drop("text")
    out = mixing.with_copies(narrow, mixing.mixing_plan(narrow, share=0.3)).collect()
    clean = sum(r.copies for r in out if r.doc_id % 2 == 0)
    assert clean > 2 * sum(r.copies for r in out if r.doc_id % 2)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    from compare import compare, oracle
    problem = compare(mixing.op9_mixing(spark, f"/root/testdata/{sf}"), oracle(f"/root/testdata/{sf}"), mixing.OP9_SQL)
    assert not problem, problem
