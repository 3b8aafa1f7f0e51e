"""Sharding against the smallest capacity found by a plain search."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from dayloom.llm import sharding

SCHEMA = "doc_id long, text string, shard string, block string"


def least(sizes, shards):
    def fits(c):
        n, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                n, room = n + 1, c
            room -= s
        return n <= shards
    low, high = 1, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def rows(n, hot):
    rng = np.random.default_rng(n)
    out = [(int(i), "x" * int(rng.integers(0, 4000)) + str(i % (n // 2)), "a", "b") for i in range(n)]
    out += [(10**6 + i, "hot text " * 20, "a", "b") for i in range(hot)]
    return out + [(None, None, None, None), (5, "", None, None), out[0], out[0], (None, "é" * 100, None, None)]


@pytest.mark.parametrize("n,hot,blocks,finer", [(600, 0, 4096, 256), (600, 900, 4096, 256), (3000, 100, 16, 4), (60, 3000, 2, 2)])
def test_smallest_capacity(spark, monkeypatch, n, hot, blocks, finer):
    monkeypatch.setattr(sharding, "FINER", finer)
    if blocks < 4096:
        real = sharding.grouped_rows
        monkeypatch.setattr(sharding, "grouped_rows", lambda d: real(d).selectExpr("* except (block)", f"cast(block / {4096 // blocks} as int) as block"))
    data = rows(n, hot)
    out = sharding.shard_by_bytes(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(out) == len(data)
    groups = defaultdict(int)
    for _, t, *_ in data:
        groups[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    load, slots, crc = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in out:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        crc[r.text_crc32].add(r.shard)
    assert max(load.values()) == least([groups[g] for g in sorted(groups)], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in crc.values()) and set(load) <= set(range(16))
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in out) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in data)
    if not hot:
        assert min(load.values()) > 0.9 * max(load.values())


def test_long_texts(spark):
    """A text larger than a fair share of all others is a shard of its own, whole."""
    data = [(1, "é" * 1_000_000, "a", "b")] + [(10 + i, f"{i} " * 200, "a", "b") for i in range(300)]
    out = sharding.shard_by_bytes(spark.createDataFrame(data, SCHEMA)).collect()
    first = next(r for r in out if r.doc_id == 1)
    assert first["size"] == 2_000_001 and sum(r.shard == first.shard for r in out) == 1 and len(out) == 301


def test_few_rows_and_none(spark):
    assert sharding.shard_by_bytes(spark.createDataFrame([], SCHEMA)).count() == 0
    out = sharding.shard_by_bytes(spark.createDataFrame([(1, "a", "", "")], SCHEMA)).collect()
    assert [(r["size"], r.slot) for r in out] == [(2, 0)]
