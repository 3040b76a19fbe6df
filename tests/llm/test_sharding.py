"""Shards of nearly equal bytes against the least capacity by enumeration, and against SQL."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import sharding
from tidemark.llm.sharding import Walk, shard_documents


def least(sizes: list[int], shards: int) -> int:
    """The smallest largest part of a contiguous partition, by dynamic programming."""
    ends = [0]
    for size in sizes:
        ends.append(ends[-1] + size)
    best = ends[:]
    for _ in range(shards - 1):
        best = [min(max(best[i], ends[j] - ends[i]) for i in range(j + 1)) for j in range(len(ends))]
    return best[-1]


def test_walk_is_minimax():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.choice((1, 2, 5, 40)) for _ in range(rng.randrange(1, 30))]
        shards = rng.randrange(1, 8)
        walk = Walk([(f"{k:04x}", size, 1) for k, size in enumerate(sizes)])
        assert walk.capacity(shards, False) == walk.capacity(shards, True) == least(sizes, shards) and not walk.open_units(shards)


def plan(rows, shards):
    """Shard of each text, its own for those larger than an even share, by the rule itself."""
    sizes = defaultdict(int)
    for _, text in rows:
        sizes[hashlib.sha256((text or "").encode()).hexdigest()] += len((text or "").encode()) + 16
    left, alone = sum(sizes.values()), []
    for digest in sorted(sizes, key=lambda h: (-sizes[h], h)):
        if sizes[digest] * (shards - len(alone)) <= left:
            break
        alone.append(digest)
        left -= sizes[digest]
    order, out = sorted(set(sizes) - set(alone)), {h: k for k, h in enumerate(alone)}
    capacity, shard, held = least([sizes[h] for h in order], shards - len(alone)), len(alone), 0
    for h in order:
        if held + sizes[h] > capacity:
            shard, held = shard + 1, 0
        held += sizes[h]
        out[h] = shard
    return out


@pytest.mark.parametrize("digits", [1, 4])
@pytest.mark.parametrize("shards", [1, 3, 40])
@pytest.mark.parametrize("name", ["small", "edges"])
def test_documents(request, monkeypatch, name, shards, digits):
    monkeypatch.setattr(sharding, "DIGITS", digits)
    df = request.getfixturevalue(name)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = shard_documents(df, shards).collect()
    want = plan(rows, shards)
    assert len(got) == len(rows) and all(r.shard == want[r.text_sha256] for r in got)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=key) == sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=key)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and max(slots) < shards


def test_a_text_with_a_third_of_the_rows(spark):
    rows = [(k, "copy " * 30 if k % 3 == 0 else f"{k} " * (k % 50)) for k in range(3000)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).groupBy("shard").agg({"size": "sum"}).collect()
    sizes = sorted(r[1] for r in got)
    assert len(sizes) == 8 and sizes[-2] - sizes[0] < 2000


def test_query_is_the_sql(same_as_sql):
    same_as_sql("op13_sharding")


def test_no_rows(nothing):
    assert shard_documents(nothing).count() == 0
