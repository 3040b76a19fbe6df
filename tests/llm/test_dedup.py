"""Deduplication against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm.exact_dedup import drop_exact_copies, mark_exact_copies
from tidemark.llm.near_dedup import drop_near_duplicates, near_duplicates
from tidemark.llm.suffix_dedup import anchors, drop_repeated_passages, repeated_passages


def both(request):
    return [request.getfixturevalue(n) for n in ("small", "edges")]


@pytest.mark.parametrize("name", ["small", "edges"])
@pytest.mark.parametrize("heavy", [1, 1024])
def test_exact_copies(request, name, heavy):
    df = request.getfixturevalue(name)
    rows = df.select("doc_id", "text").collect()
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for i, r in enumerate(rows)}
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[norm[i]].append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0, i))
    want = Counter()
    for text, members in groups.items():
        best = rows[min(members)[3]].doc_id
        for m in members:
            d = rows[m[3]].doc_id
            want[(d, best, len(members), d == best and m[0] == min(members)[0], hashlib.sha256(text.encode()).hexdigest())] += 1
    got = mark_exact_copies(df, heavy=heavy).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert Counter(map(tuple, got)) == want
    left = drop_exact_copies(df, heavy=heavy)
    assert left.columns == df.columns and left.count() == len(groups)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


@pytest.mark.parametrize("name", ["small", "edges"])
def test_near_duplicates(request, name):
    df = request.getfixturevalue(name)
    rows = df.select("doc_id", "text").collect()
    sets = {r.doc_id: shingles(r.text) for r in rows if r.doc_id is not None}
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    want = Counter((r.doc_id, len(shingles(r.text)), root(r.doc_id) if r.doc_id is not None else None, r.doc_id is None or root(r.doc_id) == r.doc_id) for r in rows)
    got = near_duplicates(df).collect()
    assert Counter(map(tuple, got)) == want
    left = drop_near_duplicates(df)
    assert left.columns == df.columns and left.count() == sum(n for (_, _, _, kept), n in want.items() if kept)


def removed(texts, length):
    count = Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if count[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        yield bytes(b for b, g in zip(t, gone) if not g), sum(gone), len(re.findall(b"\1+", bytes(gone)))


@pytest.mark.parametrize("name,params", [("small", {}), ("edges", {}), ("small", {"most": 2}), ("small", {"rows_at_once": 5})])
def test_repeated_passages(request, name, params):
    df = request.getfixturevalue(name)
    if "most" in params:
        df = df.where("doc_id < 60")
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    want = Counter((d, len(t), n, spans, hashlib.sha256(kept).hexdigest()) for (d, t), (kept, n, spans) in zip(rows, removed([t for _, t in rows], 400)))
    got = repeated_passages(df, **params).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == want
    left = drop_repeated_passages(df, **params)
    assert left.columns == df.columns and left.count() == len(rows)


def test_anchors_of_blocks_are_those_of_the_text():
    rng = np.random.default_rng(3)
    for n in (70, 71, 500, 4000):
        raw = bytes(rng.integers(97, 100, n).astype(np.uint8))
        whole = anchors(raw, 70, 8)
        for block in (1, 7, 64):
            assert all((a == b).all() for a, b in zip(whole, anchors(raw, 70, 8, block)))


def test_clashing_names(spark, small, tmp_path):
    some = small.where("doc_id < 40").selectExpr("doc_id", "text", "1 AS _row", "2 AS _bytes", "3 AS _sha", "4 AS N_BYTES", "5 AS n_bytes_in", "6 AS kept_text", "7 AS _n", "8 AS _keep", "9 AS _keep_len", "10 AS _id", "11 AS kept", "12 AS KEEP_ID")
    some.write.parquet(f"{tmp_path}/some")
    some = spark.read.parquet(f"{tmp_path}/some")
    plain = some.select("doc_id", "text")
    for mark, drop, new in ((repeated_passages, drop_repeated_passages, ("n_bytes", "n_removed", "n_spans", "kept_sha256")), (mark_exact_copies, drop_exact_copies, ("keep_id", "group_size", "kept", "text_sha256"))):
        got, want = mark(some), mark(plain)
        assert sorted(got.select("doc_id", *new).collect()) == sorted(want.select("doc_id", *new).collect())
        left = drop(some)
        assert left.columns == some.columns
        assert {tuple(r)[2:] for r in left.collect()} == {tuple(range(1, 13))}
    left = drop_near_duplicates(some)
    assert left.columns == some.columns and left.count() == drop_near_duplicates(plain).count()


def test_no_rows(nothing):
    assert mark_exact_copies(nothing).count() == drop_exact_copies(nothing).count() == 0
    assert near_duplicates(nothing).count() == drop_near_duplicates(nothing).count() == 0
    assert repeated_passages(nothing).count() == 0


def test_frames_that_are_no_table(spark):
    """Shuffled rows are in other places in each reading, and adaptive plans split them in other ways."""
    from tidemark.llm.quality import keep_good, score_quality

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        moved = docs.repartition("doc_id").join(docs.select("doc_id").distinct(), "doc_id")
        for make in (mark_exact_copies, drop_exact_copies, repeated_passages, lambda df: score_quality(df, labels).drop("score", "evidence"), lambda df: keep_good(df, labels)):
            got, want = make(moved), make(docs)
            assert got.count() == want.count() > 0
            if make in (mark_exact_copies, repeated_passages):
                columns = [c for c in want.columns if c not in ("row", "number")]
                assert got.select(columns).exceptAll(want.select(columns)).isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
