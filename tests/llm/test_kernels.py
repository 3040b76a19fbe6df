"""The vectorised kernels against plain versions of what they compute."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm.near_dedup import band_hashes, sketch
from tidemark.llm.packing import _places, plan_patterns
from tidemark.llm.shingles import mix, shingle_set, word_hashes
from tidemark.llm.suffix_dedup import Columns, _trim, anchors, merge_repeats


@pytest.mark.parametrize("text", [b"", b" ", b"a", b"a b", b"A b\x0bc\td  e f", b"x " * 500, "é ü z w".encode()])
def test_shingles_are_those_of_split(text):
    words = text.lower().split()
    assert len(word_hashes(text)) == len(words)
    want = {tuple(words[i : i + 3]) for i in range(max(len(words) - 2, min(1, len(words))))}
    assert len(shingle_set(text, 3)) == len(want)
    assert np.array_equal(shingle_set(b"  " + text.upper() + b"\n", 3), shingle_set(text, 3)) or not text.isascii()


@pytest.mark.parametrize("n", [1, 2, 7, 300, 5000])
def test_sketch_fills_every_bin_and_estimates(n):
    rng = np.random.default_rng(n)
    base = mix(rng.integers(0, 2**62, 2 * n).astype(np.uint64))
    a, b = sketch(base[:n], 160), sketch(base[n // 4 : n + n // 4], 160)
    assert a.max() < np.iinfo(np.uint64).max
    both = n - n // 4
    want = both / (2 * n - both)
    assert abs((a == b).mean() - want) < 0.2 if n > 100 else True
    assert np.array_equal(a, sketch(base[:n], 160))
    assert len(set(band_hashes(a, 32, 5).tolist())) == 32


def test_windows_have_the_anchor_of_their_own_bytes():
    rng = random.Random(1)
    raw = bytes(rng.choice(b"ab \xc3") for _ in range(900)) + b"z" * 700
    key, place, lo, hi = anchors(raw, 50, 8)
    assert lo[0] == 0 and hi[-1] == len(raw) - 50 and np.array_equal(lo[1:], hi[:-1] + 1)
    of = {}
    for k, p, a, b in zip(key.tolist(), place.tolist(), lo.tolist(), hi.tolist()):
        for s in range(a, b + 1):
            assert of.setdefault(raw[s : s + 50], (k, p - s)) == (k, p - s)


def test_merged_transforms_find_the_repeated_windows():
    rng, length, gram = random.Random(3), 12, 4
    for trial in range(60):
        extents, at, group = [], [], []
        for g in range(rng.randint(1, 4)):
            base = bytes(rng.choice(b"ab") for _ in range(2 * length - gram))
            for _ in range(rng.randint(1, 9)):
                row = bytearray(base)
                for _ in range(rng.randint(0, 3)):
                    row[rng.randrange(len(row))] = rng.choice(b"abc")
                a = rng.randint(0, length - gram)
                extents.append(bytes(row[length - gram - a : length - gram - a + rng.randint(length, length + a)]))
                at.append(a)
                group.append(g)
        table = Columns(extents, np.array(at), np.array(group), length, gram)
        found = merge_repeats(table, np.arange(len(at)) % 2 == 1, length)
        count = Counter((g, a - s, e[s : s + length]) for e, a, g in zip(extents, at, group) for s in range(len(e) - length + 1))
        for r, (e, a, g) in enumerate(zip(extents, at, group)):
            for s in range(len(e) - length + 1):
                assert found[table.lo[r] + s, r] == (count[g, a - s, e[s : s + length]] > 1), trial


def test_trim_merges_touching_spans():
    assert _trim(b"abcdefghij", [(0, 0), (2, 2)], 2) == (b"efghij", 4, 1)
    assert _trim(b"abcdefghij", [(1, 2), (7, 7)], 2) == (b"aefgj", 5, 2)


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_each_piece_once_and_fits(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(65, np.int64)
    for length in rng.integers(1, 65, 400):
        counts[length] += rng.integers(1, 30)
    plan = plan_patterns(counts, 64)
    used = np.zeros_like(counts)
    for pattern, times in plan:
        assert sum(pattern) <= 64 and times > 0
        for length in pattern:
            used[length] += times
    assert np.array_equal(used, counts)
    sizes, least = np.arange(65), 0
    for k in range(33):  # pieces over half a sequence need one each, and room for the small ones beside them
        big, mid, small = sizes > 64 - k, (sizes > 32) & (sizes <= 64 - k), (sizes >= k) & (sizes <= 32)
        room = 64 * counts[mid].sum() - (counts * sizes)[mid].sum()
        least = max(least, counts[big | mid].sum() + max(0, -(-((counts * sizes)[small].sum() - room) // 64)))
    assert least <= sum(t for _, t in plan) <= 1.02 * least + 2
    assert len(_places(plan, 64)) == sum(len(p) for p, _ in plan)
