"""Spelling variants against enumeration of all pairs, and against SQL."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import spelling
from tidemark.llm.spelling import near_words, roots, run_hashes, spelling_forms, word_counts


def brute_counts(rows, shortest=5, least=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= shortest and n >= least}


def apart_one(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_forms(counts):
    near = {w: [x for x in counts if abs(len(x) - len(w)) < 2 and apart_one(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


@pytest.fixture(scope="module")
def varied(spark):
    rng = random.Random(11)
    stems = ["".join(rng.choice("abcdeéÀß") for _ in range(rng.randrange(4, 9))) for _ in range(60)] + ["x" * 3000, "x" * 2999, "Äpfel", "äpfel"]
    rows = []
    for k in range(150):
        words = []
        for _ in range(60):
            w = rng.choice(stems)
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice((w[:at] + w[at + 1 :], w[:at] + rng.choice("abÉ") + w[at + 1 :], w[:at] + "c" + w[at:], w.upper()))
            words.append(w)
        rows.append((k % 140, rng.choice((" ", "-", "3", "\n", "ł")).join(words)))
    rows += [(None, rows[0][1]), (5, None), (None, ""), (7, " 12 ")]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.mark.parametrize("name", ["small", "edges"])
def test_tables(request, name):
    df = request.getfixturevalue(name)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    counts = brute_counts(rows)
    assert {r.word: r.n for r in word_counts(df, chunk_bytes=20_000).collect()} == counts
    if name == "edges":
        assert sorted(tuple(r) for r in spelling_forms(df).collect()) == brute_forms(counts)


@pytest.mark.parametrize("letter_groups", [1, 3, 5])
def test_all_pairs(varied, letter_groups):
    df, rows = varied
    assert sorted(tuple(r) for r in spelling_forms(df, letter_groups=letter_groups).collect()) == brute_forms(brute_counts(rows))


def test_a_block_in_many_parts(spark, varied):
    counts = brute_counts(varied[1])
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = near_words(words, letter_groups=2, part_words=3, part_letters=5000)
    assert Counter(tuple(r) for r in got.collect()) == Counter((a, b, counts[b]) for a in counts for b in counts if abs(len(a) - len(b)) < 2 and apart_one(a, b))


def test_hashes():
    words, ids, rng = ["a", "é", "longer", "x" * 700], ["1", "", "123456789012"], np.random.default_rng(1)
    codes, doc = rng.integers(0, 4, 99), rng.integers(0, 3, 99)
    assert run_hashes(words, codes, doc, ids).tolist() == [zlib.crc32(f"{ids[d]}:{words[c]}".encode()) for c, d in zip(codes, doc)]


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(37)] + [("a", "w5")], "word string, form string")
    assert {r.word: r.root for r in roots(forms).collect()} == {f"w{k}": "w37" for k in range(37)} | {"a": "w37"}


def test_every_code_has_a_class():
    assert len(spelling.LETTERS) == 90 and all(len(c.encode("latin-1")) == 1 for c in spelling.LETTERS)


def test_query_is_the_sql(same_as_sql):
    same_as_sql("op12_spelling_forms")


def test_no_rows(nothing):
    assert spelling_forms(nothing).count() == 0
