"""Longest matches against trying every string at every place."""

from __future__ import annotations

import random

import pytest

from tidemark.operators.convert import convert_text, inverted, longest_match


def brute(text, table):
    out, k = "", 0
    while k < len(text):
        found = max((s for s in table if text.startswith(s, k)), key=len, default=None)
        out += text[k] if found is None else table[found]
        k += len(found or "x")
    return out


def test_longest_match():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab后後里[]^-\\") for _ in range(n))
    for _ in range(300):
        table = {word(rng.randrange(1, 5)): word(rng.randrange(0, 4)) for _ in range(rng.randrange(0, 9))}
        text = word(rng.randrange(0, 60))
        assert longest_match(table)(text) == brute(text, table)


def test_frames(spark):
    table = spark.createDataFrame([("後", "后"), ("裡", "里"), ("皇后", "皇后"), ("乾", "干"), ("乾坤", "乾坤"), ("", "x"), (None, "y"), ("刪", None)], "source string, target string")
    df = spark.createDataFrame([(1, "乾坤後裡乾刪"), (2, None), (3, ""), (4, "皇后以後")], "k int, text string")
    assert {r.k: r.text for r in convert_text(df, "text", table).collect()} == {1: "乾坤后里干", 2: None, 3: "", 4: "皇后以后"}
    back = inverted(table)
    assert {r.k: r.o for r in convert_text(convert_text(df, "text", table), "text", back, out="o").collect()}[4] == "皇后以後"
    assert convert_text(df.limit(0), "text", table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        convert_text(df, "text", table.union(spark.createDataFrame([("後", "z")], table.schema)))
    with pytest.raises(ValueError):
        convert_text(df, "text", table, most=2)
