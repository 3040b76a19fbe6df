"""Lattice encoding against the library, and Viterbi against all paths."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import pieces as P
from tidemark.llm.tokens import public


def test_units_join_to_the_text():
    path = public("piece_bpe_32k.model")
    for text in ("", " ", "a  b", "x\ny\t z", "▁ odd", "é ü"):
        assert "".join(P.units(text, path)) == (P.BLANK + text.replace(" ", P.BLANK) if text else "")


@pytest.mark.parametrize("name", ["small", "edges", "nothing"])
def test_documents(request, name):
    df = request.getfixturevalue(name).select("doc_id", "text")
    if name == "edges":
        odd = ["", " ", "  a", "a  b", "\n", "▁a", "a▁ b", "<s> x </s>", "é<0x0A>", "ﬁ Å 漢字 😀", "\ta", "a ", "a" * 300, "q" * 70 + " b" * 9, "x\0y", ");\r\n"]
        df = df.unionByName(df.sparkSession.createDataFrame([(1000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    sp = P.processor(public("piece_bpe_32k.model"))
    key = lambda t: (t[0] is None, t)
    want = sorted(((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in df.collect() for ids in [sp.encode(r.text or "")]), key=key)
    got = P.document_pieces(df, chunk_bytes=3000).collect()
    assert sorted(((r.doc_id, r.n_ids, r.ids_crc32) for r in got), key=key) == want
    assert all(r.round_trip for r in got if r.doc_id not in (1005, 1006))
    if name == "small":
        back = {r.doc_id: r.text for r in P.decode_documents(P.encode_documents(df)).collect()}
        assert back == {r.doc_id: r.text for r in df.collect()}


def test_units_are_cut_where_no_piece_joins_and_encoded_once_over_chunks(spark):
    """Words with and without punctuation share a unit, in all chunks; units of the greatest length are folded too."""
    path = public("piece_bpe_32k.model")
    assert P.units("word word%%% word", path).count("▁word") == 3
    sp, rng = P.processor(path), random.Random(5)
    words = ["theand", "ofthe.", "&&&", "naïve,", "x" * 60, "ab" * 31, "中文", "été%%%", "", "a\n", "▁b", "\u0000", "it's", "10,000", "=====", "\t"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for k in range(200)]
    want = {k: sp.encode(t) for k, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size in (500, 8 << 20):
        assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in P.encode_documents(df, chunk_bytes=size, buckets=7).collect()} == want


def test_viterbi(spark):
    rng, rows, want = random.Random(1), [], {}
    for k in range(40):
        n = rng.randint(1, 7)
        edges = {(b, e): round(rng.uniform(-9, 0), 3) for b in range(n) for e in range(b + 1, n + 1) if rng.random() < 0.5}
        rows.append((k, n, [(b, e, 1, s) for (b, e), s in edges.items()]))
        best = {0: 0.0}
        for e in range(1, n + 1):
            best[e] = max(best[b] + max(edges.get((b, e), -1e9), -20.0 if e == b + 1 else -1e9) for b in range(e))
        want[k] = best[n]
    df = spark.createDataFrame(rows, "k int, n int, edges array<struct<b: int, e: int, id: int, score: double>>")
    for r in df.withColumn("path", P.fold_viterbi(F.col("n"), F.col("edges"), -20.0)).collect():
        have = {(x.b, x.e): x.score for x in r.edges}
        steps = list(zip(r.path, r.path[1:]))
        assert sum(max(have.get(s, -1e9), -20.0 if s[1] == s[0] + 1 else -1e9) for s in steps) == pytest.approx(want[r.k])
