"""Learned operators: held-out accuracy, and their defined cases."""

from __future__ import annotations

import zlib

import pytest

from tidemark.llm import language, quality, toxicity

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_toxicity_held_out(tables):
    docs, labels = tables
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    recall = sum(p for p, y in held if y) / sum(y for _, y in held)
    false = sum(p for p, y in held if not y) / sum(1 - y for _, y in held)
    assert recall > 0.85 and false < 0.03, (recall, false)


def test_quality_held_out(tables):
    docs, labels = tables
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).select("doc_id", "score", "accepted").collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id].accepted, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    kept = sum(a for a, y in held if y) / sum(y for _, y in held)
    caught = sum(not a for a, y in held if not y) / sum(1 - y for _, y in held)
    assert kept > 0.98 and caught > 0.9, (kept, caught)


def test_site_rates_by_hand(spark):
    import math
    import random

    rng = random.Random(2)
    rows = [(h, f"{h}/{p}", rng.gauss(0.3 * ord(h) - 30, 2)) for h, p in ((rng.choice("abcdefg"), rng.randrange(4)) for _ in range(500))]
    share, sig = 0.7, lambda x: 1 / (1 + math.exp(-x))
    prior, n, good, hn, hgood = math.log(share / (1 - share)), {}, {}, {}, {}
    for h, p, e in rows:
        n[h, p], good[h, p] = n.get((h, p), 0) + 1, good.get((h, p), 0) + sig(e + prior)
        hn[h], hgood[h] = hn.get(h, 0) + 1, hgood.get(h, 0) + sig(e + prior)
    top = sum(hgood.values()) / sum(hn.values())

    def strength(items):  # of (rows, rate, the level above)
        total = sum(k for k, _, _ in items)
        spread, noise = sum(k * (r - a) ** 2 for k, r, a in items) / total, sum(a * (1 - a) for _, _, a in items) / total
        return min(1e4, max(1.0, sum(k * a * (1 - a) for k, _, a in items) / total / max(spread - noise, 1e-6) - 1))

    a = strength([(hn[h], hgood[h] / hn[h], top) for h in hn])
    host = {h: (hgood[h] + a * top) / (hn[h] + a) for h in hn}
    b = strength([(n[k], good[k] / n[k], host[k[0]]) for k in n])
    got = {(r.host, r.path): (r.host_rate, r.path_rate) for r in quality.site_rates(spark.createDataFrame(rows, "host string, path string, evidence double"), share).collect()}
    assert set(got) == set(n)
    for k, (hr, pr) in got.items():
        assert hr == pytest.approx(host[k[0]], abs=1e-9) and pr == pytest.approx((good[k] + b * host[k[0]]) / (n[k] + b), abs=1e-9)


def test_quality_with_clashing_names(spark, small, tmp_path):
    small.selectExpr("doc_id", "text", "source", "1 AS HOST", "2 AS _row", "3 AS score", "4 AS accepted_in").write.parquet(f"{tmp_path}/some")
    some, labels = spark.read.parquet(f"{tmp_path}/some"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = {r.doc_id: r.accepted for r in quality.score_quality(some, labels).select("doc_id", "accepted").collect()}
    plain = {r.doc_id: r.accepted for r in quality.score_quality(small, labels).select("doc_id", "accepted").collect()}
    assert scored == plain
    kept = quality.keep_good(some, labels)
    assert kept.columns == some.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, a in plain.items() if a}
    assert {tuple(r)[3:] for r in kept.collect()} == {(1, 2, 3, 4)}


def test_language_held_out(tables):
    docs, _ = tables
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    rows = [(got[r.doc_id].lang_pred, r.lang) for r in docs.select("doc_id", "lang").collect() if got[r.doc_id].held_out]
    assert len(rows) > 1000 and sum(a == b for a, b in rows) / len(rows) > 0.99


def test_spans_are_the_best_path(tables):
    import itertools

    import numpy as np

    model = language.learn(tables[0].where("doc_id < 3000"), per_language=100)
    rng = np.random.default_rng(4)
    for _ in range(200):
        scores = rng.normal(0, 6, (rng.integers(1, 6), 3))
        begin, lang = model.spans(scores, 5.0)
        path = np.repeat(lang, np.diff([*begin, len(scores)]))
        value = lambda p: sum(scores[t, k] for t, k in enumerate(p)) - 5.0 * sum(a != b for a, b in zip(p, p[1:]))
        assert value(path) == pytest.approx(max(map(value, itertools.product(range(3), repeat=len(scores)))))
    mixed = "the rest of the story was told and that is what they wanted. " * 6 + "der Hund und die Katze sind nicht in dem Haus gewesen. " * 6
    begin, lang = model.spans(model.words(mixed.encode())[0])
    assert [model.names[k] for k in lang] == ["en", "de"]


def test_defined_cases(edges, nothing, spark):
    labels = spark.createDataFrame([(4, 0, 1), (5, 1, 0), (7, 1, 0), (99, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    n = edges.count()
    for df, want in ((edges, n), (nothing, 0)):
        for lab in (labels, none):
            assert toxicity.score_toxicity(df, lab).count() == want
            scored = quality.score_quality(df, lab)
            assert scored.count() == want and set(df.columns) - {"kept"} <= set(scored.columns)
            assert quality.keep_good(df, lab).columns == df.columns
        assert language.identify(df).count() == want
    assert quality.score_quality(edges, none).where("NOT accepted").count() == 0
    got = {(r.doc_id, r.lang_pred) for r in language.identify(edges).collect()}
    assert {(0, "und"), (1, "und"), (2, "und")} <= got and (3, "und") not in got
    assert {r.lang_pred for r in language.identify(edges.drop("lang").selectExpr("*", "cast(null AS string) AS lang")).collect()} == {"und"}
