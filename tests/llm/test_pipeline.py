"""Each stage of the pipeline on its own input against brute force, and the whole run."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from test_dedup import removed

corpus_pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"


def five(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        assert after.keys() <= before.keys()
        seen[name] = (before, after)

    before, after = seen["exact dedup"]
    groups = defaultdict(list)
    for d, r in before.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text)].append((-len(r.text), d))
    assert set(after) == {min(g)[1] for g in groups.values()}

    before, after = seen["near dedup"]
    sets, up = {d: five(r.text) for d, r in before.items()}, {d: d for d in before}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert set(after) == {d for d in ids if root(d) == d}

    before, after = seen["passage dedup"]
    ids = sorted(before)
    for d, (kept, _, _) in zip(ids, removed([before[d].text.encode() for d in ids], 200)):
        assert after[d].text == kept.decode("utf-8", "ignore") and after[d].n_chars == len(after[d].text)

    before, after = seen["quality"]
    bad = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if r.quality == 0}
    good = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if r.quality == 1}
    assert len(good & set(after)) >= 0.95 * len(good) and len(bad & set(after)) <= 0.3 * len(bad)


def test_run_packs_what_the_stages_keep(spark):
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    per = Counter(r.doc_id for r in pieces)
    assert all(sum(1 for r in pieces if r.doc_id == d) == n for d, n in per.items())
    filled = Counter()
    for r in pieces:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024


@pytest.mark.parametrize("name", ["edges", "nothing"])
def test_stages_on_edge_cases(request, spark, tmp_path, name):
    """Nulls, empty and long texts, ties, repeated rows, clashing names and no rows at all pass through every stage."""
    docs = request.getfixturevalue(name)
    columns = docs.columns
    for stage, apply in corpus_pipeline.STAGES:
        before = Counter(r.doc_id for r in docs.collect())
        apply(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{stage}")
        docs = spark.read.parquet(f"{tmp_path}/{stage}")
        after = Counter(r.doc_id for r in docs.collect())
        if stage != "packing":
            assert docs.columns == columns and not after - before
        assert stage not in ("passage dedup", "packing") or set(after) == set(before)


def test_passages_of_over_50_words_go(spark, tmp_path):
    """Planted passages of 51 words are cut from every document that has them; the other documents stay as they are."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    planted = [some(51) for _ in range(4)]
    texts = {k: " ".join([some(60), planted[k % 4], some(80)] if k % 3 else [some(150)]) for k in range(60)}
    rows = [(k, t, "en", "a/b", len(t)) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/docs")
    for r in corpus_pipeline.passages(spark, spark.read.parquet(f"{tmp_path}/docs"), FOLDER).collect():
        if r.doc_id % 3:
            assert planted[r.doc_id % 4][1:-1] not in r.text and len(texts[r.doc_id]) - r.n_chars >= len(planted[r.doc_id % 4])
        else:
            assert r.text == texts[r.doc_id]
