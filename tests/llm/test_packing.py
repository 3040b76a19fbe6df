"""Packing: every id of every document, once, in its place."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm.packing import pack_documents

tokenizers = pytest.importorskip("tokenizers")


@pytest.mark.parametrize("name", ["small", "edges"])
def test_pieces_and_places(request, name):
    import public_tokenizers

    df = request.getfixturevalue(name)
    made = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want, lengths = [], []
    for r in df.select("doc_id", "text").collect():
        ids = np.array(made.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        for k, stop in enumerate(range(first, len(ids) + 1, 1024)):
            begin = max(0, stop - 1024) if k else 0
            want.append((r.doc_id, k, begin, stop - begin, zlib.crc32(ids[begin:stop].tobytes())))
            lengths.append(stop - begin)
    got = pack_documents(df).collect()
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(n for _, n in places) <= 1024
    assert len(filled) <= max(-(-sum(lengths) // 1024) * 1.02 + 2, sum(n > 512 for n in lengths) * 1.02 + 2)


def test_no_rows(nothing):
    assert pack_documents(nothing).count() == 0
