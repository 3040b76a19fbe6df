"""Separator scan against a plain split."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.llm.token_files import document_token_counts, read_token_files, scan_blocks, token_stream


@pytest.mark.parametrize("block_bytes", [2, 6, 4096])
def test_raw_files(spark, tmp_path, block_bytes):
    rng = np.random.default_rng(1)
    want = set()
    for f, n in enumerate((0, 1, 50, 999)):
        ids = rng.integers(0, 5, n).astype("<u2")
        (tmp_path / f"f{f}.bin").write_bytes(ids.tobytes())
        at, doc = 0, 0
        for k, i in enumerate(ids.tolist()):
            if i == 3:
                want.add((f, doc, at, k + 1 - at, True))
                at, doc = k + 1, doc + 1
        if at < n:
            want.add((f, doc, at, n - at, False))
    got = scan_blocks(read_token_files(spark, str(tmp_path), block_bytes), 3).collect()
    assert {(int(r.file[-5]), r.doc, r.start, r.n_tokens, r.closed) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("name", ["small", "edges", "nothing"])
def test_documents(request, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    df = request.getfixturevalue(name)
    made = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    made.encode_special_tokens = True
    key = lambda t: (t[0] is None, t)
    want = sorted(((r.doc_id, len(made.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in df.collect()), key=key)
    for block_ids in (7, 1 << 16) if name == "edges" else (1 << 16,):
        got = sorted(((r.doc_id, r.n_tokens) for r in document_token_counts(df, block_ids=block_ids).collect()), key=key)
        assert got == want


def test_an_id_too_large_is_an_error(small):
    from pyspark.errors import PythonException

    with pytest.raises(PythonException, match="does not fit"):
        token_stream(small.limit(3), 70000).count()
    assert document_token_counts(small, 70000, dtype="<u4").count() == small.count()
