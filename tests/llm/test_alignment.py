"""Cross-tokenizer alignment against a plain walk over both libraries' tokens of whole texts."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest

from tidemark.llm.alignment import Alignment, align_documents, lockstep, units_of

tokenizers = pytest.importorskip("tokenizers")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def brute(rows):
    import public_tokenizers
    import sentencepiece

    a_lib = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    a_lib.encode_special_tokens = True
    b_lib, letters = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model"))), byte_letters()
    found = []
    for ident, text in rows:
        groups = []
        if text:
            want = f" {text}".encode()
            a = [(k, bytes(letters[c] for c in a_lib.id_to_token(k))) for k in a_lib.encode(f" {text}", add_special_tokens=False).ids]
            b = [(k, bytes([int(b_lib.id_to_piece(k)[3:5], 16)]) if b_lib.is_byte(k) else b_lib.id_to_piece(k).replace("▁", " ").encode()) for k in b_lib.encode(text)]
            if b"".join(x for _, x in a) == want == b"".join(x for _, x in b):
                ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
                cuts, sides = sorted(ends[0] & ends[1]), []
                for side in (a, b):
                    place, out = 0, [[] for _ in cuts]
                    for k, x in side:
                        place += len(x)
                        out[bisect_left(cuts, place)].append(k)
                    sides.append(out)
                groups = list(zip(*sides))
        found.append((ident, groups))
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for _, groups in found]
    count = Counter(p for held in links for p in held)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (ident, groups), held in zip(found, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((ident, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(held.values()),
                    sum(n for (x, y), n in held.items() if count[x, y] == best[x]), sum(n * count[p] for p, n in held.items()),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out, count


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[7])
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("chunk_bytes,lane_tokens", [(4 << 20, 256), (3000, 7)])
@pytest.mark.parametrize("name", ["small", "edges"])
def test_documents(request, name, chunk_bytes, lane_tokens):
    df = request.getfixturevalue(name)
    want, count = brute(df.select("doc_id", "text").collect())
    made = Alignment(df, chunk_bytes=chunk_bytes, lane_tokens=lane_tokens)
    same(made.documents().collect(), want)
    assert {(r.a_id, r.b_id): r.n_docs for r in made.pairs().collect()} == dict(count)


ODD = ["  two  blanks ", " \n", "a\n\n b \t c", "a  b　c", "dash–dash 中文字 \U0001f600\U0001f600 é", "mark ▁ here", "<0x0A> <s> </s> <unk>", "<|endoftext|> tail <|endoftext|>",
       "\u0001\u001f \u001e x\u001c y", "1234567 89 0.5%", "it's we'll 'd I'M", "﻿bom �", "x" * 3000, "  wide   line", "\r\n\r\n", "a  b   c    d\t\te", "café naïve Å ﬁ ½", " ", "\u0000nul \u0000 x"]


def test_white_space_marks_and_scripts(spark):
    rows = list(enumerate(ODD)) + [(7, None), (None, "no id"), (7, ""), (0, ODD[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(align_documents(df, lane_tokens=2).collect(), brute(rows)[0])
    texts = align_documents(df, as_text=True).collect()
    assert {hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "" for r in texts} == {w[7] for w in brute(rows)[0]}


def test_new_words_of_texts_with_and_without_other_white_space(spark):
    """Units that a chunk meets for the first time in both kinds of texts are stored once, so later units keep their tokens."""
    rows = [(0, "quixolent brambulous fennigrade words"), (1, "so  wide brambulous fennigrade\n end"), (2, "then skorvative tumblequist ends"), (3, "\t see skorvative tumblequist ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    same(align_documents(df).collect(), brute(rows)[0])


def test_units_give_the_text_back():
    for text in ODD:
        assert " ".join(units_of(text)) == text


def test_lockstep_on_random_ends():
    rng = np.random.default_rng(3)
    a, b, from_a, to_a, from_b, want = [], [], [], [], [], set()
    for lane in range(60):
        last = int(rng.integers(1, 40))
        ends = [sorted({*rng.integers(1, last + 1, rng.integers(0, 30)).tolist(), last}) for _ in range(2)]
        from_a.append(len(a)), from_b.append(len(b))
        begin = (len(a), len(b))
        for cut in sorted(set(ends[0]) & set(ends[1])):
            stop = tuple(first + sum(e <= cut for e in side) for first, side in zip((from_a[-1], from_b[-1]), ends))
            want.add((lane, begin[0], stop[0], begin[1], stop[1]))
            begin = stop
        a += ends[0]
        b += ends[1]
        to_a.append(len(a))
    got = {row for step in lockstep(*map(np.array, (a, b, from_a, to_a, from_b))) for row in zip(*(x.tolist() for x in step))}
    assert got == want


def test_no_rows(nothing):
    assert align_documents(nothing).count() == 0
