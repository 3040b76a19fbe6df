"""Language identification: script ranges narrow the candidates, Viterbi over word scores labels the spans.

Each word is scored for each language by hashed byte trigrams, counted in training texts.  Languages whose training
texts hardly use the word's scripts are no candidates for it.  A Viterbi path over the words with a penalty for each
switch gives spans of one language; a text's language is the one whose spans have most letters.  Texts where no run of
words favours another language by half a penalty have one span, which is then the best path, so the word-by-word fold
runs only for texts that may be mixed.

Learning uses about ``per_language`` texts of each language with ids outside the held-out fold (picked by a hash of the
id, so the same ones every time), of every language there is; ``languages`` of them are counted at a time.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is every text if nothing could be
learned; a null id is not held out and its rows are not learned from; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fold_of, text_of

BINS, BLOCK = 1 << 16, 1 << 20
SWITCH = 12.0
FOREIGN = -30.0

#: Script of a character by its UTF-8 lead byte; the three-byte leads E0 to E3 are told apart by the second byte.
_SCRIPTS = np.zeros((256, 256), np.uint16)


def _script(bit: int, lead: range, second: range = range(256)) -> None:
    _SCRIPTS[lead.start : lead.stop, second.start : second.stop] = 1 << bit


for _lead in (range(0x41, 0x5B), range(0x61, 0x7B), range(0xC3, 0xCA)):
    _script(0, _lead)  # Latin
_script(1, range(0xCD, 0xD0))  # Greek
_script(2, range(0xD0, 0xD4))  # Cyrillic
_script(3, range(0xD4, 0xD7))  # Armenian
_script(4, range(0xD6, 0xD8), range(0x90, 0xC0))  # Hebrew
_script(5, range(0xD8, 0xDC))  # Arabic
_script(6, range(0xE0, 0xE1), range(0xA4, 0xA8))  # Devanagari, Bengali
_script(7, range(0xE0, 0xE1), range(0xA8, 0xB8))  # southern Indic
_script(8, range(0xE0, 0xE1), range(0xB8, 0xC0))  # Thai, Lao, Tibetan
_script(9, range(0xE1, 0xE2))  # Georgian, Ethiopic, Khmer
_script(10, range(0xE3, 0xE4), range(0x81, 0x84))  # kana
_script(11, range(0xE3, 0xEA))  # Han
_script(10, range(0xE3, 0xE4), range(0x81, 0x84))
_script(12, range(0xEA, 0xEE))  # Hangul

_BREAK = np.array([not (chr(b).isalpha() or b >= 128 or b == 39) for b in range(256)])


def _scan(raw: bytes, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of a text: (trigram bins at each byte, begin and end of the words, scripts of the words)."""
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > block:
            end = raw.rfind(b" ", at, at + block) + 1 or at + block
        codes = np.frombuffer(b" " + raw[at:end] + b"  ", np.uint8)
        at = end
        blank = _BREAK[codes]
        codes = np.where(blank, np.uint8(32), codes).astype(np.uint32)
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        begin, stop = edges[::2], edges[1::2]
        if not len(begin):
            continue
        grams = ((codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]) * np.uint32(2654435761)) >> np.uint32(16)
        script = _SCRIPTS[codes[:-1], codes[1:]]
        yield grams, begin, stop, np.bitwise_or.reduceat(np.where(blank[:-1], np.uint16(0), script), begin)


class Model:
    def __init__(self, names: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.names = names
        smooth = 0.5
        self.table = np.log((grams.T + smooth) / (grams.sum(1) + smooth * BINS)).astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(1, keepdims=True))
        self.uses = ((share >= 0.01) << np.arange(16)).sum(1).astype(np.uint16)

    def words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(scores of each word and language, bytes of each word)."""
        scores, sizes = [np.empty((0, len(self.names)))], [np.empty(0, np.int64)]
        # the sums of a block have a row for each byte and a column for each language: 64 MB at most
        for grams, begin, stop, script in _scan(raw, min(BLOCK, max(1 << 12, (1 << 23) // max(1, len(self.names))))):
            sums = np.zeros((len(grams) + 1, len(self.names)))
            np.cumsum(self.table[grams], 0, out=sums[1:])
            score = sums[stop - 1] - sums[begin - 1]
            foreign = (script[:, None] & ~self.uses[None, :]) != 0
            foreign[foreign.all(1)] = False
            scores.append(score + FOREIGN * foreign)
            sizes.append(stop - begin)
        return np.concatenate(scores), np.concatenate(sizes)

    def spans(self, scores: np.ndarray, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray]:
        """(first word, language) of each span on the best path."""
        best = int(scores.sum(0).argmax())
        ahead = np.cumsum(scores - scores[:, [best]], 0)
        low = np.minimum.accumulate(np.vstack([np.zeros(scores.shape[1]), ahead[:-1]]), 0)
        if (ahead - low).max() <= switch / 2:
            return np.array([0]), np.array([best])
        k = scores.shape[1]
        value, back = scores[0].tolist(), np.empty(scores.shape, np.int16)
        for t, row in enumerate(scores.tolist()):
            if not t:
                continue
            top = max(value)
            come, fall = value.index(top), top - switch
            for j in range(k):
                if value[j] >= fall:
                    back[t, j] = j
                    row[j] += value[j]
                else:
                    back[t, j] = come
                    row[j] += fall
            value = row
        path = np.empty(len(scores), np.int64)
        path[-1] = int(np.argmax(value))
        for t in range(len(scores) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        begin = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
        return begin, path[begin]

    def label(self, text: str) -> tuple[str, float, int]:
        """(language, share of its letters, number of spans)."""
        raw = text.lower().encode("utf-8", "replace")
        if not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0, 0
        scores, sizes = self.words(raw)
        if not len(scores):
            return "und", 0.0, 0
        begin, lang = self.spans(scores)
        letters = np.bincount(lang, np.add.reduceat(sizes, begin), len(self.names))
        top = int(letters.argmax())
        return self.names[top], float(letters[top] / letters.sum()), len(begin)


def learn(df: DataFrame, per_language: int = 1500, languages: int = 256, folds: int = 3, held_out: int = 1, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> Model:
    seen = df.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"), F.col(f"`{lang_col}`").alias("lang")).where(F.col("lang").isNotNull() & (fold_of("id", folds) != held_out))
    counts = seen.groupBy("lang").count().collect()
    names = sorted(r.lang for r in counts)
    if not names:
        return Model([], np.zeros((0, BINS)), np.zeros((0, 16)))
    parts = 1 << 20
    rows = [(r.lang, names.index(r.lang), min(parts, int(1.2 * per_language * parts / r["count"]) + 1)) for r in counts]
    share = df.sparkSession.createDataFrame(rows, "lang string, k int, share int")
    picked = seen.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("id"), F.lit(parts)) < F.col("share"))

    def count(batches: Iterator[pa.RecordBatch], begin: int, size: int):
        grams, scripts = np.zeros((size, BINS), np.int64), np.zeros((size, 16), np.int64)
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for found, first, stop, script in _scan(text.as_py().lower().encode("utf-8", "replace")):
                    inside = np.zeros(len(found) + 1, np.int8)
                    np.add.at(inside, first - 1, 1)
                    np.add.at(inside, stop - 1, -1)
                    grams[k - begin] += np.bincount(found[np.cumsum(inside[:-1]) > 0], minlength=BINS)
                    scripts[k - begin] += ((script[:, None] >> np.arange(16)) & 1).sum(0)
        rows = [k for k in range(size) if grams[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array([begin + k for k in rows], pa.int32()), pa.array([grams[k].astype(np.int32).tobytes() for k in rows], pa.binary()), pa.array([scripts[k].tobytes() for k in rows], pa.binary())], ["k", "grams", "scripts"])

    grams, scripts = np.zeros((len(names), BINS)), np.zeros((len(names), 16))
    # a batch's sample is bounded, so are the tasks that count it
    for begin in range(0, len(names), languages):
        size = min(languages, len(names) - begin)
        some = picked.where((F.col("k") >= begin) & (F.col("k") < begin + size)).select("k", "text").repartition(8)
        for r in some.mapInArrow(partial(count, begin=begin, size=size), "k int, grams binary, scripts binary").toLocalIterator():
            grams[r.k] += np.frombuffer(r.grams, np.int32)
            scripts[r.k] += np.frombuffer(r.scripts, np.int64)
    return Model(names, grams, scripts)


def identify(df: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_out: int = 1, **params) -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_spans for each document."""
    model = model or learn(df, folds=folds, held_out=held_out, id_col=id_col, text_col=text_col, **params)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [model.label(t.as_py()) for t in batch.column(2)]
            lang, score, spans = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.int32())], ["doc_id", "held_out", "lang_pred", "score", "n_spans"])

    held = F.coalesce(fold_of(id_col, folds) == held_out, F.lit(False))
    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held.alias("held_out"), text_of(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_spans int")


def language_spans(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, span, first_word, n_words, lang): the spans of each text that has words."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = [[], [], [], [], []]
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                scores, _ = model.words(text.as_py().lower().encode("utf-8", "replace"))
                if not len(scores) or not model.names:
                    continue
                begin, lang = model.spans(scores)
                for n, (a, b, k) in enumerate(zip(begin, [*begin[1:], len(scores)], lang)):
                    for column, value in zip(rows, (ident, n, int(a), int(b - a), model.names[k])):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["doc_id", "span", "first_word", "n_words", "lang"])

    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, span int, first_word long, n_words long, lang string")
