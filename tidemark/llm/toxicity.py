"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Text is compressed in a form in which each letter stands for its word's beginning up to it (two bytes of a hash of it).
So a match is a run of words or beginnings of words, never the inside of another word, and an unknown word costs its
full length.  Both dictionaries hold the same ordinary text; the toxic one ends with the words and stems typical of
toxic documents, the ordinary one with as much ordinary text.  A window of a toxic document compresses shorter with the
toxic dictionary, and as all else is equal the difference of the two lengths is about that alone.  A word is typical if
it follows many different words in toxic documents and, in proportion, hardly any in ordinary ones; counting the words
before it makes copies of one document count once.  The thresholds on a document's differences are calibrated on
labelled documents that the dictionaries have not seen, by a regression on its highest differences and the numbers
above fixed lengths.

Learning uses at most ``per_class`` labelled documents of each class outside the held-out fold, and about eight windows
spread over each of the ordinary ones for the common base; scores are of all windows of all texts.

Defined cases: a null or empty text is one empty window and gets the score that the calibration gives it; without
labels of both classes every score is the share of toxic labels (0 without labels); a null id is not held out, and its
held_out is false; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._learn import Logistic, fit, labelled_sample
from ._shared import Scratch, fold_of, text_of
from .shingles import inverse, mix, powers, prefix_hashes

WINDOW, LEVEL, SIZE, UNIT = 96, 9, 65536, 2
STEMS = range(4, 8)
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def coded(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(UNIT bytes for each letter, number of letters before each word and in all) of a lower-cased text."""
    codes = np.frombuffer(raw.translate(_WORDS), np.uint8)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = codes != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, size = edges[::2], edges[1::2] - edges[::2]
    ends = np.concatenate(([0], np.cumsum(size)))
    if not len(begin):
        return np.empty((0, UNIT), np.uint8), ends
    sums = prefix_hashes(codes)
    start = np.repeat(begin, size)
    at = np.arange(len(start)) - np.repeat(ends[:-1], size) + start
    stems = mix((sums[at + 1] - sums[start]) * powers(inverse(), len(codes) + 1)[start])
    return np.ascontiguousarray(stems.view(np.uint8).reshape(-1, 8)[:, :UNIT]), ends


def windows(text: str) -> list[bytes]:
    """The coded text, cut before the first word after each WINDOW letters."""
    letters, ends = coded(text.lower().encode("utf-8", "replace"))
    if not len(letters):
        return [b""]
    cuts = np.unique(ends[np.searchsorted(ends, np.arange(0, ends[-1], WINDOW))]).tolist()
    cuts = cuts if cuts[-1] == ends[-1] else [*cuts, int(ends[-1])]
    return [letters[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=8)
def compressor(content: bytes):
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=256, dict_size=len(content), min_match=6, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress


def features(text: str, toxic: bytes, ordinary: bytes) -> np.ndarray:
    short, long = compressor(toxic), compressor(ordinary)
    gain = np.array([len(long(w)) - len(short(w)) for w in windows(text)], float)
    gain[::-1].sort()
    above = [(gain >= k).sum() for k in range(1, 11)]
    return np.array([gain[0], gain[:3].mean(), gain[: max(1, len(gain) // 10)].mean(), gain.mean(), *(10 * np.array(above) / len(gain)), *np.log1p(above), np.log(len(gain))])


def _phrases(sample: DataFrame, most: int, least: int, ratio: float) -> list[str]:
    """Words and stems that follow many different words in toxic documents and few in ordinary ones, most typical last."""
    words = F.filter(F.split(F.lower("text"), BREAKS), lambda w: F.length(w) > 0)
    pairs = sample.select("y", words.alias("w")).select("y", F.explode(F.arrays_zip(F.col("w"), F.concat(F.array(F.lit("")), "w").alias("before"))).alias("e"))
    seen = pairs.select("y", F.col("e.w").alias("w"), F.col("e.before").alias("b")).where("w IS NOT NULL").distinct()
    stems = F.array_compact(F.array(F.when(F.length("w") > 1, F.col("w")), *[F.when(F.length("w") > k, F.substring("w", 1, k)) for k in STEMS]))
    counts = seen.select("y", "b", F.explode(stems).alias("w")).distinct().groupBy("w").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("plain"))
    total = counts.agg(F.sum("toxic"), F.sum("plain")).first()
    if not total[0] or not total[1]:
        return []
    rate = (F.col("toxic") + 0.5) / total[0] / ((F.col("plain") + 0.5) / total[1])
    top = counts.where((F.col("toxic") >= least) & (rate >= ratio)).orderBy((rate * F.sqrt("toxic")).desc(), "w").limit(most).collect()
    return [r.w for r in top[::-1]]


def learn(df: DataFrame, labels: DataFrame, per_class: tuple[int, int] = (6000, 1500), id_col: str = "doc_id", text_col: str = "text",
          label: str = "toxic", folds: int = 4, held_out: int = 2):
    """(toxic dictionary, ordinary dictionary, calibration)."""
    scratch = Scratch(df.sparkSession)
    picked, counts = labelled_sample(df, labels, label, per_class, folds, held_out, id_col, text_col)
    sample = scratch.put(picked.withColumn("role", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(3))), "sample")
    phrases = _phrases(sample.where("role < 2"), 4000, 5, 15.0)

    def some(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            cut = [w[:: max(1, len(w) // 8)] for w in (windows(t.as_py()) for t in batch.column(1))]
            ids = [i for i, w in zip(batch.column(0).to_pylist(), cut) for _ in w]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x for w in cut for x in w], pa.binary())], ["id", "w"])

    plain = sample.where("role < 2 AND y = 0").select("id", "text").mapInArrow(some, "id long, w binary")
    tail = b"".join(coded(w.encode())[0].tobytes() for w in phrases)[-SIZE // 4 :]
    need = SIZE // WINDOW + 1
    text = b"".join(r.w for r in plain.distinct().orderBy(F.xxhash64("w"), "w").limit(need).collect())
    base = text[: SIZE - len(tail)]
    toxic, ordinary = base + tail, base + base[-len(tail) :] if tail else base

    def measure(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = [features(t.as_py(), toxic, ordinary).tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    seen = sample.where("role = 2").select("text", "y").repartition(8).mapInArrow(measure, "x array<double>, y int").collect()
    scratch.drop()
    x, y = np.array([r.x for r in seen], float).reshape(len(seen), -1 if seen else 0), np.array([r.y for r in seen])
    order = np.lexsort((*x.T, y)) if len(y) else []
    return toxic, ordinary, fit(x[order], y[order], counts) if len(y) else fit(x, y, counts)


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3,
                   folds: int = 4, held_out: int = 2, **params) -> DataFrame:
    """doc_id, held_out, score and predicted for each document."""
    toxic, ordinary, model = learn(df, labels, id_col=id_col, text_col=text_col, folds=folds, held_out=held_out, **params)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if isinstance(model, Logistic):
                x = [features(t.as_py(), toxic, ordinary) for t in batch.column(2)]
                scores = 1 / (1 + np.exp(-model.logit(np.array(x)))) if x else np.empty(0)
            else:
                scores = np.full(batch.num_rows, float(model))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold_of(id_col, folds) == held_out, F.lit(False))
    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held.alias("held_out"), text_of(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
