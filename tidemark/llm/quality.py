"""Document quality by hierarchical empirical Bayes over sites.

A regression on features of the text gives each document's evidence, the log odds of good against bad beyond the
classes' shares.  Sites are a hierarchy: host, and path under it.  Each level's rate of good documents is its documents'
mean posterior, shrunk towards the level above: hosts towards the global rate, paths towards their host, with prior
strengths estimated from the spread of the rates (method of moments).  A document's posterior adds its path's log odds
to its own evidence, so a site with few documents says what its host or the corpus says, and a clear text always speaks
for itself.

Texts are measured once; what follows reads rows of (place, host, path, evidence).  The sums are grouped aggregations
with partial sums before the shuffle.  Sites are broadcast up to ``broadcast_sites``
rows (counted first); beyond that they are joined by a shuffle on the site.  Learning uses at most ``per_class``
labelled documents of each class outside the held-out fold.

Defined cases: a null or empty text has the evidence of a text of no words; a null source is the site "" ; without
labels of both classes all evidence is 0 and nothing is rejected; an empty table gives an empty table; other columns
pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._learn import Logistic, fit, labelled_sample
from ._shared import Scratch, free_names, numbered, set_aside, text_of
from .shingles import word_hashes

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = _LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_SPACE = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
_MARKS = np.frombuffer(b"!\"#$%&()*+/:;<=>?@[\\]^_{|}~", np.uint8)
_DIGITS = slice(48, 58)
OUT = ("host", "path", "evidence", "host_rate", "path_rate", "score", "accepted")


def features(text: str) -> list[float]:
    """Shares of kinds of characters, repetition of words and lines, lengths."""
    raw = text.encode("utf-8", "replace")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    words = word_hashes(raw)
    m = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marks, letters = int(hist[_MARKS].sum()), max(1, int(hist[_LETTER].sum()))
    pairs = np.unique(words[1:] * np.uint64(3) + words[:-1]) if len(words) > 1 else words
    upper, repeat = hist[_UPPER].sum() / letters, (words[1:] == words[:-1]).sum() / m
    return [
        marks / n, math.log1p(100 * marks / n), int(hist[_DIGITS].sum()) / n, upper, math.log1p(20 * upper), repeat,
        math.log1p(50 * repeat), 1 - len(np.unique(words)) / m, 1 - len(pairs) / m, hist[ord("|")] / m, hist[ord("!")] / m,
        1 - len(set(lines)) / max(1, len(lines)), min(40.0, int(n - hist[_SPACE].sum()) / m), math.log1p(len(words)), letters / n, int((hist[_MARKS] > 0).sum()),
    ]


def site_columns(source: Column) -> tuple[Column, Column]:
    """(host, path): the part before the first slash, after a scheme; and with the first segment after it."""
    bare = F.regexp_replace(F.coalesce(source.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.lower(F.regexp_extract(bare, r"^([^/?#]*)", 1)), F.regexp_extract(bare, r"^([^/?#]*(?:/[^/?#]*)?)", 1)


def learn(df: DataFrame, labels: DataFrame, per_class: tuple[int, int] = (3000, 3000), id_col: str = "doc_id", text_col: str = "text",
          label: str = "quality", folds: int = 4, held_out: int = 2):
    picked, counts = labelled_sample(df, labels, label, per_class, folds, held_out, id_col, text_col)

    def measure(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    seen = picked.select("text", "y").mapInArrow(measure, "x array<double>, y int").collect()
    x, y = np.array([r.x for r in seen], float).reshape(len(seen), -1 if seen else 0), np.array([r.y for r in seen], int)
    order = np.lexsort((*x.T, y)) if len(y) else np.arange(0)
    return fit(x[order], y[order], counts), counts


def _evidence(model, share: float) -> Column:
    base = math.log(share / (1 - share)) if 0 < share < 1 else 0.0

    def run(texts: pd.Series) -> pd.Series:
        if not isinstance(model, Logistic) or not len(texts):
            return pd.Series(np.zeros(len(texts)))
        return pd.Series(np.clip(model.logit(np.array([features(t) for t in texts])) - base, -12, 12))

    return F.pandas_udf(run, T.DoubleType())


def _strength(n: Column, rate: Column, above: Column) -> Column:
    """Prior strength of a level: the Beta sample size whose spread is what the rates show beyond sampling noise."""
    spread = F.sum(n * (rate - above) ** 2) / F.sum(n)
    noise = F.sum(above * (1 - above)) / F.sum(n)
    room = F.sum(n * above * (1 - above)) / F.sum(n)
    return F.least(F.lit(1e4), F.greatest(F.lit(1.0), F.coalesce(F.try_divide(room, F.greatest(spread - noise, F.lit(1e-6))), F.lit(1.0)) - 1))


def site_rates(evidence: DataFrame, share: float) -> DataFrame:
    """(host, path, host_rate, path_rate) from (host, path, evidence)."""
    prior = math.log(share / (1 - share))
    p = 1 / (1 + F.exp(-(F.col("evidence") + prior)))
    paths = evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("good"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood"))
    top = hosts.agg((F.sum("hgood") / F.sum("hn")).alias("m")).first()[0]
    if top is None:
        return paths.select("host", "path", F.lit(share).alias("host_rate"), F.lit(share).alias("path_rate"))
    a = hosts.agg(_strength(F.col("hn"), F.col("hgood") / F.col("hn"), F.lit(top))).first()[0]
    hosts = hosts.withColumn("host_rate", (F.col("hgood") + a * top) / (F.col("hn") + a))
    both = paths.join(hosts, "host")
    b = both.agg(_strength(F.col("n"), F.col("good") / F.col("n"), F.col("host_rate"))).first()[0]
    return both.select("host", "path", "host_rate", ((F.col("good") + b * F.col("host_rate")) / (F.col("n") + b)).alias("path_rate"))


def _rated(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, source_col: str, threshold: float, broadcast_sites: int, params: dict) -> tuple[DataFrame, str, DataFrame]:
    """``df`` with numbered rows, the number's name, and a narrow table of each row's marks; texts are measured once."""
    (number,) = free_names(df, "_row", besides=OUT)
    rows, scratch = numbered(df, number), Scratch(df.sparkSession)
    model, counts = learn(df, labels, id_col=id_col, text_col=text_col, **params)
    share = min(0.999, max(0.001, counts[1] / sum(counts))) if sum(counts) else 0.5
    host, path = site_columns(F.col(f"`{source_col}`"))
    evident = scratch.put(rows.select(number, host.alias("host"), path.alias("path"), _evidence(model, share)(text_of(text_col)).alias("evidence")), "evidence")
    sites = scratch.put(site_rates(evident, share), "sites")
    small = sites.count() <= broadcast_sites
    logit = F.ln(F.col("path_rate") / (1 - F.col("path_rate")))
    rated = evident.join(F.broadcast(sites) if small else sites, ["host", "path"]).withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + logit))))
    return rows, number, rated.select(number, *OUT[:-1], (F.lit(not isinstance(model, Logistic)) | (F.col("score") >= threshold)).alias("accepted"))


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  threshold: float = 0.5, broadcast_sites: int = 20000, **params) -> DataFrame:
    """``df`` with host, path, evidence, host_rate, path_rate, score (posterior of good) and accepted.

    ``df`` should be a written table, whose rows are numbered by their place.  Its columns that have the name of a new
    one, in any case of letters, are renamed to ``<name>_in``.
    """
    df, now = set_aside(df, *OUT)
    rows, number, rated = _rated(df, labels, now[id_col], now[text_col], now[source_col], threshold, broadcast_sites, params)
    return rows.join(rated, number).select(*[F.col(f"`{c}`") for c in df.columns], *OUT)


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              threshold: float = 0.5, broadcast_sites: int = 20000, **params) -> DataFrame:
    """The accepted rows of ``df``, in its columns."""
    rows, number, rated = _rated(df, labels, id_col, text_col, source_col, threshold, broadcast_sites, params)
    return rows.join(rated.where("accepted").select(number), number, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
