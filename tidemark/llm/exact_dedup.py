"""Exact deduplication with a heavy-hitter split; DataFrame functions only.

Texts are equal when they agree after deleting every character of ``[\\x20\\x09-\\x0D]``.  The digest of that form is
the key.  A mergeable Misra-Gries summary (``approx_top_k``, a frequent-items sketch with decrementing counters) names
at most ``heavy`` frequent digests.  Their winners are verified by an exact aggregation, which combines map-side, and
are broadcast (``heavy`` rows at most), so the rows of a frequent digest are never grouped in a task.  All other digests
go through an ordinary shuffled aggregation and join; each of them has a small share of the rows by the sketch's bound.
Texts are read and hashed once; after that only rows of (place, id, digest, length) are counted, grouped and joined.

Defined cases: a null text counts as empty, and all blank texts are copies of each other.  A null id sorts after every
other id.  Rows that repeat an id with an equal text are one document: :func:`mark_exact_copies` marks them alike and
:func:`drop_exact_copies` leaves one of them.  An empty table gives an empty table.  Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, free_names, numbered, set_aside, text_of

#: The characters that do not count when texts are compared.
BLANK = r"[\x20\x09-\x0D]+"
OUT = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, BLANK, "")


def frequent_digests(df: DataFrame, digest: str, heavy: int, counters: int) -> DataFrame:
    """At most ``heavy`` digests which the Misra-Gries summary has seen at least twice."""
    top = df.agg(F.expr(f"approx_top_k(`{digest}`, {heavy}, {counters})").alias("top"))
    return top.select(F.explode("top").alias("e")).where("e.count > 1").select(F.col("e.item").alias(digest))


def _groups(rows: DataFrame) -> DataFrame:
    """For each digest the row that stays (most code points, then smallest id, null ids last), and the number of rows."""
    best = F.max(F.struct("length", F.col("id").isNotNull().alias("has"), (-F.col("id")).alias("neg"), (-F.col("row")).alias("place")))
    return rows.groupBy("digest").agg(best.alias("w"), F.count(F.lit(1)).alias("size")).select(
        "digest", (-F.col("w.neg")).alias("keep"), F.col("w.length").alias("keep_length"), (-F.col("w.place")).alias("keep_row"), "size")


def _split(digests: DataFrame, heavy: int, counters: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the frequent digests' groups, the rows of other digests, their groups); the first is a local relation of at most ``heavy`` rows."""
    spark = digests.sparkSession
    names = spark.createDataFrame([tuple(r) for r in frequent_digests(digests, "digest", heavy, counters).collect()], "digest string")
    hot = _groups(digests.join(F.broadcast(names), "digest", "left_semi"))
    hot = spark.createDataFrame([tuple(r) for r in hot.collect()], hot.schema)
    rest = digests.join(F.broadcast(names), "digest", "left_anti")
    return hot, rest, _groups(rest)


def _digests(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, DataFrame]:
    """``df`` with numbered rows, the number's name, and the narrow table (row, id, digest, length): texts are hashed once."""
    (number,) = free_names(df, "_row", besides=OUT)
    rows, text = numbered(df, number), text_of(text_col)
    narrow = rows.select(F.col(number).alias("row"), F.col(f"`{id_col}`").alias("id"), F.sha2(normalised(text), 256).alias("digest"), F.char_length(text).alias("length"))
    return rows, number, Scratch(df.sparkSession).put(narrow, "digests")


def mark_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 1024,
                      counters: int = 16384) -> DataFrame:
    """``df`` with keep_id, group_size, kept and text_sha256 for every row, copies included.

    ``df`` should be a written table, whose rows are numbered by their place.  Its columns that have the name of a new
    one, in any case of letters, are renamed to ``<name>_in``.  heavy: most digests that are broadcast; counters: size of
    the Misra-Gries summary (a power of two), which has each digest with more than about 3.5 / counters of the rows.
    """
    df, now = set_aside(df, *OUT)
    rows, number, digests = _digests(df, now[id_col], now[text_col])
    hot, rest, groups = _split(digests, heavy, counters)
    marks = digests.join(F.broadcast(hot), "digest").unionByName(rest.join(groups, "digest"))
    kept = F.col("id").eqNullSafe(F.col("keep")) & (F.col("length") == F.col("keep_length"))
    marks = marks.select(F.col("row").alias(number), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256"))
    return rows.join(marks, number).select(*[F.col(f"`{c}`") for c in df.columns], *OUT)


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 1024, counters: int = 16384) -> DataFrame:
    """The rows of ``df`` that stay, one of each group, with the columns of ``df``.

    Rows that repeat both id and text are told apart by their place: the first of them stays.
    """
    rows, number, digests = _digests(df, id_col, text_col)
    hot, _, groups = _split(digests, heavy, counters)
    stay = hot.unionByName(groups).select(F.col("keep_row").alias(number))
    return rows.join(stay, number, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
