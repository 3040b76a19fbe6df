"""Texts converted by a table of strings and what they become, the longest string at each place first.

That is how scripts are converted (traditional to simplified Chinese and back): the caller passes the table, of single
characters and of words that differ from their characters one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def longest_match(table: dict[str, str]) -> Callable[[str], str]:
    """A function that goes through a text once from left to right and takes the longest string of the table where it is.

    Places where no string of the table begins are skipped by a character class; at others the lengths of the strings
    with that first character are tried from the longest on.
    """
    lengths: dict[str, list[int]] = {}
    for source in table:
        lengths.setdefault(source[0], []).append(len(source))
    tried = {c: sorted(set(n), reverse=True) for c, n in lengths.items()}
    first = re.compile("[" + "".join(map(re.escape, tried)) + "]") if tried else None

    def convert(text: str) -> str:
        out, done, at = [], 0, 0
        while first and (found := first.search(text, at)):
            at = found.start()
            for n in tried[text[at]]:
                become = table.get(text[at : at + n])
                if become is not None:
                    out += [text[done:at], become]
                    done = at = at + n
                    break
            else:
                at += 1
        return "".join([*out, text[done:]])

    return convert


def inverted(table: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """The table for the way back: of strings that became the same one, the first."""
    return table.groupBy(F.col(target).alias(source)).agg(F.min(source).alias(target)).where(F.length(source) > 0)


def convert_text(df: DataFrame, col: str, table: DataFrame, source: str = "source", target: str = "target", out: str | None = None, most: int = 1_000_000) -> DataFrame:
    """``df`` with the text converted by ``table``; null stays null.

    The table is broadcast once it is known to have ``most`` rows at most, else it is an error, as it is if a string
    becomes two different ones.  A null target deletes; empty and null sources are left out.
    """
    some = table.where(F.length(source) > 0).select(F.col(source).alias("s"), F.coalesce(F.col(target), F.lit("")).alias("t")).distinct()
    rows, kinds = some.agg(F.count(F.lit(1)), F.count_distinct("s")).first()
    if rows > most or rows != kinds:
        raise ValueError(f"the table has {rows} rows for {kinds} strings, {most} at most are broadcast")
    held = df.sparkSession.sparkContext.broadcast({r.s: r.t for r in some.collect()})

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        convert = longest_match(held.value)
        return texts.map(convert, na_action="ignore")

    return df.withColumn(out or col, run(F.col(col).cast("string")))
